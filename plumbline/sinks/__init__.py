"""Where findings go: reports, baselines, trends, digests, edits."""
