"""Where facts come from: folders, texts in memory, changes under version control, configuration, notes,
manifests, packages, stored results."""
