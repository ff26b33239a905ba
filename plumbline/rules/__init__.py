"""Rules over the fact tables of source files, and the run that makes a report of their findings."""

from plumbline.rules.base import REGISTRY, Context, Policy, Rule, rule, run, run_rule

__all__ = ["REGISTRY", "Context", "Policy", "Rule", "rule", "run", "run_rule"]
