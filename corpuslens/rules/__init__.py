"""The rules: each turns facts into findings and stable subjects, as two DataFrames keyed by pkg_id."""

from .catalog import RULES, Rule, rule_ids, run_rules

__all__ = ["RULES", "Rule", "rule_ids", "run_rules"]
