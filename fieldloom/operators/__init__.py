"""The adapter registry and the operators that apply compiled rules to DataFrames."""

from .adapters import Adapter, Registry, default_registry
from .validate import invalid_rows, rule_report, rule_totals, valid_rows, with_violations

__all__ = ["Adapter", "Registry", "default_registry", "invalid_rows", "rule_report", "rule_totals", "valid_rows", "with_violations"]
