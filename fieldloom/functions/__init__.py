"""Column functions: text helpers and rule predicates, all built from Spark's own expressions."""

from .predicates import at_least_nonword, filled, number_of, whole_match
from .text import default_verb, escape_selector, first_filled, first_known, model_prefix, split_items, with_model_prefix

__all__ = ["at_least_nonword", "default_verb", "escape_selector", "filled", "first_filled", "first_known", "model_prefix", "number_of", "split_items", "whole_match", "with_model_prefix"]
