"""From field attributes to rules to Spark columns."""

from .compiler import Form, column_of, compile_field, compile_form, compile_forms

__all__ = ["Form", "column_of", "compile_field", "compile_form", "compile_forms"]
