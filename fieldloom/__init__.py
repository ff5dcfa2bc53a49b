"""fieldloom: declarative field rules compiled to Spark columns."""
