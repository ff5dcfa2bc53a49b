"""Where rows come from and go to: Spark's own readers and writers."""

from .tables import read_table, write_split

__all__ = ["read_table", "write_split"]
