"""Readers and writers."""

from slicewise.sources.readers import lines_of, read_any, read_lines, read_table
from slicewise.sources.writers import write_scorecard

__all__ = ["lines_of", "read_any", "read_lines", "read_table", "write_scorecard"]
