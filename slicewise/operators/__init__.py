"""Operators: every one is ``DataFrame -> DataFrame``, sliced by the grouping columns in ``by``."""
