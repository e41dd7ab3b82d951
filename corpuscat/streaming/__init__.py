"""Incremental runs of row-wise operators over arriving files."""
