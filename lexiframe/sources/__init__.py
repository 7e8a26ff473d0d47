"""Readers and writers: delimited lines, nested stand-off records, brackets, columns."""
