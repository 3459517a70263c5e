"""Operators on alignments, reads, calls and windows."""
