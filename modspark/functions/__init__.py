"""Scalar functions, as Columns where a plan uses them and as Python where a kernel does."""
