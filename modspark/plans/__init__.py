"""Whole queries: commands over alignment files, and registered queries over tables."""
