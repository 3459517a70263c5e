"""Where alignments, lengths and reads come from, and where results go."""
