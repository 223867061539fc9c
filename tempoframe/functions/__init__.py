"""Column functions with the numeric conventions of beat analysis."""
