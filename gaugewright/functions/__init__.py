"""Column builders and the distributions that statistics need."""
