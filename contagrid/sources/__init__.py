"""Input and output tables."""
