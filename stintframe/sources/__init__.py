"""Reading, quarantining and writing tables."""
