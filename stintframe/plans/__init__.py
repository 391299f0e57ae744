"""Jobs, models and report tables built from the operators."""
