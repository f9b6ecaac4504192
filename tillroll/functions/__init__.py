"""Column expressions; all are built from Catalyst's own functions."""
