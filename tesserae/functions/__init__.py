"""Column-level functions built from Catalyst expressions."""
