"""Column functions built from Catalyst expressions."""
