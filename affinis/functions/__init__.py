"""Column functions: normalisation, address parsing and similarities."""
