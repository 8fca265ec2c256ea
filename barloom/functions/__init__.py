"""Column functions: exact decimals, the trading calendar, identifiers."""
