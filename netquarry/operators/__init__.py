"""DataFrame to DataFrame steps between records and the gold tables."""
