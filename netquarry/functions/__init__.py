"""Column expressions: typed access to JSON records, addresses, names, TLS fingerprints."""
