"""Column expressions over paths, names, sizes and hashes."""
