"""Column functions: text normalization, terms, privacy patterns, hashing, JSON."""
