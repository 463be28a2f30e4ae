"""Column expressions: text, keys, arrays of probabilities."""
