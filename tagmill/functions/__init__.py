"""Column expressions: random numbers, parsing, text, vectors, fuzzy scores."""
