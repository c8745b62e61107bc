"""Column functions: text, vectors, storage keys."""
