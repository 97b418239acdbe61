"""Column functions: text, hashing, titles, scores."""
