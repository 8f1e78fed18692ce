"""Column functions: URLs, text, dates, scores, vectors and response parsing."""
