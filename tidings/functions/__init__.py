"""Column expressions: text, urls, html, vectors, scores."""
