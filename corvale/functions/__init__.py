"""Column functions: text, keywords, URLs, vectors."""
