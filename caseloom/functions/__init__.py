"""Column functions (names, text, URLs, dates, scores)."""
