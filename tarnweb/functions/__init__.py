"""Column functions: URLs, strings, fuzzy matching."""
