"""Column functions on strings, arrays, sets, dictionaries and numbers."""
