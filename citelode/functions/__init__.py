"""Column functions: text normalisation, parsing, order statistics."""
