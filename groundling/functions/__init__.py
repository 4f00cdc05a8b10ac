"""Column functions: text normalisation, byte views, vocabulary."""
