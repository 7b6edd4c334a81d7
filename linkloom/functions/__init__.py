"""Column functions: paths, rounding, classification, colours, language tables."""
