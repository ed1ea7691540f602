"""Column functions: identifiers, counts, relative time and text."""
