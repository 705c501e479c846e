"""Column functions: exact rational time, layout arithmetic, parsing, statistics."""
