"""Column functions: cells of raw tables, numbers, dates, vectors, hashes."""
