"""Column functions: canonical answers, exact rounding, hashes, paths, dates and texts."""
