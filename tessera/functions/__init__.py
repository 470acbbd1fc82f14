"""Column functions: binary layouts, paths, scores and code tables."""
