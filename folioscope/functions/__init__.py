"""Column expressions: text measures, paths, versions, vectors and labels."""
