"""Column-level building blocks: scalar expressions, filters and exact percentiles."""
