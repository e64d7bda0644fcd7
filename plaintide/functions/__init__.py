"""Column functions: pure projections that work on tables and streams alike."""
