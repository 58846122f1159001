"""Named analyses: each takes the six source tables and returns one result."""
