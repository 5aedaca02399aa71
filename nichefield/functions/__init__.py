"""Column-level building blocks: hashing, coordinates, scalar transforms."""
