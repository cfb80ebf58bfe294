"""Detection operators: one DataFrame function each."""
