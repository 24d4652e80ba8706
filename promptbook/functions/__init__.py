"""Column functions with the exact text semantics that the operators share."""
