"""Column functions: signatures, messages, orderings."""
