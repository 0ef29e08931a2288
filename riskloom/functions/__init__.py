"""Column-level helpers: null-safe predicates and tail probabilities."""
