"""Column builders: canonical keys, hashing, guarded arithmetic, tail probabilities."""
