"""DataFrame -> DataFrame operators, grouped by the step of the review they serve."""
