"""Customer risk review as composable Spark DataFrame operators."""
