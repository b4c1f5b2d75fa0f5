"""loomframe: composable DataFrame -> DataFrame analytics operators for Spark."""
