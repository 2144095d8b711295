"""Ring-structure screening as composable Spark DataFrame operators."""
