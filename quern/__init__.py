"""Composable queries as first-class values, compiled to Spark DataFrame and SQL plans."""
