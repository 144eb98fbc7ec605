"""Part of the query engine; see README.md."""
