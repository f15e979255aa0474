"""The query tree and its compilation to Columns."""
