"""quarry: a Spark-first search and analytics engine for catalogues of items with many editions."""
