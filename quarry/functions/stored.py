"""Table functions for SQL: hierarchies of tags as functions of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quarry.operators.tags import walk

# name: (parameters, result columns, query over the views of edges and of all pairs)
TABLE_FUNCTIONS = {
    "tag_parents": ("child STRING", "parent_tag STRING", "SELECT parent_tag FROM tag_edges WHERE child_tag = child"),
    "tag_children": ("parent STRING", "child_tag STRING", "SELECT child_tag FROM tag_edges WHERE parent_tag = parent"),
    "tag_ancestors": ("of STRING", "reached STRING", "SELECT reached FROM tag_pairs WHERE tag = of"),
    "tag_descendants": ("of STRING", "tag STRING", "SELECT tag FROM tag_pairs WHERE reached = of"),
}


def register(edges: DataFrame) -> None:
    """Makes the functions known to the edges' session; edges: child_tag, parent_tag. All pairs are worked out once, here."""
    spark = edges.sparkSession
    edges.createOrReplaceTempView("tag_edges")
    walk(edges).createOrReplaceTempView("tag_pairs")
    for name, (parameters, columns, query) in TABLE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {query}")
