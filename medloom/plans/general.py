"""Queries of the general problems: packed cells (p3) and hierarchies (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom.operators import hierarchy
from medloom.operators.packed import explode_packed
from medloom.runtime import table

MESH_CELLS = {"preferred_terms": "terms", "synonyms": "terms", "tree_numbers": "tree_numbers"}


def packed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every value of the packed cells of mesh and clinical_records, with its flag."""
    mesh = explode_packed(table(spark, sf, "mesh"), "line_no", MESH_CELLS, "mesh")
    return mesh.unionByName(explode_packed(table(spark, sf, "clinical_records"), "row_id", {"document_types": "tags"}, "clinical_records"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return packed_rows(spark, sf).select("tbl", "row_no", "field_name", "pos", "item")


def p3_flags(spark: SparkSession, sf: str) -> DataFrame:
    """How many values of each field came out of which alternative of the grammar."""
    return packed_rows(spark, sf).groupBy("tbl", "field_name", "flag").agg(F.count(F.lit(1)).alias("n"))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the code table and of the tree numbers."""
    numbers = explode_packed(table(spark, sf, "mesh"), "line_no", {"tree_numbers": "tree_numbers"}, "mesh")
    return hierarchy.code_nodes(table(spark, sf, "icd10_nodes")).unionByName(hierarchy.prefix_nodes(numbers))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.hierarchies(nodes(spark, sf)).select("hierarchy", "node", "root_node", "node_depth", "node_path")


def p4_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Each node's tour interval and number of descendants: x is below y iff y.entry < x.entry < y.exit."""
    return hierarchy.hierarchies(nodes(spark, sf)).select("hierarchy", "node", "root_node", "node_depth", "entry", "exit", "n_descendants")


def p4_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Every node under each of its ancestors."""
    return hierarchy.descendants(nodes(spark, sf))


QUERIES = {"p3_found": p3_found, "p3_flags": p3_flags, "p4_found": p4_found, "p4_intervals": p4_intervals, "p4_descendants": p4_descendants}

_NODES = r"""i0 AS (SELECT upper(regexp_replace(code, '[^\p{L}\p{Nd}]', '', 'g')) AS node, arg_min(upper(regexp_replace(coalesce(parent, ''), '[^\p{L}\p{Nd}]', '', 'g')), row_no) AS parent
      FROM icd10_nodes WHERE regexp_replace(code, '[^\p{L}\p{Nd}]', '', 'g') <> '' GROUP BY 1),
    m0 AS (SELECT DISTINCT upper(unnest(regexp_extract_all(tree_numbers, '[A-Za-z][0-9]{2}(?:\.[0-9]+)*'))) AS node FROM mesh),
    m1 AS (SELECT a.node, arg_max(b.node, length(b.node)) AS parent FROM m0 a LEFT JOIN m0 b ON starts_with(a.node, b.node || '.') GROUP BY a.node),
    nodes AS (SELECT 'icd10' AS hierarchy, node, CASE WHEN parent IN (SELECT node FROM i0) THEN parent END AS parent FROM i0 UNION ALL SELECT 'mesh', node, parent FROM m1),
    down AS (SELECT hierarchy, node, node AS root_node, 0 AS node_depth, node AS node_path FROM nodes WHERE parent IS NULL UNION ALL
             SELECT n.hierarchy, n.node, d.root_node, d.node_depth + 1, d.node_path || ' > ' || n.node FROM nodes n JOIN down d ON d.hierarchy = n.hierarchy AND d.node = n.parent),
    lost AS (SELECT * FROM nodes ANTI JOIN down USING (hierarchy, node)),
    climb AS (SELECT hierarchy, node AS start, parent AS at FROM lost UNION SELECT c.hierarchy, c.start, l.parent FROM climb c JOIN lost l ON l.hierarchy = c.hierarchy AND l.node = c.at)"""

_UP = """up AS (SELECT n.hierarchy, n.node, n.parent AS ancestor, 1 AS distance FROM nodes n JOIN down USING (hierarchy, node) WHERE n.parent IS NOT NULL UNION ALL
    SELECT u.hierarchy, u.node, n.parent, u.distance + 1 FROM up u JOIN nodes n ON n.hierarchy = u.hierarchy AND n.node = u.ancestor WHERE n.parent IS NOT NULL)"""
_KIND = "CASE WHEN EXISTS (SELECT 1 FROM climb c WHERE c.hierarchy = lost.hierarchy AND c.start = lost.node AND c.at = lost.node) THEN 'CYCLE' ELSE 'BELOW_CYCLE' END"
SQL: dict[str, str] = {
    "p4_found": f"""WITH RECURSIVE {_NODES} SELECT hierarchy, node, root_node, node_depth::INTEGER AS node_depth, node_path FROM down UNION ALL
        SELECT hierarchy, node, {_KIND}, -1, '' FROM lost""",
    "p4_intervals": f"""WITH RECURSIVE {_NODES}, {_UP}, below AS (SELECT hierarchy, ancestor AS node, count(*) AS n FROM up GROUP BY 1, 2),
        met AS (SELECT *, row_number() OVER (ORDER BY hierarchy, string_split(node_path, ' > ')) - 1 AS r FROM down)
        SELECT hierarchy, node, root_node, node_depth::INTEGER AS node_depth, (2 * r - node_depth)::BIGINT AS entry, (2 * r - node_depth + 2 * coalesce(n, 0) + 1)::BIGINT AS exit, coalesce(n, 0)::BIGINT AS n_descendants
        FROM met LEFT JOIN below USING (hierarchy, node) UNION ALL SELECT hierarchy, node, {_KIND}, -1, NULL, NULL, NULL FROM lost""",
    "p4_descendants": f"""WITH RECURSIVE {_NODES}, {_UP} SELECT hierarchy, ancestor, node, distance::INTEGER AS distance FROM up""",
}
