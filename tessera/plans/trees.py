"""Queries over the labelled tree of the documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import docs as D
from tessera.operators import retrieval as R
from tessera.operators.hierarchy import Tree
from tessera.sources.shared import drop_at_exit, shared_dir

from .registry import query
from .retrieval import DOCS_SQL, _docs

_NODES = f"""WITH {DOCS_SQL}, every AS (SELECT uri, string_split(uri, '/') AS p FROM docs), dirs AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS uri FROM every, unnest(range(3, 6)) AS t(i)),
nodes AS (SELECT uri, true AS is_leaf FROM every UNION ALL SELECT uri, false FROM dirs), up AS (SELECT array_to_string(string_split(uri, '/')[1:i], '/') AS uri FROM nodes, unnest(range(3, 6)) AS t(i) WHERE i < len(string_split(uri, '/')))"""


def _tree(spark: SparkSession, sf_dir: str) -> Tree:
    path = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    drop_at_exit(spark, path)
    return Tree.build(_docs(spark, sf_dir), path)


@query(f"{_NODES}, below AS (SELECT uri, count(*) AS n FROM up GROUP BY uri), r AS (SELECT uri, is_leaf, row_number() OVER (ORDER BY replace(uri, '/', chr(1))) - 1 AS pre FROM nodes) SELECT r.uri, is_leaf, pre, CAST(pre + coalesce(n, 0) AS BIGINT) AS last FROM r LEFT JOIN below USING (uri)")
def q_tree_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node's number in pre-order and the last one below it."""
    return _tree(spark, sf_dir).nodes.select("uri", "is_leaf", "pre", "last")


@query(f"""WITH {DOCS_SQL}, every AS (SELECT uri, content, string_split(uri, '/') AS p FROM docs) SELECT array_to_string(p[1:i], '/') AS uri, count(*) AS leaves, CAST(coalesce(sum(length(content)), 0) AS BIGINT) AS chars FROM every, unnest(range(3, 6)) AS t(i) GROUP BY 1""")
def q_subtree_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters below every directory."""
    return _tree(spark, sf_dir).sums(leaves=F.col("document").cast("long"), chars=F.length("content")).select("uri", "leaves", "chars")


@query(f"""WITH {DOCS_SQL}, f AS (SELECT uri, string_split(uri, '/') AS p FROM docs WHERE lang = 'es' AND source IN ('src1', 'src2'))
SELECT uri FROM f UNION SELECT array_to_string(p[1:i], '/') AS uri FROM f, unnest(range(3, 6)) AS t(i)""")
def q_projection_by_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves with the wanted tags and the directories above them, by running sums over the labels."""
    ok = R.matches_filter(F.col("tags"), D.mime(F.col("name"), F.col("is_leaf")), ["ES"], "text/plain") & (F.array_contains("tags", "src1") | F.array_contains("tags", "src2"))
    return _tree(spark, sf_dir).projection(ok)


@query(f"WITH {DOCS_SQL}, m AS (SELECT uri, replace(uri, 'ctx://resources/src1/', 'ctx://resources/old/src1/') AS new FROM docs WHERE starts_with(uri, 'ctx://resources/src1/')) SELECT uri, 'goes' AS change FROM m UNION ALL SELECT new, 'comes' FROM m")
def q_subtree_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a move of a subtree changes: its range is all that is read."""
    changed, gone = _tree(spark, sf_dir).moved("ctx://resources/src1", "ctx://resources/old/src1")
    return gone.select("uri", F.lit("goes").alias("change")).unionByName(changed.select("uri", F.lit("comes").alias("change")))
