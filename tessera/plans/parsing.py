"""Parsers and flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import memory as M
from tessera.sources import files as S

from .registry import query, table


@query("SELECT event_id AS id, '$.' || j.key AS path, CAST(j.value AS VARCHAR) AS value FROM events, json_each(props) AS j")
def q_json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and scalars of the events' properties."""
    return S.flatten_documents(table(spark, sf_dir, "events"), "event_id", "props")


@query("SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key ORDER BY n DESC, key LIMIT 10")
def q_dominant_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent top-level keys."""
    keys = table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(10)


@query()
def q_xml_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and texts of the raw pages."""
    return S.flatten_documents(table(spark, sf_dir, "pages"), "page_id", "html", "xml")


@query(r"SELECT doc_id, CAST(len(list_distinct(list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g')))), lambda x: strlen(x) >= 3))) AS INTEGER) AS distinct_lines FROM documents")
def q_content_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct normalised lines each document has."""
    own = T.content_lines(F.col("text"), 1 << 30)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(own).alias("distinct_lines"))


_MARKED = "CASE WHEN doc_id % 3 = 0 THEN '# Title ' || doc_id || ' ##' || chr(10) || '```' || chr(10) || '# code' || chr(10) || '```' || chr(10) ELSE '' END || replace(text, '. ', '.' || chr(10) || '## ')"


@query(rf"""WITH d AS (SELECT doc_id, {_MARKED} AS text FROM documents), l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS x, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS n FROM d),
f AS (SELECT *, sum(CASE WHEN regexp_matches(x, '^[ 	]*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS fences FROM l), h AS (SELECT doc_id, n, lower(trim(regexp_replace(regexp_extract(trim(x, ' '), '^#{{1,6}}\s+(.*)$', 1), '#+\s*$', ''), ' ')) AS h FROM f WHERE fences % 2 = 0),
o AS (SELECT doc_id, list(h ORDER BY n) AS hs FROM (SELECT doc_id, h, min(n) AS n FROM h WHERE h <> '' GROUP BY doc_id, h) GROUP BY doc_id) SELECT d.doc_id, CASE WHEN hs IS NULL THEN [] WHEN len(hs) <= 24 THEN hs ELSE list_concat(hs[1:12], hs[greatest(len(hs) - 11, 13):]) END AS headings FROM d LEFT JOIN o USING (doc_id)""")
def q_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings outside fences: sentences are made to be headings, as the texts have none."""
    d = table(spark, sf_dir, "documents")
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# Title "), F.col("doc_id").cast("string"), F.lit(" ##\n```\n# code\n```\n"))).otherwise("")
    return d.select("doc_id", T.headings(F.concat(head, F.replace("text", F.lit(". "), F.lit(".\n## ")))).alias("headings"))


@query()
def q_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged sections of the raw pages."""
    own = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    return own.mapInPandas(M.parse_sections, "id long, section string, body string")
