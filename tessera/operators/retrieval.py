"""Ranked retrieval: BM25, dense, exact ladder, filters, fan-out, expansion, reranking.

Query terms and query vectors are the small, bounded side (a request's words),
so they are broadcast; documents and postings are never collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.functions import text as T

#: Weights by priority of a planned query, fixed values.
FANOUT = {1: 1.0, 2: 0.82, 3: 0.64}
LAST_FANOUT = 0.46
ALPHA = 0.5


def bm25(postings: DataFrame, terms: list[str]) -> DataFrame:
    """``(uri, bm25, matched)`` of documents with a query term.

    N, document frequencies and the average length are those of the whole
    index, taken before any filter. Postings are read once for the lengths
    (a map-side sum) and once, filtered to the terms, for the scores.
    """
    own, postings = list(dict.fromkeys(terms)), postings.select("uri", "term", "tf")
    lens = postings.groupBy("uri").agg(F.sum("tf").alias("doc_len"))
    corpus = lens.agg(F.count("*").alias("n"), F.avg("doc_len").alias("avg_len"))
    hits = postings.where(F.col("term").isin(own))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), "term").join(lens, "uri").crossJoin(F.broadcast(corpus))  # df: a row a query term; corpus: one row
    part = S.idf(F.col("n"), F.col("df")) * S.bm25_term(F.col("tf"), F.col("doc_len"), F.col("avg_len"))
    return scored.groupBy("uri").agg(F.sum(part).alias("bm25"), F.count("*").alias("matched"))


def bm25_scan(docs: DataFrame, words: Column, terms: list[str], keep: list[str], every: bool = False) -> DataFrame:
    """The columns ``keep`` with ``bm25`` and ``matched``, of documents with a query term (or ``every`` one), without an index.

    Each scan counts a document's words and query terms in its own row; the
    corpus statistics are one row that is broadcast. Nothing is shuffled but
    that row's partial sums.
    """
    own = list(dict.fromkeys(terms))
    seen = docs.select(*keep, words.alias("__words")).select(*keep, F.size("__words").alias("__len"), F.filter("__words", lambda x: x.isin(own)).alias("__hits"))
    tf = [F.size(_only("__hits", t)) for t in own]
    counted = seen.select("*", *[c.alias(f"__tf{i}") for i, c in enumerate(tf)])
    filled = F.when(F.col("__len") > 0, F.col("__len"))  # a text without words is in no posting
    stats = counted.agg(F.count(filled).alias("__n"), F.avg(filled).alias("__avg"), *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in range(len(own))])
    scored = (counted if every else counted.where(F.size("__hits") > 0)).crossJoin(F.broadcast(stats))  # one row
    part = lambda i: F.when(F.col(f"__tf{i}") > 0, S.idf(F.col("__n"), F.col(f"__df{i}")) * S.bm25_term(F.col(f"__tf{i}"), F.col("__len"), F.col("__avg"))).otherwise(0.0)
    total, matched = F.lit(0.0), F.lit(0)
    for i in range(len(own)):
        total, matched = total + part(i), matched + (F.col(f"__tf{i}") > 0).cast("int")
    return scored.select(*keep, total.alias("bm25"), matched.cast("long").alias("matched"))


def _only(column: str, term: str) -> Column:
    return F.filter(column, lambda x: x == F.lit(term))


@dataclass(frozen=True)
class Index:
    """A stored inverted index: rows (term, uri, tf, doc_len, terms), in folders by term bucket and sorted by term.

    A query's terms name their buckets, so a request reads those folders alone,
    and in them the row groups that hold the terms. ``terms`` is the number of a
    document's distinct terms. ``n`` and ``avg_len`` are those of the corpus.
    """

    path: str
    buckets: int
    n: int
    avg_len: float

    def rows(self, spark: SparkSession, terms: list[str]) -> DataFrame:
        own = sorted(set(terms))
        where = spark.range(1).select(F.array_distinct(F.transform(F.array(*[F.lit(t) for t in own]), lambda t: bucket_of(t, self.buckets))).alias("b")).first()["b"] if own else []
        return spark.read.parquet(self.path).where(F.col("bucket").isin(where) & F.col("term").isin(own))

    def bm25(self, spark: SparkSession, terms: list[str]) -> DataFrame:
        """``(uri, bm25, matched, terms)`` of documents with a query term."""
        hits = self.rows(spark, terms)
        df = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row a query term
        part = S.idf(F.lit(float(self.n)), F.col("df")) * S.bm25_term(F.col("tf"), F.col("doc_len"), F.lit(self.avg_len))
        return hits.join(F.broadcast(df), "term").groupBy("uri").agg(F.sum(part).alias("bm25"), F.count("*").alias("matched"), F.first("terms").alias("terms"))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build_index(postings: DataFrame, path: str, buckets: int = 64) -> Index:
    """Write ``postings(uri, term, tf)`` as an index: one shuffle by bucket for the order, and one by document for the lengths unless ``doc_len`` and ``terms`` are there.

    The corpus' statistics are read from what is written: of the documents with ``t`` terms there are ``t`` rows each.
    """
    rows = postings
    if not {"doc_len", "terms"} <= set(postings.columns):
        by = Window.partitionBy("uri")
        rows = postings.withColumn("doc_len", F.sum("tf").over(by)).withColumn("terms", F.count("*").over(by).cast("int"))
    rows = rows.withColumn("bucket", bucket_of(F.col("term"), buckets))
    rows.repartition("bucket", F.pmod(F.xxhash64("uri"), F.lit(4))).sortWithinPartitions("bucket", "term", "uri").write.partitionBy("bucket").mode("overwrite").parquet(path)
    own = postings.sparkSession.read.schema(rows.schema).parquet(path).groupBy("terms").agg((F.count("*") / F.col("terms")).cast("long").alias("docs"), (F.sum("doc_len") / F.col("terms")).cast("long").alias("words"))
    whole = own.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.sum("words").alias("words")).first()
    return Index(path, buckets, whole["docs"], whole["words"] / whole["docs"] if whole["docs"] else 0.0)


def near_pairs(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of texts within one edit or one swap of neighbours, lower-cased.

    Texts within one edit share the text itself or a text with one character
    less; a swap shares one too. They meet by equality of these and are then compared.
    """

    def keyed(df: DataFrame, c: str, key: str) -> DataFrame:
        low = F.lower(c)
        short = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: F.concat(F.substring(low, F.lit(1), i - 1), F.substring(low, i + 1, F.length(low))))
        return df.select(c, F.explode(F.array_distinct(F.concat(F.array(low), short))).alias(key))

    met = keyed(left.select(a).distinct(), a, "ka").join(keyed(right.select(b).distinct(), b, "kb"), F.col("ka") == F.col("kb")).select(a, b).distinct()
    return met.where(T.edit_distance_one(F.lower(a), F.lower(b)))


def top(scored: DataFrame, k: int, score: str = "score", key: str = "uri") -> DataFrame:
    """The k best by score, ties by key: kept per partition, then merged."""
    return scored.orderBy(F.desc(score), key).limit(k)


def with_rank(best: DataFrame, score: str = "score", key: str = "uri") -> DataFrame:
    """A rank column on an already limited result."""
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)).cast("int"))


def dense(vectors: DataFrame, query: list[float], vec: str = "embedding") -> DataFrame:
    """Every row with its dot product with the query vector, a literal of the plan."""
    return vectors.withColumn("score", S.dot(F.col(vec), F.array(*[F.lit(float(x)) for x in query])))


#: Scores of the exact ladder by key and field, in the order in which they are tried. Fixed values.
LADDER = {
    "literal": [("uri", 1.0), ("heading", 0.985), ("line", 0.975), ("abstract", 0.99), ("base", 0.98), ("stem", 0.96), ("name", 0.94)],
    "signature": [("abstract", 0.95), ("heading", 0.935), ("line", 0.93), ("stem", 0.92), ("base", 0.90), ("name", 0.88)],
    "compact": [("stem", 0.93), ("heading", 0.925), ("base", 0.91), ("name", 0.89), ("abstract", 0.87)],
    "edit": [("heading", 0.88), ("stem", 0.86), ("base", 0.84), ("name", 0.82)],
}


#: Keys of a text that the rungs compare; one edit and the fuzzy bigrams read compact keys.
KEYS = {"literal": F.lower, "signature": lambda c: F.array_join(T.tokenize(c), " "), "compact": T.compact_key}


def exact_ladder(query: str, fields: dict[str, Column]) -> Column:
    """The exact-match ladder: the first rule that holds gives the score.

    ``fields`` has columns for uri, name, base, stem and abstract, and arrays of
    lower-case strings for heading and line. Literal keys are tried first, then
    token signatures, compact keys, one edit, and last the fuzzy bigrams. Each key is made once a row.
    """
    keys = ladder_keys(fields)
    return T.let(F.struct(*[c.alias(k) for k, c in keys.items()]), lambda own: ladder(query, {k: own[k] for k in keys}))


def ladder_keys(fields: dict[str, Column]) -> dict[str, Column]:
    """All keys that ``ladder`` compares, to be made once for several queries."""
    need = [(kind, field) for kind in KEYS for field, _ in LADDER[kind]]
    need += [("compact", field) for field, _ in LADDER["edit"] if ("compact", field) not in need]
    key = lambda kind, field: F.transform(fields[field], KEYS[kind]) if field in ("heading", "line") else KEYS[kind](fields[field])
    return {f"{kind}_{field}": key(kind, field) for kind, field in need}


def ladder(query: str, keys: dict[str, Column]) -> Column:
    """The ladder over ``ladder_keys``; the query's own keys are constants of the plan."""
    asked = F.trim(F.lit(query))
    wanted = SparkSession.active().range(1).select(*[f(asked if k == "literal" else F.lit(query)).alias(k) for k, f in KEYS.items()]).first()
    rule = F.when(F.lit(False), 0.0)
    for kind, rungs in LADDER.items():
        own = "compact" if kind == "edit" else kind
        for field, value in rungs if len(wanted[own]) >= (5 if kind == "edit" else 1) else []:
            rule = rule.when(_same(keys[f"{own}_{field}"], field, F.lit(wanted[own]), kind == "edit"), value)
    return rule.otherwise(F.greatest(*[_fuzzy(F.lit(wanted["compact"]), keys[f"compact_{f}"], w) for f, w in (("stem", 0.86), ("base", 0.84), ("name", 0.82))]))


def _same(key: Column, field: str, wanted: Column, near: bool) -> Column:
    test = lambda c: T.edit_distance_one(c, wanted) if near else c == wanted
    return F.exists(key, test) if field in ("heading", "line") else test(key)


def fuzzy(compact_query: Column, field: Column, weight: float) -> Column:
    """Weighted bigram similarity: both of six characters or more, near lengths, same first character, dice of 0.7 or more."""
    return T.let(T.compact_key(field), lambda key: _fuzzy(compact_query, key, weight))


def _fuzzy(compact_query: Column, key: Column, weight: float) -> Column:
    near = (F.length(key) >= 6) & (F.length(compact_query) >= 6) & (F.abs(F.length(key) - F.length(compact_query)) <= 4)
    near = near & (F.substring(key, 1, 1) == F.substring(compact_query, 1, 1))
    alike = T.let(T.dice(T.bigrams(key), T.bigrams(compact_query)), lambda d: F.when(d >= 0.70, weight * (0.52 + 0.43 * d)).otherwise(0.0))
    return F.when(near, alike).otherwise(0.0)


def matches_filter(tags: Column, own_mime: Column, wanted: list[str], mime: str | None) -> Column:
    """All wanted tags are there, whatever their case, and the media type is equal."""
    wanted = sorted({t.strip().lower() for t in wanted if t.strip()})
    have = F.transform(tags, F.lower)
    ok = F.lit(True)
    for t in wanted:
        ok = ok & F.array_contains(have, t)
    return ok & (own_mime == mime) if mime else ok


def filter_projection(docs: DataFrame, matching: Column) -> DataFrame:
    """URIs of matching leaves and of all their ancestors."""
    from tessera.operators.docs import ancestors

    leaves = docs.where(matching).select("uri")
    return leaves.unionByName(leaves.select(F.explode(ancestors(F.col("uri"))).alias("uri"))).distinct()


def fanout_weight(priority: int) -> float:
    return FANOUT.get(priority, LAST_FANOUT)


def merge_fanout(frames: list[tuple[DataFrame, int]], k: int | None = None) -> DataFrame:
    """Hits of several planned queries, weighted by priority; the best score of each uri stays, of the ``k`` best if asked for."""
    out = None
    for df, priority in frames:
        own = df.select("uri", (F.col("score") * fanout_weight(priority)).alias("score"))
        out = own if out is None else out.unionByName(own)
    best = out.groupBy("uri").agg(F.max("score").alias("score"))
    return best if k is None else top(best, k)


def expand_levels(tree: DataFrame, local: DataFrame, root: str, levels: int = 5) -> DataFrame:
    """Leaf scores of a level-wise descent: half the own score, half the parent's.

    ``tree`` has uri, parent_uri, is_leaf; ``local`` has uri, score (missing: 0).
    Every level is one join on parent_uri; the depth is bounded.
    """
    nodes = tree.join(local, "uri", "left").select("uri", "parent_uri", "is_leaf", F.coalesce("score", F.lit(0.0)).alias("local"))
    front = tree.sparkSession.createDataFrame([(root, 0.0)], "p string, p_score double")
    out = None
    for _ in range(levels):
        reached = nodes.join(front, nodes["parent_uri"] == front["p"]).select("uri", "is_leaf", (ALPHA * F.col("local") + (1 - ALPHA) * F.col("p_score")).alias("score"))
        leaves = reached.where("is_leaf").select("uri", "score")
        out = leaves if out is None else out.unionByName(leaves)
        front = reached.where("not is_leaf").select(F.col("uri").alias("p"), F.col("score").alias("p_score"))
    return out.groupBy("uri").agg(F.max("score").alias("score"))


def rerank(hits: DataFrame, boost: Column, k: int) -> DataFrame:
    """Scores times 1 + boost, with the boost held in 0 to 0.65, sorted anew."""
    held = F.least(F.lit(0.65), F.greatest(F.lit(0.0), boost))
    return top(hits.withColumn("score", F.col("score") * (1 + held)), k)


def relations_of(hits: DataFrame, relations: DataFrame, most: int = 5) -> DataFrame:
    """Up to ``most`` related URIs of each hit, from relations owned by one of its ancestors.

    The containment test becomes equality joins: the hit's ancestors against the
    owner and, at once, the hit against the relation's members (``relations.least``).
    """
    from tessera.operators.docs import ancestors
    from tessera.operators.relations import least

    up = hits.select("uri", F.explode(ancestors(F.col("uri"))).alias("owner_uri"))
    return least(up, relations, ["reason"], most)


def longest_prefix(docs: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Each uri with the type of the longest rule prefix it lies under.

    Rules are configuration, a short list: they become one CASE, longest first,
    so no join is needed.
    """
    case = F.lit(None).cast("string")
    for prefix, kind in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        case = F.when(S.under(F.col("uri"), prefix), kind).otherwise(case)
    return docs.select("uri", case.alias("object_type"))
