"""Queries of the training-data operators over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlode.llm import clusters, docpairs, origin, packing, pieces, spans, tokens, validity, vectors
from graphlode.plans.session import stage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


@query
def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.found(table(spark, sf_dir, "documents"))


@query
def p10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans.spans(table(spark, sf_dir, "documents"))
    return out.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ","))


def _clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(members (kind, cluster_key, member_key), points): both kinds of records go through the components together."""
    edges, copies, points = clusters.vector_links(table(spark, sf_dir, "vectors"))
    more, equal = clusters.set_links(table(spark, sf_dir, "communities"))
    tag = lambda df, kind: df.select(*[F.concat(F.lit(f"{kind}\x01"), c).alias(c) for c in ("a", "b")])
    members = clusters.merged(tag(edges, "vector").union(tag(more, "community")), tag(copies, "vector").union(tag(equal, "community")), 3)
    bare = lambda c: F.regexp_extract(c, "^[^\x01]*\x01([\\s\\S]*)$", 1).alias(c)
    return members.select(F.substring_index("cluster_key", "\x01", 1).alias("kind"), bare("cluster_key"), bare("member_key")), points


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir)[0].where("cluster_key <> member_key")


@query
def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, points = _clusters(spark, sf_dir)
    members = stage(members)
    of = lambda kind: members.where(F.col("kind") == kind).drop("kind")
    both = clusters.describe_vectors(of("vector"), points, 96).withColumn("kind", F.lit("vector"))
    both = both.unionByName(clusters.describe_sets(of("community"), table(spark, sf_dir, "communities")).withColumn("kind", F.lit("community")))
    return both.select("kind", "cluster_key", "size", F.round("cohesion", 4).alias("cohesion"), F.array_join("medoids", ",").alias("medoids"))


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # few results a list, so a list more can be read
    near = vectors.most_similar(table(spark, sf_dir, "vectors"), k=5, min_score=0.8, reach=vectors.Reach(1.04, 6, 1.02, 4))
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


@query
def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "vectors")
    names = vectors.latest(source, keep=("qualified_name",)).withColumnRenamed("id", "other")
    near = vectors.most_similar(source, k=5)
    return near.join(names, "other").select("id", "place", F.col("qualified_name").alias("similar"), F.round("score", 4).alias("score"))


def _latest_big(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    """Vectors rows over the limit that hold for their id: only narrow columns of all rows are shuffled."""
    rows = table(spark, sf_dir, "vectors").withColumn("at", F.struct(F.coalesce("indexed_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("t"), F.xxhash64("source_code").alias("h")))
    newest = rows.groupBy("id").agg(F.max("at").alias("at"))
    return rows.where(F.length("source_code") > limit).join(newest, ["id", "at"], "left_semi").select("id", "file_path", "source_code").distinct()


def _code_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "code_snippets").select(F.col("snippet_id").cast("string").alias("id"), "file_path", "source_code", "line_start").where(F.length("source_code") > 3000).distinct()


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = pieces.places(_latest_big(spark, sf_dir, 3000), "id")
    b = pieces.places(_code_items(spark, sf_dir), "id", line_col="line_start")
    return a.select(F.lit("vectors").alias("table_name"), "item_key", "line_no").union(b.select(F.lit("code_snippets"), "item_key", "line_no")).distinct()


@query
def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = pieces.pieces(_latest_big(spark, sf_dir, 3000), "id").withColumn("table_name", F.lit("vectors"))
    b = pieces.pieces(_code_items(spark, sf_dir), "id", line_col="line_start").withColumn("table_name", F.lit("code_snippets"))
    return a.unionByName(b)


@query
def p4_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, item_key, pieces_fit, digest): each item put together again from its pieces, without their overlaps."""
    rows = p4_pieces(spark, sf_dir).withColumn("end", F.col("start") + F.length("text"))
    before = F.coalesce(F.lag("end").over(Window.partitionBy("table_name", "item_key").orderBy("piece")), F.lit(0))
    own = rows.withColumn("own", F.substr("text", before - F.col("start") + 1))
    whole = own.groupBy("table_name", "item_key").agg(F.max(F.length("text")).alias("longest"), F.transform(F.array_sort(F.collect_list(F.struct("piece", "own"))), lambda s: s["own"]).alias("parts"))
    return whole.select("table_name", "item_key", (F.col("longest") <= 3000).alias("pieces_fit"), F.md5(F.array_join("parts", "")).alias("digest"))


@query
def p9_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(documents, overfull, divided, gaps): documents placed, containers over the capacity, texts divided without need, and texts whose parts leave a token out or twice."""
    rows = stage(packing.pack(table(spark, sf_dir, "documents")))
    overfull = rows.groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.coalesce(F.sum((F.col("n") > 2048).cast("int")), F.lit(0)).alias("overfull"))
    each = rows.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"))
    each = each.agg(F.count("*").alias("documents"), F.coalesce(F.sum(((F.col("n") <= 2048) & (F.col("parts") > 1)).cast("int")), F.lit(0)).alias("divided"), F.coalesce(F.sum((F.col("n") != F.col("end")).cast("int")), F.lit(0)).alias("gaps"))
    return each.crossJoin(overfull).select("documents", "overfull", "divided", "gaps")  # one row each


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.pairs(table(spark, sf_dir, "result_items")).select("project", "qualified_name")


@query
def p7_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.pairs(table(spark, sf_dir, "result_items"))


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.invalid(table(spark, sf_dir, "code_snippets"))


@query
def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.rates(table(spark, sf_dir, "code_snippets"))


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origin.foreign(table(spark, sf_dir, "vectors"))


@query
def p2_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origin.judged(table(spark, sf_dir, "vectors"))


_VECTORS = """latest AS (SELECT id, embedding FROM (SELECT id, embedding, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) AS r FROM vectors WHERE id IS NOT NULL) WHERE r = 1),
unit AS (SELECT id, CAST(embedding AS DOUBLE[96]) AS e FROM latest WHERE len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pair AS (SELECT a.id AS a, b.id AS b, array_cosine_similarity(a.e, b.e) AS s FROM unit a JOIN unit b ON a.id < b.id WHERE array_cosine_similarity(a.e, b.e) >= 0.8)"""

ORACLES["p1_found"] = f"""WITH RECURSIVE {_VECTORS},
sets AS (SELECT DISTINCT id, list_sort(list_distinct(list_filter(members, lambda m: m IS NOT NULL))) AS m FROM communities WHERE id IS NOT NULL AND len(list_filter(members, lambda m: m IS NOT NULL)) > 0),
member AS (SELECT id, len(m) AS n, unnest(m) AS x FROM sets), common AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS n, any_value(b.n) AS k, count(*) AS c FROM member a JOIN member b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id),
link AS (SELECT 'vector' AS kind, a, b FROM pair UNION ALL SELECT 'community', a, b FROM common WHERE 2 * c >= n + k - c),
way AS (SELECT kind, a, b FROM link UNION ALL SELECT kind, b, a FROM link),
reach AS (SELECT kind, a, b FROM way UNION SELECT r.kind, r.a, w.b FROM reach r JOIN way w ON w.kind = r.kind AND w.a = r.b),
least AS (SELECT kind, b AS member_key, least(min(a), b) AS cluster_key FROM reach GROUP BY kind, b),
big AS (SELECT kind, cluster_key FROM least GROUP BY kind, cluster_key HAVING count(*) >= 3)
SELECT l.kind, l.cluster_key, l.member_key FROM least l JOIN big USING (kind, cluster_key) WHERE l.cluster_key <> l.member_key"""

ORACLES["p6_found"] = f"""WITH {_VECTORS}, way AS (SELECT a, b, s FROM pair UNION ALL SELECT b, a, s FROM pair),
near AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM way) WHERE r <= 5)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM near"""

ORACLES["p10_found"] = """WITH w AS (SELECT doc_id, md5_number(substr(text, i, 200)) AS h FROM documents, unnest(generate_series(1, length(text) - 199)) AS t(i) WHERE length(text) >= 200),
twice AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)) SELECT DISTINCT doc_id FROM w JOIN twice USING (h)"""

ORACLES["p10_spans"] = """WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n, min(doc_id) OVER (PARTITION BY text) AS rep, count(*) OVER (PARTITION BY text) AS same FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 200),
w AS (SELECT doc_id, i, md5_number(substr(text, i, 200)) AS h FROM d, unnest(generate_series(1, n - 199)) AS t(i) WHERE doc_id = rep),
twice AS (SELECT h, min(doc_id) AS first FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)), hit AS (SELECT doc_id, i, h, first FROM w JOIN twice USING (h)),
runs AS (SELECT doc_id, i, sum(CASE WHEN i - before <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT DISTINCT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (SELECT DISTINCT doc_id, i FROM hit))),
span AS (SELECT doc_id, run, min(i) - 1 AS a, max(i) + 199 AS z FROM runs GROUP BY doc_id, run),
spans AS (SELECT doc_id, string_agg(a || '-' || z, ',' ORDER BY a) AS spans, sum(z - a) AS shared FROM span GROUP BY doc_id),
pairs AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM (SELECT DISTINCT doc_id, h FROM hit) x JOIN (SELECT DISTINCT doc_id, h FROM hit) y ON x.h = y.h AND x.doc_id <> y.doc_id),
links AS (SELECT a AS doc_id, count(*) AS links FROM pairs GROUP BY a),
reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b), least AS (SELECT a AS doc_id, least(a, min(b)) AS cluster FROM reach GROUP BY a)
SELECT d.doc_id, CAST(d.n AS INTEGER) AS n_chars, CASE WHEN d.same > 1 THEN '0-' || d.n ELSE s.spans END AS spans, CAST(CASE WHEN d.same > 1 THEN d.n ELSE s.shared END AS INTEGER) AS shared_chars,
round(CASE WHEN d.same > 1 THEN 1.0 ELSE CAST(s.shared AS DOUBLE) / d.n END, 6) AS share, coalesce(l.cluster, d.rep) AS cluster, coalesce(k.links, 0) AS links
FROM d LEFT JOIN spans s ON s.doc_id = d.rep LEFT JOIN least l ON l.doc_id = d.rep LEFT JOIN links k ON k.doc_id = d.rep WHERE d.same > 1 OR s.doc_id IS NOT NULL"""

ORACLES["p1_clusters"] = ORACLES["p1_found"].replace("SELECT l.kind, l.cluster_key, l.member_key FROM least l JOIN big USING (kind, cluster_key) WHERE l.cluster_key <> l.member_key", """, every AS (SELECT l.kind, l.cluster_key, l.member_key FROM least l JOIN big USING (kind, cluster_key)), size AS (SELECT kind, cluster_key, count(*) AS size FROM every GROUP BY ALL),
vectors_mean AS (SELECT a.kind, a.cluster_key, a.member_key, round(avg(array_cosine_similarity(u.e, v.e)), 6) AS mean FROM every a JOIN every b ON a.kind = 'vector' AND b.kind = 'vector' AND a.cluster_key = b.cluster_key AND a.member_key <> b.member_key JOIN unit u ON u.id = a.member_key JOIN unit v ON v.id = b.member_key GROUP BY ALL),
often AS (SELECT e.cluster_key, m.x, count(*) AS seen FROM every e JOIN member m ON m.id = e.member_key WHERE e.kind = 'community' GROUP BY ALL),
sets_mean AS (SELECT e.kind, e.cluster_key, e.member_key, round(avg(o.seen) / any_value(s.size), 9) AS mean FROM every e JOIN member m ON e.kind = 'community' AND m.id = e.member_key JOIN often o ON o.cluster_key = e.cluster_key AND o.x = m.x JOIN size s ON s.kind = e.kind AND s.cluster_key = e.cluster_key GROUP BY ALL),
mean AS (SELECT * FROM vectors_mean UNION ALL SELECT * FROM sets_mean), placed AS (SELECT *, row_number() OVER (PARTITION BY kind, cluster_key ORDER BY mean DESC, member_key) AS place FROM mean)
SELECT p.kind, p.cluster_key, s.size, round(avg(mean), 4) AS cohesion, string_agg(member_key, ',' ORDER BY place) FILTER (WHERE place <= 3) AS medoids FROM placed p JOIN size s ON s.kind = p.kind AND s.cluster_key = p.cluster_key GROUP BY p.kind, p.cluster_key, s.size""")

_BIG = """big AS (SELECT 'vectors' AS table_name, id AS item_key, source_code FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(indexed_at, TIMESTAMP '0001-01-01') DESC) AS r FROM vectors WHERE id IS NOT NULL) WHERE r = 1 AND length(source_code) > 3000
UNION SELECT 'code_snippets', CAST(snippet_id AS VARCHAR), source_code FROM code_snippets WHERE length(source_code) > 3000)"""
ORACLES["p4_rejoined"] = f"WITH {_BIG} SELECT table_name, item_key, true AS pieces_fit, md5(source_code) AS digest FROM big"

ORACLES["p9_summary"] = "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS divided, CAST(0 AS BIGINT) AS gaps FROM documents WHERE doc_id IS NOT NULL"
