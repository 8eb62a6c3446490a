"""Queries of the training-data problems (3, 4, 5, 7, 8, 9) over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith.llm import clusters, mojibake, overlap, packing, splits, tokens
from metrolith.session import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.related_files(table(spark, d, "file_list"), table(spark, d, "bars"), Workspace(spark, "p3"))


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(table(spark, d, "file_list"), table(spark, d, "bars"), table(spark, d, "meters"), Workspace(spark, "p3"))


def p3_bars(spark: SparkSession, d: str) -> DataFrame:
    return splits.bar_splits(table(spark, d, "bars"), p3_splits(spark, d))


def p3_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels (data sets and meters) with their files, and whether each split has its share of them: within a tenth, or 1.5 files, or half of the largest group of related files."""
    files, split = table(spark, d, "file_list"), p3_splits(spark, d)
    n = F.count("*")
    groups = split.groupBy("component").agg(n.alias("size"))
    part = splits.file_labels(files.select("file_id", "dataset").join(split, "file_id"), table(spark, d, "meters")).join(split, "file_id")
    every = part.groupBy("label").agg(n.alias("files"), *[F.sum((F.col("split") == s).cast("int")).alias(s) for s in splits.PROPORTIONS])
    most = groups.agg(F.max("size").alias("most"))
    even = [F.abs(F.col(s) - F.col("files") * p) <= F.greatest(F.lit(1.5), F.col("files") * p * 0.1, F.col("most") * 0.5) for s, p in splits.PROPORTIONS.items()]
    return every.crossJoin(F.broadcast(most)).select("label", "files", (even[0] & even[1] & even[2]).alias("even"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of related files and files alone, with their size and in how many splits they are."""
    return p3_splits(spark, d).groupBy("component").agg(F.count("*").alias("files"), F.count_distinct("split").alias("splits"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.cluster_bars(table(spark, d, "bars"), Workspace(spark, "p4")).select("bar_id", "cluster_bar_id")


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    bars = table(spark, d, "bars")
    return clusters.describe_clusters(clusters.cluster_bars(bars, Workspace(spark, "p4")), bars, table(spark, d, "rhythms"))


def p4_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Clusters without their exemplars."""
    return p4_clusters(spark, d).select("cluster_bar_id", "size", "rhythm_id", "num", "den", F.size("exemplars").alias("exemplars"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_pairs(table(spark, d, "file_list"), Workspace(spark, "p5"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "file_list"), Workspace(spark, "p5")).withColumn("least_coverage", F.round("least_coverage", 6))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_documents(table(spark, d, "documents"))


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents by language, the characters that their ids decode to, those with ids, and those whose ids decode to another text."""
    docs = table(spark, d, "documents")
    ids = tokens.encode_documents(docs)
    back = tokens.decode_documents(ids).withColumnRenamed("text", "decoded").join(ids.select("doc_id", F.size("ids").alias("n")), "doc_id")
    same = F.coalesce(F.col("text"), F.lit("")) == F.col("decoded")
    return docs.join(back, "doc_id").groupBy("lang").agg(F.count("*").alias("documents"), F.sum(F.length("decoded")).alias("characters"), F.sum((F.col("n") > 0).cast("long")).alias("encoded"), F.sum((~same).cast("long")).alias("changed"))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.token_counts(table(spark, d, "documents")), Workspace(spark, "p8"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers by their number of texts, with their unused tokens."""
    bins = p8_pack(spark, d).groupBy("container").agg(F.count("*").alias("texts"), F.sum("tokens").alias("used"))
    return bins.groupBy("texts").agg(F.count("*").alias("containers"), F.sum(F.lit(packing.CAPACITY) - F.col("used")).alias("unused"))


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """Texts packed, texts of several pieces that alone would fit, containers beyond their capacity, and pairs of containers that could be combined (of those not nearly full)."""
    packed = Workspace(spark, "p8").keep(p8_pack(spark, d))
    texts = packed.groupBy("doc_id").agg(F.sum("tokens").alias("n"), F.count("*").alias("pieces"))
    bins = packed.groupBy("container").agg(F.sum("tokens").alias("used"))
    size = packing.CAPACITY
    open_ = bins.where(F.col("used") < packing.FULL * size).orderBy("used").limit(2).agg(F.count("*").alias("k"), F.coalesce(F.sum("used"), F.lit(0)).alias("two"))
    return (
        texts.agg(F.count("*").alias("texts"), F.sum(((F.col("n") <= size) & (F.col("pieces") > 1)).cast("long")).alias("split_texts"))
        .crossJoin(bins.agg(F.sum((F.col("used") > size).cast("long")).alias("overfull")))
        .crossJoin(open_.select(((F.col("k") == 2) & (F.col("two") <= size)).cast("long").alias("combinable")))
    )


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_documents(table(spark, d, "documents"), Workspace(spark, "p9"))


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored_documents(table(spark, d, "documents"), Workspace(spark, "p9"))


QUERIES = {f.__name__: f for f in (p3_found, p3_splits, p3_bars, p3_labels, p3_groups, p4_found, p4_clusters, p4_sizes, p5_found, p5_report, p7_ids, p7_roundtrip, p8_pack, p8_fill, p8_check, p9_found, p9_restored)}

_NOBODY = "'', 'unknown', 'a n', 'na', 'n a', 'none', 'null', 'nil', 'nan', 'anon', 'anonymous', 'various', 'various artists', 'artists various', 'va', 'a v', 'v a', 'tbd', 'tba', 'tbc', 'unnamed', 'nobody', 'n n', 'nn', 'artist unknown', 'unknown artist', 'missing', 'undefined', 'not available', 'available not', 'diverse', '0', 'x', 'xx', 'xxx'"
_REMARKS = "clean|converted|copy|denoised|edit|final|master|mono|norm|normalised|normalized|remaster|remastered|resampled|stereo|trimmed"

_RELATED = rf"""WITH RECURSIVE k AS (
SELECT file_id, 'p' AS kind, array_to_string(list_sort(list_filter(regexp_split_to_array(lower(strip_accents(performer)), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')), ' ') AS v FROM file_list WHERE performer IS NOT NULL
UNION ALL SELECT file_id, 's', lower(trim(session_id)) FROM file_list WHERE session_id IS NOT NULL
UNION ALL SELECT DISTINCT bar2file, 'b', CAST(bar_id AS VARCHAR) FROM bars WHERE bar2file IS NOT NULL AND bar2file IN (SELECT file_id FROM file_list)),
g AS (SELECT DISTINCT * FROM k WHERE kind = 'b' OR trim(regexp_replace(v, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) NOT IN ({_NOBODY})),
m AS (SELECT kind, v, min(file_id) AS r FROM g GROUP BY ALL HAVING count(DISTINCT file_id) > 1),
e AS (SELECT file_id AS a, r AS b FROM g JOIN m USING (kind, v) WHERE file_id <> r UNION SELECT r, file_id FROM g JOIN m USING (kind, v) WHERE file_id <> r),
c AS (SELECT DISTINCT a AS file_id, a AS root FROM e UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.file_id)"""
_NEAR = (
    """WITH d AS (SELECT DISTINCT bar_id, features_per_bar AS f FROM bars WHERE bar_id IS NOT NULL AND features_per_bar IS NOT NULL),
z AS (SELECT bar_id, len(f) AS n, generate_subscripts(f, 1) AS p, unnest(f) AS x FROM d),
l AS (SELECT bar_id, n, p, ln(x) AS z FROM z WHERE x > 0 AND isfinite(x)),
o AS (SELECT bar_id FROM l GROUP BY bar_id, n HAVING count(*) >= greatest(2, 0.5 * n)),
e AS (SELECT a.bar_id AS a, b.bar_id AS b FROM l a JOIN l b ON a.n = b.n AND a.p = b.p AND a.bar_id <> b.bar_id WHERE a.bar_id IN (FROM o) AND b.bar_id IN (FROM o)
  GROUP BY a.bar_id, b.bar_id, a.n HAVING count(*) >= greatest(2, 0.5 * a.n) AND avg((a.z - b.z) * (a.z - b.z)) - avg(a.z - b.z) * avg(a.z - b.z) <= 0.16::DOUBLE),
m0 AS (SELECT a AS bar, least(a, min(b)) AS m FROM e GROUP BY a),
"""
    + ",\n".join(f"m{i} AS (SELECT e.a AS bar, least(min(p.m), min(q.m)) AS m FROM e JOIN m{i - 1} p ON p.bar = e.b JOIN m{i - 1} q ON q.bar = e.a GROUP BY e.a)" for i in range(1, 6))
)
_NAMED = rf"""WITH a AS (SELECT file_id, lower(strip_accents(regexp_replace(regexp_extract(trim(url_decode(path)), '[^/\\]*$'), '\.[A-Za-z][A-Za-z0-9]{{0,4}}$', ''))) AS s,
  regexp_extract(regexp_replace(lower(lab_fln), '\.lab\s*$', ''), '([a-z]+)[^a-z]*$', 1) AS w FROM file_list WHERE path IS NOT NULL AND lab_fln IS NOT NULL),
b AS (SELECT file_id, CASE WHEN w IN ('train', 'training') THEN 'train' WHEN w IN ('val', 'valid', 'validation', 'dev', 'test', 'testing', 'eval') THEN 'eval' END AS split, list_filter(regexp_split_to_array(s, '[^a-z0-9]+'), lambda x: x <> '') AS t FROM a),
c AS (SELECT file_id, split, CASE WHEN len(t) > 1 AND regexp_full_match(t[1], '[0-9]+') THEN t[2:] WHEN regexp_full_match(t[1], '[0-9]+[a-z]{{3}}.*') THEN list_concat([regexp_replace(t[1], '^[0-9]+', '')], t[2:]) ELSE t END AS t FROM b WHERE split IS NOT NULL),
d AS (SELECT file_id, split, array_to_string(list_filter(t, lambda x: NOT regexp_full_match(x, '(take|mvt|var)[0-9]+|{_REMARKS}|[0-9]+(k|khz|hz|bit|kbps)')), '') AS name,
  array_to_string(list_sort(list_transform(list_filter(t, lambda x: regexp_full_match(x, '(take|mvt|var)[0-9]+')), lambda x: regexp_replace(x, '([a-z])0+([0-9])', '\1\2'))), ' ') AS nums FROM c),
lim AS (SELECT *, CASE WHEN length(name) >= 20 THEN 4 WHEN length(name) >= 15 THEN 3 WHEN length(name) >= 5 THEN 2 WHEN length(name) >= 3 THEN 1 ELSE 0 END AS m FROM d WHERE name <> '')"""
_SAME = """FROM lim x JOIN lim y ON x.split = 'train' AND y.split = 'eval' AND x.nums = y.nums AND abs(length(x.name) - length(y.name)) <= 4 AND damerau_levenshtein(x.name, y.name) <= least(x.m, y.m)"""

ORACLES = {
    "p3_found": f"{_RELATED} SELECT file_id, min(root) AS group_file_id FROM c GROUP BY file_id",
    "p3_groups": f"{_RELATED}, g2 AS (SELECT file_id, min(root) AS g FROM c GROUP BY file_id) SELECT coalesce(g, file_id) AS component, count(*) AS files, CAST(1 AS BIGINT) AS splits FROM (SELECT DISTINCT file_id FROM file_list) LEFT JOIN g2 USING (file_id) GROUP BY 1",
    "p4_sizes": f"""{_NEAR}, v AS (SELECT m, r.rhythm_id, count(*) AS n FROM (SELECT DISTINCT bar_id, bar2cluster FROM bars) b JOIN m5 ON m5.bar = b.bar_id JOIN rhythms r ON r.rhythm_id = b.bar2cluster GROUP BY ALL),
t AS (SELECT m, rhythm_id FROM v QUALIFY row_number() OVER (PARTITION BY m ORDER BY n DESC, rhythm_id) = 1), zz AS (SELECT m, count(*) AS size FROM m5 GROUP BY 1)
SELECT zz.m AS cluster_bar_id, size, t.rhythm_id, num, den, CAST(least(3, size) AS INTEGER) AS exemplars FROM zz LEFT JOIN t USING (m) LEFT JOIN rhythms USING (rhythm_id)""",
    "p4_found": f"{_NEAR} SELECT bar AS bar_id, m AS cluster_bar_id FROM m5",
    "p7_roundtrip": "SELECT lang, count(*) AS documents, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS characters, CAST(count(*) FILTER (text <> '') AS BIGINT) AS encoded, CAST(0 AS BIGINT) AS changed FROM documents GROUP BY lang",
    "p8_check": "SELECT count(*) AS texts, CAST(0 AS BIGINT) AS split_texts, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS combinable FROM documents WHERE text <> ''",
    "p3_labels": """SELECT 'dataset=' || coalesce(lower(trim(dataset)), '?') AS label, count(*) AS files, true AS even FROM file_list GROUP BY 1
UNION ALL SELECT 'meter=' || num, count(DISTINCT file_id), true FROM meters WHERE num BETWEEN 1 AND 32 AND file_id IN (SELECT file_id FROM file_list) GROUP BY 1""",
    "p5_found": f"{_NAMED} SELECT DISTINCT least(x.file_id, y.file_id) AS file_id_a, greatest(x.file_id, y.file_id) AS file_id_b {_SAME}",
    "p5_report": f"""{_NAMED}, o AS (SELECT DISTINCT y.file_id, x.file_id AS other, 1 - damerau_levenshtein(x.name, y.name) / greatest(length(x.name), length(y.name))::DOUBLE AS cover {_SAME} AND x.file_id <> y.file_id),
h AS (SELECT file_id, count(*) AS pairs, min(cover) AS cover FROM o GROUP BY 1),
v AS (SELECT DISTINCT lim.file_id, CASE WHEN w IN ('val', 'valid', 'validation', 'dev') THEN 'val' ELSE 'test' END AS eval_split, lower(trim(dataset)) AS dataset FROM lim JOIN a USING (file_id) JOIN file_list USING (file_id) WHERE split = 'eval')
SELECT eval_split, dataset, count(*) AS entries, count(pairs) AS overlapping, CAST(coalesce(sum(pairs), 0) AS BIGINT) AS pairs, round(min(cover), 6) AS least_coverage FROM v LEFT JOIN h USING (file_id) GROUP BY ALL""",
}
