"""Queries of readers and sinks: texts are written from the tables into the shared folder, read back and parsed."""

from __future__ import annotations

from pyspark.sql import functions as F

from metrolith.functions.series import event_series
from metrolith.operators import bars as br
from metrolith.operators import decode as dc
from metrolith.operators import results as rs
from metrolith.queries.bars import BTS, _bts
from metrolith.queries.dealt import table
from metrolith.queries.decoding import _IBI, _SEG, _SST, _WALK, NAMES, _small_states, _symbols, _walk
from metrolith.queries.signal import SER
from metrolith.session import Workspace
from metrolith.sources import files as src
from metrolith.sources import sinks


def _read(spark, label, rows):
    """Lines (file, line, value) written as one text file a file, and read: file, line_no, value."""
    root = Workspace(spark, label).root
    rows.repartition("file").sortWithinPartitions("file", "line").select("file", "value").write.partitionBy("file").text(root)
    lines = src.text_files(spark, f"{root}/*/*.txt")
    return lines.select(F.regexp_extract("path", "file=([^/]+)/", 1).cast("long").alias("file"), "line_no", "value")


def listed_files(spark, d):
    """Files of a list, numbered in its order."""
    root = Workspace(spark, "lists").root
    p = table(spark, d, "events").select((F.col("user_id") * 7919 % 10007).alias("k"), F.concat(F.when(F.col("user_id") % 3 == 0, "/music/").otherwise(""), F.lit("audio/u"), F.col("user_id"), F.lit(".wav")).alias("value")).distinct()
    p.union(p.where("k % 5 = 0")).orderBy("k", "value").coalesce(1).select("value").write.text(f"{root}/set.lab")
    return src.list_files(spark, f"{root}/set.lab", "/data").select("file_id", "path", "dataset")


def section_parse(spark, d):
    """A file a region: the numbers of its nations."""
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("file")).agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda x: x.cast("string"))).alias("value"))
    return src.parse_sections(_read(spark, "section", n.withColumn("line", F.lit(1)))).select("file", "pos", "section")


def bpm_parse(spark, d):
    """A file a nation: two numbers a supplier."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("file"), F.col("s_suppkey").alias("line"), F.concat_ws(" ", "s_acctbal", "s_suppkey").alias("value"))
    return src.parse_numbers(_read(spark, "bpm", s)).select("file", "line_no", F.col("numbers")[0].alias("a"), F.col("numbers")[1].alias("b"))


def onsets_parse(spark, d):
    """A file a kind of event: its values in order."""
    e = table(spark, d, "events").select(F.array_position(F.array(*[F.lit(n) for _, n in NAMES]), F.col("event_type")).alias("file"), F.col("event_id").alias("line"), F.col("value").cast("string").alias("value"))
    return src.parse_numbers(_read(spark, "onsets", e)).select("file", F.col("line_no").cast("long").alias("line_no"), F.col("numbers")[0].alias("onset"))


def rhythm_parse(spark, d):
    """A file a nation: its name, then the region's."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    both = n.select(F.col("n_nationkey").alias("file"), F.explode(F.array(F.struct(F.lit(1).alias("line"), F.concat("n_name", F.lit(" more words")).alias("value")), F.struct(F.lit(2).alias("line"), F.col("r_name").alias("value")))).alias("x")).select("file", "x.*")
    return src.first_word(_read(spark, "rhythm", both)).select("file", "name")


def dancestyle_parse(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("file"), F.lit(1).alias("line"), F.concat("r_name", F.lit("\tx")).alias("value"))
    return src.first_word(_read(spark, "style", r)).select("file", "name")


def annotation_paths(spark, d):
    """Where files' beats would lie, and whether there are any."""
    f = table(spark, d, "file_list").select("file_id", F.concat(F.lit("/m/audio/"), "file_id", F.lit(".flac")).alias("path"))
    present = table(spark, d, "beats").where("file_id is not null").select(F.concat(F.lit("/m/annotations/beats/"), "file_id", F.lit(".beats")).alias("path")).distinct()
    missing = src.missing_annotations(f, present, "beats").select("file_id", F.lit(True).alias("m"))
    return f.withColumn("annotation", src.annotation_path(F.col("path"), "beats")).join(missing, "file_id", "left").select("file_id", "annotation", F.coalesce("m", F.lit(False)).alias("missing"))


def meters_default(spark, d):
    return src.meters_of(table(spark, d, "file_list"), table(spark, d, "meters"))


def _two(spark, d):
    s = event_series(table(spark, d, "events"))
    return s.select("file_id", "frame", F.explode(F.array(F.struct(F.lit(1).alias("dim"), F.col("x").alias("value")), F.struct(F.lit(2).alias("dim"), (F.col("x") / 3).alias("value")))).alias("f")).select("file_id", "frame", "f.*")


def activation_files(spark, d):
    """Two features a frame, written with their header and read back."""
    root = Workspace(spark, "activations").root
    sinks.activation_text(_two(spark, d), 50.0).write.partitionBy("file_id").option("lineSep", "\n\n").text(root)
    texts = spark.read.text(f"{root}/*/*.txt", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "file_id=(\\d+)", 1).cast("long").alias("file_id"), "value")
    return src.parse_activations(texts)


def cached_features(spark, d):
    """Two features, one of them from the cache where it has the file; frames that both have."""
    s = event_series(table(spark, d, "events"))
    cache = s.where("file_id % 2 = 0").select("file_id", F.lit("a").alias("feat_type"), "frame", (F.col("x") + 1).alias("y")).unionByName(s.where("frame <= 30").select("file_id", F.lit("b").alias("feat_type"), "frame", (F.col("x") * 2).alias("y")))
    return src.load_features(cache, ["a", "b"], lambda name: s.select("file_id", "frame", (F.col("x") if name == "a" else F.lit(0.0)).alias("y")))


def saved_tables(spark, d):
    """A clustering and its counts, saved and loaded."""
    root = Workspace(spark, "tables").root
    b = table(spark, d, "bars").where("bar2cluster is not null").select("bar_id", "bar2cluster").distinct()
    sinks.save_tables({"bar2cluster": b, "rhythms": table(spark, d, "rhythms")}, root)
    t = sinks.load_tables(spark, root, ["bar2cluster", "rhythms"])
    return t["bar2cluster"].join(t["rhythms"], F.col("bar2cluster") == F.col("rhythm_id")).groupBy("rhythm_id", "num", "den").agg(F.count("*").alias("bars"))


def fold_lists(spark, d):
    """Lists of a cross-validation, written and read."""
    root = Workspace(spark, "folds").root
    f = table(spark, d, "file_list").select(F.concat(F.lit("u"), "file_id", F.lit(".wav")).alias("value"), (F.col("file_id") % 3 + 1).alias("k"))
    for k in (1, 2, 3):
        f.where(F.col("k") == k).coalesce(1).select("value").write.text(f"{root}/set-fold{k}.lab")
    return src.read_fold_lists(spark, root)


def constraint_scan(spark, d):
    """Annotated beats as files, read as constraints on the states of a small model."""
    b = _bts(spark, d).withColumn("t", F.col("t") * 0.5)
    rows = b.select((F.col("file_id") % 7).alias("file"), (F.col("file_id") * 100_000 + F.col("beat_idx")).alias("line"), F.concat(F.col("t").cast("string"), F.lit("\t"), "file_id", F.lit("."), "beat_no").alias("value"))
    beats = src.parse_beats(_read(spark, "constraints", rows)).select(F.col("bar").alias("file_id"), F.col("line_no").alias("beat_idx"), "t", "beat_no")
    return dc.constraint_states(beats, _small_states(spark), 0.1)


def saved_results(spark, d):
    """All results as text files, read back: kind, file_id, line_no, value."""
    root = Workspace(spark, "results").root
    beats = _bts(spark, d).select("file_id", F.col("beat_idx").alias("frame"), F.floor(F.col("t") * 86400 + 1e-6).cast("double").alias("t"), "beat_no")
    path = _walk(spark, d).select("file_id", "frame", (F.col("n") * 60.0 / (10 * 0.02)).alias("bpm"), (F.lit(3) + F.col("file_id") % 2).cast("int").alias("num"), F.lit(4).alias("den"))
    path = path.join(_symbols(spark, d), ["file_id", "frame"])
    names = spark.createDataFrame(NAMES, "pattern int, name string")
    kinds = frozenset({"beats", "downbeats", "median_tempo", "tempo", "meter", "rhythm"})
    sinks.save_results(beats, path, names, 0.02, root, kinds)
    return sinks.load_results(spark, root, kinds)


def decoded_path(spark, d):
    """States of a path with position and tempo; states of no pattern (silence) are left out."""
    states = _small_states(spark)
    paths = event_series(table(spark, d, "events")).select("file_id", "frame", (F.floor(F.col("x") * 7) % 330 + 1).cast("int").alias("state"))
    patterns = states.groupBy("pattern").agg(F.first("n_beats").alias("num")).withColumn("den", F.lit(4))
    return rs.decoded_states(paths, states, patterns).select("file_id", "frame", "pattern", F.round("position", 9).alias("position"), F.round("bpm", 9).alias("bpm"), "num")


def usable_beats(spark, d):
    """Beats of files with several downbeats, without the last one of files whose frames end at or before it."""
    b = br.dense_beats(table(spark, d, "beats").where("t >= 0 and t < 100000"))
    frames = table(spark, d, "frames").where("t is not null and act is not null").groupBy("file_id").agg((F.floor(F.max("t") / 0.02) + 1).cast("long").alias("frame"))
    return br.beats_within(b, frames, 0.02).join(br.files_with_bars(b), "file_id", "left_semi").select("file_id", "beat_idx")


_EV = "['click', 'error', 'purchase', 'signup', 'view']"
_DB = """db AS (SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY i, t, beat_no) AS BIGINT) AS beat_idx, t, beat_no FROM (SELECT DISTINCT file_id, beat_idx AS i, t, beat_no FROM beats WHERE file_id IS NOT NULL AND t IS NOT NULL AND beat_no IS NOT NULL AND t >= 0 AND t < 100000))"""

ORACLES = {
    "listed_files": """WITH p AS (SELECT DISTINCT user_id * 7919 % 10007 AS k, CASE WHEN user_id % 3 = 0 THEN '/music/' ELSE '/data/' END || 'audio/u' || user_id || '.wav' AS path, CASE WHEN user_id % 3 = 0 THEN '/music/' ELSE '' END || 'audio/u' || user_id || '.wav' AS v FROM events)
SELECT row_number() OVER (ORDER BY k, v) AS file_id, path, 'set' AS dataset FROM p""",
    "section_parse": "SELECT CAST(n_regionkey AS BIGINT) AS file, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS pos, n_nationkey AS section FROM nation",
    "bpm_parse": "SELECT CAST(s_nationkey AS BIGINT) AS file, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) AS line_no, s_acctbal AS a, CAST(s_suppkey AS DOUBLE) AS b FROM supplier",
    "onsets_parse": f"SELECT CAST(list_position({_EV}, event_type) AS BIGINT) AS file, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS line_no, value AS onset FROM events",
    "rhythm_parse": "SELECT CAST(n_nationkey AS BIGINT) AS file, string_split(n_name, ' ')[1] AS name FROM nation",
    "dancestyle_parse": "SELECT CAST(r_regionkey AS BIGINT) AS file, string_split(r_name, ' ')[1] AS name FROM region",
    "annotation_paths": "SELECT file_id, '/m/annotations/beats/' || file_id || '.beats' AS annotation, file_id NOT IN (SELECT file_id FROM beats WHERE file_id IS NOT NULL) AS missing FROM file_list",
    "meters_default": "WITH m AS (SELECT file_id, num, coalesce(nullif(den, 0), 4) AS den FROM meters WHERE num IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY section_no, num, coalesce(nullif(den, 0), 4)) = 1) SELECT f.file_id, coalesce(m.num, 4) AS num, coalesce(m.den, 4) AS den FROM (SELECT DISTINCT file_id FROM file_list) f LEFT JOIN m USING (file_id)",
    "activation_files": f"WITH {SER} SELECT file_id, 50.0::DOUBLE AS fps, frame, CAST(k.v AS INTEGER) AS dim, CASE WHEN k.v = 1 THEN x ELSE x / 3 END AS value FROM ser CROSS JOIN (VALUES (1), (2)) k(v)",
    "cached_features": f"WITH {SER} SELECT file_id, frame, CAST(k.v AS INTEGER) AS dim, CASE WHEN k.v = 2 THEN x * 2 WHEN file_id % 2 = 0 THEN x + 1 ELSE x END AS value FROM ser CROSS JOIN (VALUES (1), (2)) k(v) WHERE frame <= 30",
    "saved_tables": "SELECT rhythm_id, num, den, count(*) AS bars FROM (SELECT DISTINCT bar_id, bar2cluster FROM bars) JOIN rhythms ON bar2cluster = rhythm_id GROUP BY ALL",
    "fold_lists": "SELECT 'u' || file_id || '.wav' AS path, CAST(file_id % 3 + 1 AS INTEGER) AS fold FROM file_list",
    "constraint_scan": f"WITH {BTS}, {_SST}, b2 AS (SELECT file_id, beat_idx, t * 0.5::DOUBLE AS t, beat_no FROM bts), {_IBI.format(src='b2')} SELECT file_id, CAST(floor(t / 0.1::DOUBLE) AS BIGINT) + 1 AS frame, state FROM ib JOIN st ON st.z % st.b + 1 = ib.beat_no AND abs(st.q - st.z) <= 0.1::DOUBLE WHERE ibi IS NULL OR abs(ibi / (st.n * 0.1::DOUBLE) - 1) <= 0.4::DOUBLE",
    "saved_results": f"""WITH {_WALK.replace('WITH ', '')}, {_SEG}, {BTS.replace(SER + ', ', '')}, bt AS (SELECT file_id, beat_idx, floor(t * 86400 + 1e-6::DOUBLE) AS t, beat_no FROM bts), sq AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY f) AS seg FROM sg)
SELECT 'beats' AS kind, file_id, row_number() OVER (PARTITION BY file_id ORDER BY beat_idx) AS line_no, printf('%.3f', t) || chr(9) || beat_no AS value FROM bt
UNION ALL SELECT 'downbeats', file_id, row_number() OVER (PARTITION BY file_id ORDER BY beat_idx), printf('%.3f', t) FROM bt WHERE beat_no = 1
UNION ALL SELECT 'median_tempo', file_id, 1, CASE WHEN m = floor(m) THEN CAST(CAST(m AS BIGINT) AS VARCHAR) ELSE printf('%e', m) END FROM (SELECT file_id, quantile_cont(n * 60.0::DOUBLE / 0.2::DOUBLE, 0.5) AS m FROM wk GROUP BY file_id)
UNION ALL SELECT 'tempo', file_id, frame, printf('%.2f', (frame - 1) * 0.02::DOUBLE) || ',' || printf('%.2f', n * 60.0::DOUBLE / 0.2::DOUBLE) FROM wk
UNION ALL SELECT DISTINCT 'meter', file_id, 1, (3 + file_id % 2) || '/4' FROM wk
UNION ALL SELECT 'rhythm', file_id, seg, printf('%3.2f', (greatest(f - 1, 1) - 1) * 0.02::DOUBLE) || chr(9) || printf('%3.2f', (l - 1) * 0.02::DOUBLE) || chr(9) || {_EV}[pattern] FROM sq""",
    "decoded_path": f"WITH {SER}, {_SST} SELECT file_id, frame, pattern, round(k * (b / 4.0::DOUBLE) / (n * b) + 1, 9) AS position, round(60 / (n * 0.1::DOUBLE), 9) AS bpm, b AS num FROM (SELECT file_id, frame, CAST(floor(x * 7) AS BIGINT) % 330 + 1 AS s FROM ser) JOIN st ON st.state = s",
    "usable_beats": f"WITH {_DB}, e AS (SELECT file_id, (CAST(floor(max(t) / 0.02::DOUBLE) AS BIGINT) + 1) * 0.02::DOUBLE AS e FROM frames WHERE t IS NOT NULL AND act IS NOT NULL GROUP BY 1), w AS (SELECT file_id FROM db WHERE beat_no = 1 GROUP BY 1 HAVING count(*) > 1), l AS (SELECT file_id, max(beat_idx) AS k, max_by(t, beat_idx) AS t FROM db GROUP BY 1), c AS (SELECT file_id, k FROM l JOIN e USING (file_id) WHERE e <= l.t) SELECT file_id, beat_idx FROM db WHERE file_id IN (FROM w) AND NOT EXISTS (FROM c WHERE c.file_id = db.file_id AND c.k = db.beat_idx)",
}

QUERIES = {
    f.__name__: f
    for f in (
        listed_files, section_parse, bpm_parse, onsets_parse, rhythm_parse, dancestyle_parse, annotation_paths, meters_default, activation_files, cached_features, saved_tables, fold_lists, constraint_scan, saved_results, decoded_path, usable_beats,
    )
}
