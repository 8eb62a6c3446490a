"""Queries of the general problems (1, 2, 6) over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith.operators.grid import regular_grid
from metrolith.operators.implausible import implausible
from metrolith.sources.annotations import loaded_beats, loaded_meters, parse_annotations, rejected


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(table(spark, d, "frames"), observed=False).select("file_id", "feat_type", "frame")


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(table(spark, d, "frames")).select("file_id", "feat_type", "frame", F.round("t", 6).alias("t"), F.round("value", 6).alias("value"), "status")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible(table(spark, d, "beats"), table(spark, d, "meters")).select("ann_type", "file_id", "item_no")


def p2_reasons(spark: SparkSession, d: str) -> DataFrame:
    return implausible(table(spark, d, "beats"), table(spark, d, "meters"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return rejected(parse_annotations(table(spark, d, "annotation_lines")))


def p6_beats(spark: SparkSession, d: str) -> DataFrame:
    return loaded_beats(parse_annotations(table(spark, d, "annotation_lines")))


def p6_meters(spark: SparkSession, d: str) -> DataFrame:
    return loaded_meters(parse_annotations(table(spark, d, "annotation_lines")))


_P1_SRC = """
r AS (SELECT file_id, lower(trim(feat_type, ' ' || chr(9) || chr(13) || chr(10) || chr(160))) AS feat_type,
        CASE WHEN frame_length > 0.1 THEN frame_length / 1000.0 ELSE frame_length END AS fl0,
        CASE WHEN isfinite(t) THEN t END AS t, CASE WHEN isfinite(act) THEN act END AS act
      FROM frames WHERE file_id IS NOT NULL AND feat_type IS NOT NULL),
n AS (SELECT *, CASE WHEN fl0 > 0 AND fl0 <= 0.1 THEN fl0 END AS fl FROM r),
m AS (SELECT file_id, feat_type, fl FROM (SELECT file_id, feat_type, fl, row_number() OVER (PARTITION BY file_id, feat_type ORDER BY count(*) DESC, fl) AS k
      FROM n WHERE fl IS NOT NULL GROUP BY file_id, feat_type, fl) WHERE k = 1),
p AS (SELECT n.file_id, n.feat_type, m.fl, CAST(floor(n.t / m.fl) AS BIGINT) + 1 AS frame, n.act
      FROM n JOIN m ON n.file_id = m.file_id AND n.feat_type = m.feat_type WHERE n.t IS NOT NULL),
e AS (SELECT file_id, feat_type, fl, min(frame) AS lo, max(frame) AS hi FROM p GROUP BY ALL),
g AS (SELECT file_id, feat_type, fl, unnest(generate_series(lo, hi)) AS frame FROM e),
o AS (SELECT file_id, feat_type, frame, avg(act) AS value FROM p WHERE act IS NOT NULL GROUP BY ALL)"""

def _either(pattern: str) -> str:
    """A field as it is, or within quotes that enclose it whole."""
    return f'(" *({pattern}) *"|({pattern}))'


_T, _B, _N = r"([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?", r"([0-9]+\.)?0*[1-9][0-9]*", r"0*[1-9][0-9]*"
_P6 = rf"""l AS (SELECT DISTINCT line_id, file_id, line_no, ann_type, CASE WHEN ann_type = 'beats' THEN regexp_replace(trim(raw_line, ' ' || chr(13) || chr(10)), ' *\t *', chr(9), 'g') ELSE regexp_replace(trim(raw_line, ' ' || chr(13) || chr(10)), ' */ *', '/', 'g') END AS s FROM annotation_lines),
f AS (SELECT *, CASE WHEN ann_type = 'beats' THEN regexp_full_match(s, '("[^"]*"|[^"\t]*)(\t("[^"]*"|[^"\t]*))*') ELSE regexp_full_match(s, '("[^"]*"|[^"/]*)(/("[^"]*"|[^"/]*))*') END AS paired,
  len(string_split(regexp_replace(s, '"[^"]*"', 'x', 'g'), CASE WHEN ann_type = 'beats' THEN chr(9) ELSE '/' END)) AS n FROM l),
v AS (SELECT *, CASE WHEN s IS NULL THEN 'columns' WHEN NOT paired THEN 'quoting' WHEN s = '' OR (ann_type = 'beats' AND n <> 2) OR (ann_type <> 'beats' AND n > 2) THEN 'columns'
  WHEN ann_type = 'beats' AND NOT regexp_full_match(s, '{_either(_T)}\t{_either(_B)}') THEN 'value' WHEN ann_type <> 'beats' AND NOT regexp_full_match(s, '{_either(_N)}(/{_either(_N)})?') THEN 'value' END AS reason,
  replace(s, '"', '') AS bare FROM f)"""

#: Cases told without a filter: a beat is stray when none of three beats on either side, at the median period of nine advances there, agrees with it.
_SIDES = ", ".join(f"abs(t - lag(t, {k}) OVER w - (i - lag(i, {k}) OVER w) * pp) <= 0.25 * pp AS c{k}, abs(lead(t, {k}) OVER w - t - (lead(i, {k}) OVER w - i) * pn) <= 0.25 * pn AS d{k}" for k in (1, 2, 3))
_P2 = f"""WITH b AS (SELECT file_id, beat_idx AS i, min(t) AS t FROM beats WHERE file_id IS NOT NULL AND beat_idx IS NOT NULL AND isfinite(t) GROUP BY ALL),
o AS (SELECT file_id, i, t, lag(t) OVER w AS t1, lag(i) OVER w AS i1 FROM b WHERE t >= 0 WINDOW w AS (PARTITION BY file_id ORDER BY i)),
a AS (SELECT *, CASE WHEN t > t1 THEN (t - t1) / (i - i1) END AS adv FROM o),
p AS (SELECT *, median(adv) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) AS pp, median(adv) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN 2 FOLLOWING AND 10 FOLLOWING) AS pn FROM a),
v AS (SELECT file_id, i, t, t1, pp, pn, {_SIDES} FROM p WINDOW w AS (PARTITION BY file_id ORDER BY i)),
s AS (SELECT file_id, i, abs(t - t1) <= 0.1 * coalesce(pp, pn) AS still FROM v WHERE NOT coalesce(c1 OR c2 OR c3, pp IS NULL, false) AND NOT coalesce(d1 OR d2 OR d3, pn IS NULL, false) AND (c1 IS NOT NULL OR d1 IS NOT NULL)),
n AS (SELECT DISTINCT file_id, beat_no FROM beats WHERE beat_no IS NOT NULL), u AS (SELECT file_id, max(beat_no) AS u FROM n WHERE beat_no = 1 OR (beat_no > 1 AND (file_id, beat_no - 1) IN (FROM n)) GROUP BY 1),
m AS (SELECT DISTINCT file_id, section_no, num, den FROM meters WHERE file_id IS NOT NULL AND section_no IS NOT NULL), h AS (SELECT file_id, num, count(DISTINCT section_no) AS n FROM m GROUP BY ALL), q AS (SELECT file_id, sum(n) AS s, max(n) FILTER (num IS NOT NULL) AS top FROM h GROUP BY 1),
f AS (SELECT file_id, any_value(s) AS s, min(num) AS lo, max(num) AS hi FROM h JOIN q USING (file_id) WHERE num IS NOT NULL AND n = top GROUP BY 1),
k AS (SELECT 'beat' AS ann_type, file_id, CAST(i AS BIGINT) AS item_no, CASE WHEN still THEN 'stuck' ELSE 'off_place' END AS reason FROM s UNION ALL SELECT 'beat', file_id, beat_idx, 'negative' FROM beats WHERE t < 0 AND beat_idx IS NOT NULL
UNION ALL SELECT 'beat', b.file_id, beat_idx, CASE WHEN beat_no < 1 THEN 'number_below_1' ELSE 'number_too_high' END FROM beats b LEFT JOIN u USING (file_id) WHERE beat_no < 1 OR beat_no > 2 * u
UNION ALL SELECT 'meter', m.file_id, section_no, CASE WHEN num NOT BETWEEN 1 AND 32 THEN 'num_range' WHEN den NOT IN (1, 2, 4, 8, 16, 32) THEN 'den' ELSE 'num_unlike' END FROM m LEFT JOIN f USING (file_id) WHERE num NOT BETWEEN 1 AND 32 OR den NOT IN (1, 2, 4, 8, 16, 32) OR (s >= 3 AND (num >= 3 * hi OR num * 3 < lo)))"""

ORACLES = {
    "p2_found": f"{_P2} SELECT DISTINCT ann_type, file_id, item_no FROM k",
    "p2_reasons": f"{_P2} SELECT ann_type, file_id, item_no, min(reason) AS reason FROM k GROUP BY ALL",
    "p1_found": f"WITH {_P1_SRC} SELECT g.file_id, g.feat_type, g.frame FROM g ANTI JOIN o ON g.file_id = o.file_id AND g.feat_type = o.feat_type AND g.frame = o.frame",
    "p1_grid": f"""WITH {_P1_SRC},
j AS (SELECT g.file_id, g.feat_type, g.fl, g.frame, o.value FROM g LEFT JOIN o ON g.file_id = o.file_id AND g.feat_type = o.feat_type AND g.frame = o.frame),
k AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS pf, last_value(value IGNORE NULLS) OVER a AS pv,
        first_value(CASE WHEN value IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS nf, first_value(value IGNORE NULLS) OVER b AS nv
      FROM j WINDOW a AS (PARTITION BY file_id, feat_type ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        b AS (PARTITION BY file_id, feat_type ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT file_id, feat_type, frame, round((frame - 1) * fl, 6) AS t,
  round(CASE WHEN value IS NOT NULL THEN value WHEN nf - pf - 1 <= 5 THEN pv + (nv - pv) * (frame - pf) / (nf - pf) END, 6) AS value,
  CASE WHEN value IS NOT NULL THEN 'observed' WHEN pf IS NULL OR nf IS NULL THEN 'edge' WHEN nf - pf - 1 <= 5 THEN 'interpolated' ELSE 'gap' END AS status FROM k""",
    "p6_found": f"WITH {_P6} SELECT DISTINCT line_id, reason FROM v WHERE reason IS NOT NULL",
    "p6_beats": f"WITH {_P6} SELECT DISTINCT line_id, file_id, line_no, CAST(split_part(bare, chr(9), 1) AS DOUBLE) AS t, TRY_CAST(nullif(regexp_extract(split_part(bare, chr(9), 2), '([0-9]+)\\.', 1), '') AS BIGINT) AS bar, TRY_CAST(regexp_extract(split_part(bare, chr(9), 2), '([0-9]+) *$', 1) AS BIGINT) AS beat_no FROM v WHERE reason IS NULL AND ann_type = 'beats'",
    "p6_meters": f"WITH {_P6} SELECT DISTINCT line_id, file_id, line_no, TRY_CAST(trim(split_part(bare, '/', 1)) AS BIGINT) AS num, coalesce(TRY_CAST(nullif(trim(split_part(bare, '/', 2)), '') AS BIGINT), 4) AS den FROM v WHERE reason IS NULL AND ann_type = 'meter'",
}

QUERIES = {f.__name__: f for f in (p1_found, p1_grid, p2_found, p2_reasons, p6_found, p6_beats, p6_meters)}
