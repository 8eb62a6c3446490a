"""Training of a model from annotated files, and decoding of files under a model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrolith.config import Params
from metrolith.operators import bars as br
from metrolith.operators import decode as dc
from metrolith.operators import observation as ob
from metrolith.operators import particles as pf
from metrolith.operators import patterns as pt
from metrolith.operators import results as rs
from metrolith.operators import tempo as tm
from metrolith.operators.decode import Columns
from metrolith.plans import statespace as ss
from metrolith.plans import transitions as tr
from metrolith.session import Workspace
from metrolith.streaming.online import near_states, online_forward


@dataclass
class Tables:
    """A trained model: patterns (with tempo limits), pattern transitions (i, j, p), mixtures of feature vectors (pattern, cell, comp, weight, mean, cov, dims; null for activations) and that of silence (the same without pattern and cell)."""

    patterns: DataFrame
    pr: DataFrame
    gmm: DataFrame | None
    silence: DataFrame | None = None


def _fixed(df: DataFrame) -> DataFrame:
    """A table of a model as it is now: a few rows a pattern, so that decoding does not compute the training again."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def bar_labels(cells: DataFrame, items: DataFrame, grid: DataFrame, p: Params, dataset: str = "set") -> DataFrame:
    """Bars (file_id, beat_idx, meter, num, den, and rhythm where bars go by it) with pattern and name, by ``cluster_type``.

    k-means takes the means of a bar's cells (or of a song's bars), missing ones filled, each feature over its deviation.
    """
    if p.cluster_type == "rhythm":
        if "rhythm" not in items.columns:
            raise ValueError("patterns by rhythm need a rhythm beside each file's meter")
        if not items.groupBy("rhythm").agg(F.count_distinct("num", "den").alias("n")).where("n > 1").isEmpty():
            raise ValueError("each rhythm must have one meter")
    if p.cluster_type != "kmeans":
        return pt.label_clusters(items, p.cluster_type, dataset)
    means = br.impute_cells(br.cell_means(cells.where("value is not null and not isnan(value)")), grid)
    key = ["file_id", "beat_idx"] if p.pattern_scope == "bar" else ["file_id"]
    z = br.zscore_cells(means if p.pattern_scope == "bar" else br.song_average(means)).withColumn("at", F.concat_ws("_", F.lit("x"), "dim", "cell"))
    dims = sorted(r["at"] for r in z.select("at").distinct().collect())
    points = z.groupBy(*key).pivot("at", dims).agg(F.first("value")).join(items.select(*key, "num", "den").distinct(), key)
    found = pt.kmeans_per_meter(points, dims, p.n_clusters, p.dist_cluster, dataset=dataset).select(*key, F.col("pattern").alias("_p"), "name")
    # Patterns without items would leave gaps in the numbers.
    used = [r["_p"] for r in found.select("_p").distinct().orderBy("_p").collect()]
    found = found.withColumn("pattern", F.array_position(F.array(*[F.lit(u) for u in used]), F.col("_p")).cast("int")).drop("_p") if used else found.withColumnRenamed("_p", "pattern")
    return items.join(found, key) if p.pattern_scope == "bar" else pt.song_clusters_to_bars(items, found).join(found.select("pattern", "name").distinct(), "pattern")


def feature_dims(frames: DataFrame) -> list[int]:
    return sorted(r["dim"] for r in frames.where("dim is not null").select("dim").distinct().collect())


def train(frames: DataFrame, beats: DataFrame, meters: DataFrame, p: Params, dataset: str = "set", silent: DataFrame | None = None) -> Tables:
    """A model from frames (file_id, frame, dim, value), dense beats and meters (file_id, num, den, and rhythm for patterns by
    rhythm), with a pattern per meter, per rhythm, for all bars, or per k-means cluster of the bars of a meter.

    ``silent`` has frames of silence (dim, value; file_id and frame as well if there are several features), from which its mixture is fitted.
    """
    usable = br.beats_within(beats, frames, p.frame_length).join(br.files_with_bars(beats), "file_id", "left_semi")
    ws = Workspace(frames.sparkSession, "train")
    full = ws.keep(br.full_bars(usable))  # read for patterns, transitions and mixtures
    grid = meters.select("file_id", br.grid_size(F.col("num"), F.col("den"), p.whole_note_div).alias("cells"))
    cells = br.bar_cells(usable, full, frames, grid, p.frame_length)
    items = full.join(meters, "file_id").select("file_id", "beat_idx", "meter", "num", "den", *(c for c in meters.columns if c == "rhythm"))
    labelled = ws.keep(bar_labels(cells, items, grid, p, dataset))
    ranges = tm.restrict(tm.tempo_range(beats, p.tempo_outlier_percentile), p.min_tempo, p.max_tempo) if p.learn_tempo_ranges else beats.select("file_id").distinct().withColumns({"min_bpm": F.lit(p.min_tempo), "max_bpm": F.lit(p.max_tempo)})
    limits = tm.cluster_tempo(ranges, labelled.select("file_id", F.col("pattern").alias("cluster")))
    shape = labelled.groupBy("pattern").agg(F.first("num").alias("num"), F.first("den").alias("den"), F.max("meter").alias("n_beats"), F.first("name").alias("name"))
    patterns = shape.join(limits.withColumnRenamed("cluster", "pattern"), "pattern").withColumn("bar", F.col("num") / F.col("den"))
    if p.same_tempo_per_meter:
        patterns = tm.same_per_meter(patterns)
    pr = pt.complete_matrix(pt.transition_matrix(labelled, ("beat_idx",)), pt.pattern_prior(labelled))
    gmm = quiet = None
    if p.observation_model == "MOG":
        dims = feature_dims(frames)
        # Vectors take the way of values through the cells.
        vectors = ob.feature_vectors(frames, dims).select("file_id", "frame", F.lit(0).alias("dim"), F.col("x").alias("value"))
        placed = br.bar_cells(usable, full, vectors, grid, p.frame_length).join(labelled.select("file_id", "beat_idx", "pattern"), ["file_id", "beat_idx"])
        gmm = ob.fit_joint_mixtures(placed.select(F.col("pattern").cast("int").alias("pattern"), "cell", F.col("value").alias("x")), ["pattern", "cell"], dims)
    if silent is not None:
        dims = feature_dims(silent)
        if "frame" in silent.columns:
            x = ob.feature_vectors(silent if "file_id" in silent.columns else silent.withColumn("file_id", F.lit(0)), dims)
        elif len(dims) == 1:
            x = silent.where("value is not null and not isnan(value)").select(F.array(F.col("value").cast("double")).alias("x"))
        else:
            raise ValueError("silence of several features needs file_id and frame")
        quiet = ob.fit_joint_mixtures(x.select(F.lit(1).alias("all"), "x"), ["all"], dims).drop("all")
    out = Tables(_fixed(patterns), _fixed(pr), gmm, quiet)
    ws.drop(*ws.kept)
    return out


def observe(frames: DataFrame, t: Tables, p: Params) -> tuple[DataFrame, Columns, int]:
    """(file_id, frame, x) of frames, what makes likelihood columns of x, and the cells of the longest pattern. Activations come as dim 1.

    The columns are those of all cells, pattern by pattern, and one of silence after them.
    """
    rows = ob.beats_in_cells(t.patterns, p.whole_note_div).orderBy("pattern").collect()
    most, count, extra = max(r.cells for r in rows), len(rows), int(p.use_silence_state)
    if p.observation_model == "RNN":
        x = frames.where("dim = 1").select("file_id", "frame", F.array(F.coalesce(F.col("value").cast("double"), F.lit(float("nan")))).alias("x"))
        return x, ob.Activations.of([r.cells for r in rows], most, extra), most
    gmm = t.gmm
    if p.use_silence_state:
        if t.silence is None:
            raise ValueError("a silence state needs frames of silence in training")
        gmm = gmm.unionByName(t.silence.withColumns({"pattern": F.lit(count + 1), "cell": F.lit(1)}).select(gmm.columns))
    dims = list(gmm.first()["dims"])
    x = ob.feature_vectors(frames, dims).select("file_id", "frame", F.coalesce("x", F.array(*[F.lit(float("nan"))] * len(dims))).alias("x"))
    return x, ob.Mixtures.of(gmm, lambda pattern, cell: (pattern - 1) * most + cell - 1, count * most + extra), most


def hidden_model(t: Tables, p: Params, max_cells: int) -> tuple[dc.Model, DataFrame]:
    """The decoder's arrays and the state table."""
    if p.transition_model_type == "2015":
        states = ss.states_2015(t.patterns, p.frame_length, p.n_tempi)
        edges = tr.transitions_2015(states, t.pr, p.tempo_lambda, p.p2s, p.pfs, p.use_silence_state)
        placed = states
    elif p.use_silence_state:
        raise ValueError("the silence state belongs to the 2015 model")
    else:
        states = ss.states_2006(t.patterns, p.frame_length, p.max_positions)
        edges = tr.transitions_2006(t.patterns, t.pr, p.frame_length, p.max_positions, p.pn)
        placed = states.withColumn("position", (F.col("position") - 1) / F.col("positions") * F.col("bar") + 1)
    prior = t.patterns.select("pattern", (1.0 / F.count("*").over(ss.Window.partitionBy(F.lit(1)))).alias("p")) if p.use_meter_prior else None
    cells = ss.state_cells(placed, p.whole_note_div, max_cells)
    if p.use_silence_state:
        last = states.agg((F.max("state") + 1).cast("int").alias("state"))
        extra = t.patterns.agg((F.count("*") * max_cells + 1).cast("int").alias("gmm"))
        cells = cells.unionByName(last.crossJoin(extra).select("state", F.lit(None).cast("int").alias("pattern"), F.lit(1).alias("cell"), "gmm"))
    return dc.model_from_tables(edges, ss.initial_distribution(states, prior, p.use_silence_state), cells), placed


def decode(frames: DataFrame, t: Tables, p: Params) -> tuple[DataFrame, DataFrame]:
    """Beats (file_id, frame, t, beat_no) and the path (file_id, frame, pattern, position, bpm, n_beats, bar, num, den)."""
    seen, columns, most = observe(frames, t, p)
    if p.inference_method == "PF":
        rows = t.patterns.orderBy("pattern").collect()
        pr = [[0.0] * len(rows) for _ in rows]
        for r in t.pr.collect():
            pr[r.i - 1][r.j - 1] = r.p
        pointer = pf.BarPointer.of(rows, pr, p.whole_note_div, p.frame_length)
        path = pf.particle_paths(seen, pointer, p, columns).join(F.broadcast(t.patterns.select("pattern", "n_beats", "bar", "num", "den")), "pattern")
    else:
        model, states = hidden_model(t, p, most)
        states_of = dc.viterbi_paths(seen, model, columns) if p.inference_method == "HMM_viterbi" else dc.forward_best(seen, model, ob.Floored(columns, p.obs_lik_floor)).drop("p")
        path = rs.decoded_states(states_of, states, t.patterns)
    beats = rs.beat_times(path, p.frame_length, p.frame_shift)
    if p.correct_beats:
        last = frames.groupBy("file_id", "frame").agg(F.max_by("value", "dim").alias("x"))
        beats = rs.corrected_beats(beats, last, path, 1.0 / p.whole_note_div, p.frame_length)
    return beats, path


def decode_online(vectors: DataFrame, t: Tables, p: Params) -> DataFrame:
    """file_id, frame, state, p of a stream of (file_id, frame, x), x the features in order (an array): the trajectory of the forward filter."""
    cells = [r.cells for r in ob.beats_in_cells(t.patterns, p.whole_note_div).orderBy("pattern").collect()]
    most, count = max(cells), len(cells)
    columns = ob.Activations.of(cells, most) if p.observation_model == "RNN" else ob.Mixtures.of(t.gmm, lambda pattern, cell: (pattern - 1) * most + cell - 1, count * most)
    model, states = hidden_model(t, p, most)
    near = near_states(states, p.max_shift) if p.transition_model_type == "2015" else None
    return online_forward(vectors, model, p.obs_lik_floor, columns, near, p.update_interval)


def refine(frames: DataFrame, t: Tables, p: Params, rounds: int = 1, only: set[int] | None = None) -> Tables:
    """Viterbi training: mixtures and pattern transitions fitted again to the decoded cells; ``only`` has the patterns whose mixtures are."""
    for _ in range(rounds):
        _, path = decode(frames, t, p)
        cell = (F.floor((F.col("position") - 1) * p.whole_note_div + 1e-9) + 1).cast("int")
        gmm = t.gmm
        if gmm is not None:
            dims = list(gmm.first()["dims"])
            placed = path.select("file_id", "frame", F.col("pattern").cast("int").alias("pattern"), cell.alias("cell")).join(ob.feature_vectors(frames, dims), ["file_id", "frame"])
            again = F.lit(True) if only is None else F.col("pattern").isin(*only)
            new = ob.fit_joint_mixtures(placed.where(again).select("pattern", "cell", "x"), ["pattern", "cell"], dims)
            # Cells that no frame was decoded into keep their mixture.
            gmm = _fixed(new.unionByName(gmm.join(new.select("pattern", "cell").distinct(), ["pattern", "cell"], "left_anti").select(new.columns)))
        runs = rs.segments(path).select("file_id", F.col("seg").alias("bar_no"), "pattern")
        pr = _fixed(pt.complete_matrix(pt.transition_matrix(runs), pt.pattern_prior(runs))) if t.patterns.count() > 1 else t.pr
        t = Tables(t.patterns, pr, gmm, t.silence)
    return t
