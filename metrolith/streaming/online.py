"""Online decoding: the forward filter as a keyed stream operator, and windowed features of late readings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from metrolith.operators.decode import Columns, Model, _plain, forward

_OUT = "file_id long, frame long, state int, p double"


def near_states(states: DataFrame, max_shift: int) -> np.ndarray:
    """For each state of a 2015 space, those up to ``max_shift`` positions before and after it at its tempo: states x (2 max_shift + 1), from 0."""
    s = states.orderBy("state").select("first", "pos_idx", "frames_per_beat", "n_beats").toPandas()
    size = (s.frames_per_beat * s.n_beats).to_numpy()[:, None]
    return s["first"].to_numpy()[:, None] + (s.pos_idx.to_numpy()[:, None] + np.arange(-max_shift, max_shift + 1)) % size


def next_state(model: Model, a: np.ndarray, before: int, near: np.ndarray) -> int:
    """The likeliest of the states that follow one, and of those near them; the likeliest of all where none has any chance."""
    lo, hi = np.searchsorted(model.by_source, [before, before + 1])
    found = np.unique(near[model.dst[model.from_source[lo:hi]]])
    return int(found[a[found].argmax()]) if len(found) and a[found].max() > 0 else int(a.argmax())


def online_forward(frames: DataFrame, model: Model, floor: float = 1e-7, columns: Columns = _plain, near: np.ndarray | None = None, update_interval: int = 200) -> DataFrame:
    """file_id, frame, state, p of a stream of (file_id, frame, lik), or of (file_id, frame, x) with ``columns`` of x, given the frames so far.

    The state is the likeliest one; with ``near`` (of ``near_states``) it is chosen among those that follow the one before,
    and anew every ``update_interval`` frames. Kept of a file are its chances, last frame and last state. Frames must arrive in
    order between batches; those not after the last one are dropped, frames that are missing are passed over with equal
    likelihoods. Likelihoods are at least ``floor``.
    """
    value = "x" if "x" in frames.columns else "lik"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            chances, last, chosen = state.get
            a = np.array(chances)
        else:
            a, last, chosen = model.init.astype(float), 0, -1
        rows = pd.concat(list(batches)).sort_values("frame").drop_duplicates("frame")
        rows = rows[rows.frame > last]
        out = []
        for frame, v in zip(rows.frame.tolist(), rows[value].tolist()):
            lik = np.maximum(np.nan_to_num(columns(np.array(v, float)[None])), floor)
            if last:
                for _ in range(frame - last - 1):
                    b = forward(model, np.ones(lik.shape), a)[0]
                    if np.array_equal(a, b):
                        break  # it will not change any more
                    a = b
            a = forward(model, lik, a)[0]
            follow = near is not None and chosen >= 0 and frame == last + 1 and (frame - 1) % update_interval
            chosen = next_state(model, a, chosen, near) if follow else int(a.argmax())
            out.append((key[0], frame, chosen + 1, float(a[chosen])))
            last = frame
        state.update((a.tolist(), int(last), int(chosen)))
        yield pd.DataFrame(out, columns=["file_id", "frame", "state", "p"])

    return frames.select("file_id", "frame", value).groupBy("file_id").applyInPandasWithState(step, _OUT, "chances array<double>, last long, chosen int", "append", GroupStateTimeout.NoTimeout)


def windowed_means(readings: DataFrame, period: str, lateness: str, time: str = "arrived") -> DataFrame:
    """Mean and number of values per file and period of event time; readings later than ``lateness`` are dropped.

    Timestamps without a zone are read as UTC, as watermarks need one with a zone.
    """
    at = F.col(time).cast("timestamp")
    return readings.withColumn("_at", at).withWatermark("_at", lateness).groupBy("file_id", F.window("_at", period).alias("w")).agg(F.avg("act").alias("value"), F.count("*").alias("n")).select("file_id", F.col("w.start").alias("start"), "value", "n")
