import numpy as np
from pyspark.sql import functions as F

from metrolith.operators import decode as dc
from metrolith.streaming.online import online_forward, windowed_means


def test_online_filter_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    n = 3
    a = rng.random((n, n)) + 0.1
    a /= a.sum(1, keepdims=True)
    i, j = np.divmod(np.arange(9), 3)
    model = dc.Model(i, j, a.ravel(), np.full(3, 1 / 3), np.arange(3))
    rows = [(f, k, rng.random(3).tolist()) for f in (1, 2) for k in range(1, 31)]
    df = spark.createDataFrame(rows, "file_id long, frame long, lik array<double>")
    for part in range(3):
        df.where((F.col("frame") > part * 10) & (F.col("frame") <= part * 10 + 10)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = online_forward(stream, model).writeStream.format("memory").queryName("online").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {(r.file_id, r.frame): (r.state, r.p) for r in spark.table("online").collect()}
    want = {(r.file_id, r.frame): (r.state, r.p) for r in dc.forward_best(df, model).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_online_trajectory_moves_like_the_model(spark, tmp_path):
    from metrolith.config import Params
    from metrolith.plans import statespace as ss
    from metrolith.plans import tracker
    from metrolith.streaming.online import near_states

    pr = spark.createDataFrame([(1, 1, 1.0)], "i int, j int, p double")
    t = tracker.Tables(ss.make_patterns(spark, [(1, 4, 4, 4, 1.0, 60.0, 120.0)]), pr, None)
    p = Params(frame_length=0.1, whole_note_div=16, observation_model="RNN", max_shift=1, update_interval=50)
    rng = np.random.default_rng(2)
    rows = [(1, k, [float(0.9 if k % 28 == 5 else 0.05 + 0.1 * rng.random())]) for k in range(1, 121) if k not in (70, 71)]
    spark.createDataFrame(rows, "file_id long, frame long, x array<double>").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("file_id long, frame long, x array<double>").parquet(str(tmp_path / "in"))
    q = tracker.decode_online(stream, t, p).writeStream.format("memory").queryName("way").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {r.frame: r.state - 1 for r in spark.table("way").collect()}
    model, states = tracker.hidden_model(t, p, 16)
    near = near_states(states, 1)
    assert len(got) == 118
    for k in range(2, 121):
        if k in got and k - 1 in got and (k - 1) % 50:
            assert got[k] in near[model.dst[model.src == got[k - 1]]], k
    free = {r.frame: r.state - 1 for r in dc.forward_best(spark.createDataFrame(rows[:69], "file_id long, frame long, x array<double>"), model, tracker.observe(spark.createDataFrame([(1, 1, 1, 0.5)], "file_id long, frame long, dim int, value double"), t, p)[1]).collect()}
    assert got[1] == free[1] and got[51] == free[51]


def test_windowed_means(spark, tmp_path):
    spark.sql("select 1L file_id, timestamp_ntz'2024-01-01 00:00:01' arrived, 2.0D act union all select 1L, timestamp_ntz'2024-01-01 00:00:09', 4.0D union all select 1L, timestamp_ntz'2024-01-01 00:01:00', 1.0D").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("file_id long, arrived timestamp_ntz, act double").parquet(str(tmp_path / "in"))
    q = windowed_means(stream, "10 seconds", "5 seconds").writeStream.format("memory").queryName("means").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert [(r.value, r.n) for r in spark.table("means").collect()] == [(3.0, 2)]
