import math
import struct
import time
import wave

import numpy as np
from pyspark.sql import functions as F

from metrolith.functions import signal
from metrolith.sources import files, sinks


def test_annotation_readers(spark, tmp_path):
    (tmp_path / "a.beats").write_text("0.125\t1.1\n0.625\t1.2\r\n1.125\t2\n")
    (tmp_path / "a.meter").write_text("6/8\n")
    (tmp_path / "b.meter").write_text("3/0")
    (tmp_path / "a.bpm").write_text("120 121.5\n")
    (tmp_path / "a.section").write_text("1, 5,9\n")
    (tmp_path / "a.rhythm").write_text("waltz slow\nmore\n")
    t = lambda n: files.text_files(spark, str(tmp_path / n))
    assert [(r.line_no, r.t, r.bar, r.beat_no) for r in files.parse_beats(t("a.beats")).orderBy("line_no").collect()] == [(1, 0.125, 1, 1), (2, 0.625, 1, 2), (3, 1.125, None, 2)]
    assert [(r.num, r.den) for r in files.parse_meters(t("a.meter")).collect()] == [(6, 8)] and [(r.num, r.den) for r in files.parse_meters(t("b.meter")).collect()] == [(3, 4)]
    assert files.parse_numbers(t("a.bpm")).first().numbers == [120.0, 121.5]
    assert [r.section for r in files.parse_sections(t("a.section")).orderBy("pos").collect()] == [1, 5, 9]
    assert files.first_word(t("a.rhythm")).first().name == "waltz"


def test_lists(spark, tmp_path):
    (tmp_path / "set.lab").write_text("b.wav\n/x/audio/a.wav\n\nb.wav\n")
    got = files.list_files(spark, str(tmp_path / "set.lab"), "/data/audio").orderBy("file_id").collect()
    assert [(r.file_id, r.path, r.dataset) for r in got] == [(1, "/data/audio/b.wav", "set"), (2, "/x/audio/a.wav", "set")]
    assert files.list_files(spark, "one.wav").count() == 1 and files.list_files(spark, ["a", "b"]).count() == 2
    f = spark.createDataFrame([("/x/audio/s/a.wav",)], "path string")
    assert f.select(files.annotation_path(F.col("path"), "beats").alias("p")).first().p == "/x/annotations/beats/s/a.beats"
    assert files.missing_annotations(f, spark.createDataFrame([("/x/other",)], "path string"), "beats").count() == 1
    (tmp_path / "m-fold2.lab").write_text("p.wav\nq.wav\n")
    assert {(r.path, r.fold) for r in files.read_fold_lists(spark, str(tmp_path)).collect()} == {("p.wav", 2), ("q.wav", 2)}


def test_activations_round_trip(spark):
    f = spark.createDataFrame([(1, k, d, k + d / 10) for k in (1, 2, 3) for d in (1, 2)], "file_id long, frame long, dim int, value double")
    back = files.parse_activations(sinks.activation_text(f, 50.0)).orderBy("frame", "dim").collect()
    assert [(r.frame, r.dim, r.value, r.fps) for r in back] == [(k, d, k + d / 10, 50.0) for k in (1, 2, 3) for d in (1, 2)]
    plain = files.parse_activations(spark.createDataFrame([(1, "0.5 1e-2\n3")], "file_id long, value string"))
    assert [(r.frame, r.value) for r in plain.orderBy("frame").collect()] == [(1, 0.5), (2, 0.01), (3, 3.0)]


def test_aligned_features_end_with_the_shortest(spark):
    a = spark.createDataFrame([(1, k, float(k)) for k in range(1, 6)], "file_id long, frame long, y double")
    b = a.where("frame <= 3")
    assert files.align_features(a, b).agg(F.max("frame"), F.count("*")).first() == (3, 6)


def test_wav_to_spectrogram(spark, tmp_path):
    rate, n = 8000, 8000
    with wave.open(str(tmp_path / "s.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"".join(struct.pack("<hh", *(2 * (int(20000 * math.sin(2 * math.pi * 1000 * i / rate)),))) for i in range(n)))
    s = files.read_wav(spark, str(tmp_path / "s.wav"), rate)
    x = np.array(s.first().samples)
    assert len(x) == n and abs(x.max() - 20000 / 32768) < 1e-3
    assert len(signal.resample(x, rate, 44100)) == 44100
    spec = signal.spectrogram(s.select(F.lit(1).alias("file_id"), "samples"), 256, 128, 256)
    peak = spec.where("frame = 20").orderBy(F.desc("mag")).first()
    assert peak.bin == round(1000 * 256 / rate) + 1 and spec.agg(F.max("frame")).first()[0] == n // 128


def test_dft_join_equals_the_kernel(spark):
    x = np.random.default_rng(1).normal(size=70)
    df = spark.createDataFrame([(1, i + 1, float(v)) for i, v in enumerate(x)], "file_id long, frame long, x double")
    want = signal.stft(x, 16, 8, 16)
    got = signal.dft_frames(df, 16, 8, 8).collect()
    assert len(got) == want.size and all(abs(r.mag - want[r.frame - 1, r.bin - 1]) < 1e-9 for r in got)
    assert signal.edge_stft(x, 16, 8, 16).shape == (8, 8) and signal.stft(x, 16, 8, 16, True, True).shape == (8, 8)


def test_filterbank():
    bank = signal.triangular_filterbank(1024, 82)
    total = {}
    for b, band, w in bank:
        assert 1 <= b <= 1024 and w > 0
        total[band] = total.get(band, 0) + w
    assert len(total) == 82 and all(abs(t - 1) < 1e-9 for t in total.values())


def test_blocks_of_windows_do_not_matter(spark):
    from pyspark.sql import Window

    from metrolith.functions.series import blocked

    df = spark.createDataFrame([(f, i, float(i * f % 7)) for f in (1, 2) for i in range(1, 60)], "file_id long, frame long, x double")
    w = lambda *k: Window.partitionBy(*k).orderBy("frame").rowsBetween(-5, 2)
    want = {(r.file_id, r.frame): r.y for r in df.withColumn("y", F.sum("x").over(w("file_id"))).collect()}
    for block in (3, 8, 1000):
        rows, own = blocked(df, 5, 2, block)
        got = rows.withColumn("y", F.sum("x").over(w("file_id", "_block"))).where(own).collect()
        assert len(got) == len(want) and {(r.file_id, r.frame): r.y for r in got} == want


def test_features(spark):
    import pytest

    df = spark.createDataFrame([(1, i, float(i % 5)) for i in range(1, 130)], "file_id long, frame long, x double")
    assert signal.feature(df, "sprflx.mvavg.normZ").count() == 129
    for bad in ("nothing", "sprflx.other"):
        with pytest.raises(ValueError):
            signal.feature(df, bad)
    assert signal.moving_average(df, 200).count() == 0
    assert signal.change_frame_rate(df, 50.0, 50.0).count() == 129


def test_meters_and_cached_features(spark):
    f = spark.createDataFrame([(1,), (2,), (3,)], "file_id long")
    m = spark.createDataFrame([(1, 2, 3, 8), (1, 1, 6, None), (2, 1, None, 4)], "file_id long, section_no int, num int, den int")
    assert {tuple(r) for r in files.meters_of(f, m).collect()} == {(1, 6, 4), (2, 4, 4), (3, 4, 4)}
    assert {(r.num, r.den) for r in files.meters_of(f, m, "beat").collect()} == {(1, 4)}
    cache = spark.createDataFrame([(1, "a", k, 1.0) for k in (1, 2)] + [(1, "b", 1, 2.0)], "file_id long, feat_type string, frame long, y double")
    made = spark.createDataFrame([(1, 1, 9.0), (2, 1, 9.0)], "file_id long, frame long, y double")
    got = {(r.file_id, r.frame, r.dim, r.value) for r in files.load_features(cache, ["a", "b"], lambda n: made).collect()}
    assert got == {(1, 1, 1, 1.0), (1, 1, 2, 2.0), (2, 1, 1, 9.0), (2, 1, 2, 9.0)}


def test_resampling_keeps_what_fits_and_drops_the_rest():
    for source, target in ((48000, 44100), (44100, 8000), (8000, 44100), (22050, 44100)):
        t, u = np.arange(source // 4) / source, np.arange(target // 4) / target
        y = signal.resample(np.sin(2 * np.pi * 900 * t), source, target)
        assert abs(len(y) - len(u)) <= 1
        inner = slice(target // 40, len(u) - target // 40)
        assert np.abs(y[: len(u)][inner] - np.sin(2 * np.pi * 900 * u)[inner]).max() < 0.01, (source, target)
    # Beyond half of the new rate nothing is left.
    y = signal.resample(np.sin(2 * np.pi * 7000 * np.arange(11025) / 44100), 44100, 8000)
    assert np.abs(y[200:-200]).max() < 0.02


def test_results_of_many_files_are_written_and_read_back(spark, tmp_path):
    """Spark's writer starts a process a file, so thousands took minutes."""
    n, t = 2500, time.time()
    ids = spark.range(-2, n).selectExpr("if(id = -1, null, id) as file_id")
    beats = ids.selectExpr("file_id", "explode(sequence(1L, 3L)) as frame").selectExpr("file_id", "frame", "frame / 2.0d as t", "cast(frame % 2 + 1 as bigint) as beat_no")
    path = ids.selectExpr("file_id", "explode(sequence(1L, 6L)) as frame").selectExpr("file_id", "frame", "60d as bpm", "3 as num", "4 as den", "cast(frame > 4 as int) + 1 as pattern")
    names = spark.createDataFrame([(1, "früh"), (2, "late one")], "pattern int, name string")
    what = frozenset({"beats", "downbeats", "tempo", "rhythm"})
    for _ in range(2):  # the second time the results replace the first
        sinks.save_results(beats, path.where("file_id is not null"), names, 0.5, f"file://{tmp_path}", what)
    got = sinks.load_results(spark, str(tmp_path), what).toPandas()
    assert time.time() - t < 90
    assert {k: len(v) for k, v in got.groupby("kind")} == {"beats": 3 * (n + 2), "downbeats": n + 2, "rhythm": 2 * (n + 1), "tempo": 6 * (n + 1)}
    for f, x in ((-2, got[got.file_id == -2]), (7, got[got.file_id == 7]), (None, got[got.file_id.isna()])):
        of = lambda k, x=x: x[x.kind == k].sort_values("line_no")
        assert of("beats").value.tolist() == ["0.500\t2", "1.000\t1", "1.500\t2"] and of("beats").line_no.tolist() == [1, 2, 3] and of("downbeats").value.tolist() == ["1.000"]
        assert of("tempo").value.tolist() == ([f"{i / 2:.2f},60.00" for i in range(6)] if f else []) and of("rhythm").value.tolist() == (["0.00\t1.50\tfrüh", "1.50\t2.50\tlate one"] if f else [])
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(what) and [p.name for p in (tmp_path / "rhythm/file_id=7").iterdir()] == ["part-00000.txt"]
    assert [tuple(r) for r in spark.read.text(f"{tmp_path}/tempo").where("file_id = 5").select("value").limit(1).collect()] == [("0.00,60.00",)]


def test_a_long_result_is_read_in_parts(spark, tmp_path):
    path = spark.range(1, 300_001).selectExpr("1L as file_id", "id as frame", "double(id) as bpm")
    sinks.save_results(path.selectExpr("file_id", "frame", "bpm as t", "1L as beat_no"), path, None, 0.5, str(tmp_path), frozenset({"tempo"}))
    assert sinks.load_results(spark, str(tmp_path), {"tempo"}).where("value <> format_string('%.2f,%.2f', (line_no - 1) * 0.5d, double(line_no))").count() == 0
    assert sinks.load_results(spark, str(tmp_path), {"tempo"}).selectExpr("count(distinct line_no)", "max(line_no)").first() == (300_000, 300_000)
