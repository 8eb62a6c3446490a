import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from metrolith.llm.overlap import CLASSES, SLIPS, aligned, chained, fingerprints, list_split, overlap_pairs, overlap_report, recording_key, slips_allowed
from metrolith.session import Workspace

FILES = "file_id long, path string, dataset string, lab_fln string, name string, h long"


def files(spark, rows):
    return spark.createDataFrame([(f, p, d, lab, "n", 1) for f, p, d, lab in rows], FILES)


@pytest.mark.parametrize(
    "path, key",
    [
        ("/a/b/02_fosono-nidömeri-zutiha_take01_mono.flac", ("fosononidomerizutiha", "take1")),
        ("fosono nidomeri zutiha - Take 1 - Copy.WAV", ("fosononidomerizutiha", "take1")),
        (r"c:\x\Fosono-Nid%C3%B6meri.zutiha_44k.clean.mp3", ("fosononidomerizutiha", "")),
        ("take01_fosono_nido%CC%88meri_zutiha", ("fosononidomerizutiha", "take1")),
        ("08%20fosono%20var02.flac", ("fosono", "var2")),
        ("08fosono_zuti.wav", ("fosonozuti", "")), ("08fo.wav", ("08fo", "")), ("", None), ("/", None), (None, None), ("a/01.wav", ("01", "")),
    ],
)
def test_keys(path, key):
    assert recording_key(path) == key


def test_splits_of_lists():
    for x, s in (("lists/trainsong-val.lab", "val"), (r".\lists\a_training.lab", "train"), ("/srv/x-TEST.lab", "test"), ("a-valid.lab", "val"), ("a-validation.lab ", "val"), (None, None), ("", None), ("lists/other.lab", None)):
        assert list_split(x) == s


def osa(a, b):
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
@settings(max_examples=300, deadline=None)
def test_alignment(a, b):
    d = osa(a, b)
    assert aligned(a, b) == (d if d <= 2 * SLIPS else None)
    assert aligned(a, b, SLIPS) == (d if d <= SLIPS else None)


def slip(rnd, s):
    i = rnd.randrange(len(s) - 1)
    return rnd.choice([s[:i] + s[i + 1 :], s[:i] + rnd.choice("abcdefg") + s[i:], s[:i] + rnd.choice("abcdefg") + s[i + 1 :], s[:i] + s[i + 1] + s[i] + s[i + 2 :]])


def test_fingerprints_of_slipped_names_meet():
    rnd = random.Random(4)
    for i in range(6000):
        n = rnd.randrange(3, 34)
        a = "".join(rnd.choice("abcdefghij") for _ in range(n))
        b = slip(rnd, a)
        b = slip(rnd, b) if len(b) > 2 else b
        d = aligned(a, b, SLIPS)
        if d is None or d > slips_allowed(min(len(a), len(b))):
            continue
        a, b = (a, b) if i % 2 else (b, a)
        fa, fb = fingerprints(a), fingerprints(b, False)
        met = [(o, p, k) for h, o, k in fa for g, p, _ in fb if h == g and abs(o - p) <= 2 * SLIPS]
        assert met, (a, b)
        assert chained(a, b, [m for m in met if m[2]], 2 * SLIPS)[0] >= d
        assert chained(a, b, [m for m in met if m[2]], d)[0] == d


def test_names_of_any_length_match_brute_force(spark):
    rnd = random.Random(6)
    names, rows = [], []
    for _ in range(150):
        base = "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.choice([1, 2, 3, 5, 7, 9, 12, 14, 16, 17, 18, 19, 20, 21, 23])))
        names += [base, slip(rnd, base) if len(base) > 1 else base, slip(rnd, slip(rnd, base + "qz"))]
    for i, x in enumerate(names):
        rows.append((i, x + ".wav", "a", "train.lab" if i % 2 else "val.lab"))
    keys = [recording_key(r[1]) for r in rows]
    want = set()
    for i, x in enumerate(keys):
        for j in range(i):
            y = keys[j]
            if (i - j) % 2 and x and y and x[1] == y[1] and (d := aligned(x[0], y[0], SLIPS)) is not None and d <= slips_allowed(min(len(x[0]), len(y[0]))):
                want.add((j, i))
    got = {tuple(r) for r in overlap_pairs(files(spark, rows), Workspace(spark, "t")).collect()}
    assert want <= got and len(want) > 100
    assert all(aligned(keys[i][0], keys[j][0], slips_allowed(min(len(keys[i][0]), len(keys[j][0])))) is not None for i, j in got)


def test_short_names_without_numbers_meet_only_their_like(spark):
    from metrolith.llm.overlap import _prints

    rnd = random.Random(7)
    names = sorted({"".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10)) for _ in range(6000)})
    df = spark.createDataFrame([(x, "") for x in names], "name string, numbers string")
    a, b = (df.where(f"hash(name) % 2 = {k}").mapInArrow(lambda it, k=k: _prints(k == 0, it), "name string, numbers string, h long, o int, k int").withColumnRenamed("name", f"n{k}") for k in (0, 1))
    # Trigrams would give about 6000 * 6000 / 4 * 8 / 17576 rows.
    assert a.join(b, ["numbers", "h"]).count() < 600


def test_winnowing_takes_less_than_every_gram():
    *_, k, w = CLASSES["l"]
    rnd = random.Random(5)
    s = "".join(rnd.choice("abcdefghijklmnop") for _ in range(400))
    assert len(fingerprints(s)) < 0.75 * (400 - k + 1)


def test_pairs(spark):
    t, v = "lists/a-train.lab", "lists/b-val.lab"
    rows = [
        (1, "x/fosono-nidomeri-zutiha.wav", "a", t), (1, "x/fosono-nidomeri-zutiha.wav", "a", t), (2, "y/01_fosono-nidömeri-zutiha.flac", "b", v), (3, "fosono-nidmoeri-zutihas.mp3", "b", "q-test.lab"),
        (4, "fosono-nidomeri-zutiha_take02.wav", "b", v), (5, "fosono-nidomeri-zutiha.wav", "b", None), (6, "fosono-nidomeri-zutiha.wav", "a", t), (7, "other-things-altogether.wav", None, v), (8, None, "a", v), (None, "fosono-nidomeri-zutiha.wav", "a", v),
        (9, "ab.wav", "a", t), (10, "ab.wav", "a", v), (11, "ac.wav", "a", v),
    ]
    f = files(spark, rows)
    assert {tuple(r) for r in overlap_pairs(f, Workspace(spark, "t")).collect()} == {(1, 2), (1, 3), (2, 6), (3, 6), (9, 10)}, "ac is another name than ab"
    rep = {(r.eval_split, r.dataset): (r.entries, r.overlapping, r.pairs) for r in overlap_report(f, Workspace(spark, "t")).collect()}
    assert rep == {("val", "b"): (2, 1, 2), ("test", "b"): (1, 1, 2), ("val", None): (1, 0, 0), ("val", "a"): (2, 1, 1)}


def test_empty_and_hot(spark):
    assert overlap_pairs(files(spark, []), Workspace(spark, "t")).count() == 0
    rows = [(i, "fosono-nidomeri-zutiha.wav", "a", "train.lab" if i % 2 else "test.lab") for i in range(60)]
    assert overlap_pairs(files(spark, rows), Workspace(spark, "t")).count() == 900
