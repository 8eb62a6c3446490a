import pytest

from metrolith.sources.annotations import loaded_beats, loaded_meters, parse_annotations, parse_line, rejected


@pytest.mark.parametrize(
    "kind, line, want",
    [
        ("beats", "1.5\t2.3", (1.5, 2, 3)), ("beats", "1.5\t3", (1.5, None, 3)), ("beats", '"1.5"\t"3"\r', (1.5, None, 3)), ("beats", '  "1.5"\t3  ', (1.5, None, 3)),
        ("beats", "7.3e+00\t0.4", (7.3, 0, 4)), ("beats", "5\t1", (5.0, None, 1)),
        ("beats", '1.5\t"2', "quoting"), ("beats", '1"5\t2', "quoting"), ("beats", '"1.5"0\t2', "quoting"), ("beats", '"1.5""\t2', "quoting"), ("beats", '1.5\t2""', "quoting"), ("beats", '"1.5\t2\t2', "quoting"), ("beats", '3".9"\t1', "quoting"),
        ("beats", "", "columns"), ("beats", "   \r", "columns"), ("beats", None, "columns"), ("beats", "1.5", "columns"), ("beats", "1.5 2", "columns"), ("beats", "1.5\t2\t", "columns"), ("beats", "\t1.5\t2", "columns"), ("beats", '"1.5\t2"', "columns"),
        ("beats", "\t2", "value"), ("beats", "1.5\t", "value"), ("beats", "-1.5\t2", "value"), ("beats", "nan\t2", "value"), ("beats", "1,5\t2", "value"), ("beats", "1.5\t0", "value"), ("beats", "1.5\t2.0", "value"), ("beats", "1.5\t.3", "value"), ("beats", "1.5\t3.", "value"), ("beats", "1.5\t2½", "value"), ("beats", "٣.1\t2", "value"), ("beats", "1 . 5\t2", "value"), ("beats", "0x1F\t2", "value"), ("beats", "1e999\t2", "value"),
        ("meter", "4/4", (4, 4)), ("meter", "6", (6, None)), ("meter", '"6"/ 8\r', (6, 8)), ("meter", "6/8/", "columns"), ("meter", "4\\4", "value"), ("meter", "0/4", "value"), ("meter", "4/", "value"), ("meter", "3.5/4", "value"), ("meter", "", "columns"),
        (None, "1", "value"), ("other", "x", "value"),
    ],
)
def test_lines(kind, line, want):
    t, bar, beat, num, den, why = parse_line(kind, line)
    if isinstance(want, str):
        assert why == want and (t, bar, beat, num, den) == (None,) * 5
    else:
        assert why is None and (want == (t, bar, beat) if kind == "beats" else want == (num, den))


def test_long_fields_and_numbers():
    assert parse_line("beats", '"' + "9" * 200_000 + 'x"\t1')[-1] == "value"
    assert parse_line("beats", '1.5\t"' + "0" * 200_000 + '7"') == (1.5, None, 7, None, None, None)
    assert parse_line("beats", "1.5\t1.12345678901234567890") == (1.5, 1, None, None, None, None)
    assert parse_line("beats", "1.5\t9223372036854775807")[2] == 2**63 - 1
    assert parse_line("meter", "9" * 30 + "/4") == (None, None, None, None, 4, None)


def test_tables(spark):
    rows = [(1, 1, "beats", 1, "1.5\t2.3"), (1, 1, "beats", 1, "1.5\t2.3"), (2, 1, "meter", 1, "3"), (3, 1, "beats", 2, "x\t1"), (3, 1, "beats", 2, "x\t1"), (4, None, None, None, None), (5, 1, "beats", 3, "9" * 100_000)]
    p = parse_annotations(spark.createDataFrame([(*r, "q") for r in rows], "line_id long, file_id long, ann_type string, line_no int, raw_line string, reason string"))
    assert p.count() == len(rows)
    assert sorted((r.line_id, r.reason) for r in rejected(p).collect()) == [(3, "value"), (4, "columns"), (5, "columns")]
    assert [(r.t, r.bar, r.beat_no) for r in loaded_beats(p).collect()] == [(1.5, 2, 3)]
    assert [(r.num, r.den) for r in loaded_meters(p).collect()] == [(3, 4)]


def test_empty(spark):
    assert parse_annotations(spark.createDataFrame([], "line_id long, file_id long, ann_type string, line_no int, raw_line string")).count() == 0
