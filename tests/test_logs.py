import random

from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import logs as L

LINES = [
    "  stray",
    "",
    "3#:10:[2024-10-23 10:00:27.306]: modA :DEBUG:417:tid:2873:read timeout",
    "   more of it",
    "",
    "no match at all",
    "3#:10:[2024-10-23 10:00:28.3]:modA:debug:417:tid:2873:fine",
    "3#:10:[2024-10-23 10:00:29.123456]:modA:debug:417:tid:2873:odd",
    "3#:10:[2024-10-23 10:00:30]:modA:debug:417:tid:2873:read timeout",
]


def records(spark):
    df = spark.createDataFrame([("f", i, s) for i, s in enumerate(LINES)], "source_path string, line_no int, line string")
    return L.parse_logs(df).orderBy("line_no").collect()


def test_parse_and_continuation(spark):
    r = records(spark)
    assert [x.message for x in r] == ["stray", "read timeout\n   more of it", "no match at all", "fine", "odd", "read timeout"]
    assert r[1].module == "modA" and r[1].level == "debug" and r[1].tid == "2873"
    assert r[2].ts is None


def test_epoch_quirk(spark):
    r = {x.message: x.ts_epoch for x in records(spark)}
    assert round(r["fine"] % 1, 3) == 0.003  # .3 is three milliseconds
    assert r["odd"] is None  # more than 999 milliseconds
    assert round(r["read timeout\n   more of it"] % 1, 3) == 0.306


def test_epoch_text_truncates(spark):
    assert spark.range(1).select(X.epoch_text(F.lit(1729677627.3069)).alias("t")).first().t == "2024-10-23 10:00:27.306"


def test_keep_latest_prefers_first_of_ties(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 2), ("a", 2.0, 3), ("b", None, 4), ("b", None, 5)], "k string, e double, n int")
    out = L.keep_latest(df, ["k"], F.col("e"), F.col("n"))
    assert sorted(r.n for r in out.collect()) == [2, 4]
    assert sorted(r.n for r in L.keep_latest(out, ["k"], F.col("e"), F.col("n")).collect()) == [2, 4]


def test_fault_phrases(spark):
    rows = [("read TIMEOUT",), ("open fail = 0 timeout",), ("receive of x failing",), ("all good",), ("  ",), (None,), ("超时",)]
    out = spark.createDataFrame(rows, "m string").select(L.is_fault(F.col("m")).alias("f")).collect()
    assert [r.f for r in out] == [True, False, True, False, False, False, True]


def fold(times, before, after, gap):
    out = []
    for t in sorted(times):
        if out and t - before <= out[-1][1] + gap:
            out[-1] = (out[-1][0], max(out[-1][1], t + after))
        else:
            out.append((t - before, t + after))
    return out


def test_windows_equal_a_fold(spark):
    random.seed(4)
    rows = [(k, random.randrange(20_000)) for k in range(5) for _ in range(40)] + [(9, 0), (9, 540), (8, 0), (8, 541)]
    df = spark.createDataFrame([(k, t, str(t)) for k, t in rows], "k int, t long, m string")
    got = {}
    for r in L.fault_windows(df, "k", "t", "m", 120, 300, 120).orderBy("k", "window_id").collect():
        got.setdefault(r.k, []).append((r.win_start, r.win_end))
    assert got == {k: fold([t for q, t in rows if q == k], 120, 300, 120) for k in {k for k, _ in rows}}
    assert len(got[9]) == 1 and len(got[8]) == 2


def test_window_members_both_ends(spark):
    wins = spark.createDataFrame([(1, 0, 100, 200)], "k int, window_id int, win_start long, win_end long")
    recs = spark.createDataFrame([(1, t) for t in (99, 100, 150, 200, 201)], "k int, t long")
    assert sorted(r.t for r in L.window_members(recs, wins, "k", "t", 60).collect()) == [100, 150, 200]


def test_char_budget_keeps_the_line_that_overflows(spark):
    df = spark.createDataFrame([("a", i, "x" * 9) for i in range(10)], "k string, n int, line string")
    assert L.char_budget(df, "k", "n", "line", 25, 100).count() == 3
    assert L.char_budget(df, "k", "n", "line", 1000, 4).count() == 4


def test_index_lists_each_segment_once(spark):
    w = spark.createDataFrame([("s1", "w1", ["a", "b"], "C1", "D1"), ("s2", "w2", ["c"], "", "D1")], "source_stem string, fault_windows_file string, segments array<string>, case_id string, device_sn string")
    index = L.fault_index(w)
    assert {(r.kind, r.key) for r in index.collect()} == {("case_id", "C1"), ("device_sn", "D1")}
    assert sorted(r.segment for r in L.index_jobs(index).collect()) == ["a", "b", "c"]
