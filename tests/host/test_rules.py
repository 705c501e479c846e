"""Rules on literal rows, with values worked out by hand."""

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import integrity, ledgers, timeline


def test_exact_grid_needs_every_stamp_and_duration(spark):
    rows = [(1, 0, 500, 1001), (1, 1, 1501, 1001), (2, 0, 0, 1001), (2, 1, 1002, 1001), (3, 0, 0, 1000), (4, 0, 7, 1001)]
    got = timeline.exact_grid(spark.createDataFrame(rows, "key long, n long, t long, dur long"), ["key"], ["n"], "t", "dur", (30000, 1001), (1, 30000))
    assert sorted(map(tuple, got.collect())) == [(1, 2, True), (2, 2, False), (3, 1, False), (4, 1, True)]


def test_codec_strings(spark):
    good = {"avc1.64001F": ("h264", 8), "hvc1.1.6.L93.B0": ("h265", 8), "hvc1.1.2.H1.90": ("h265", 8), "vp09.00.10.08": ("vp9", 8), "vp09.00.62.08.01.01.01.01.00": ("vp9", 8), "av01.0.31H.10": ("av1", 10), "av01.0.00M.08.0.112.01.01.01.0": ("av1", 8)}
    bad = ["avc1.64001f", "avc1.64000E", "hvc1.1.4.L93.B0", "hvc1.1.6.L0.B0", "hvc1.1.6.L256.B0", "hvc1.1.6.L93.F0", "hvc1.1.6.L93.B0.00", "hvc1.1.100000002.L93.B0", "vp09.00.22.08", "av01.0.32M.08", "av01.0.05M.12", "", None]
    rows = spark.createDataFrame([(x,) for x in [*good, *bad]], "t string").select("t", S.codec_string("t").alias("s")).collect()
    assert {r["t"]: tuple(r["s"]) for r in rows if r["s"]} == good


def test_rendition_geometry(spark):
    rows = spark.createDataFrame([(100, 50, 100, 50, False), (101, 51, 101, 51, True), (100, 50, 50, 24, False), (10, 10, 20, 20, False)], "cw long, ch long, vw long, vh long, p boolean")
    got = [r["g"] and tuple(r["g"]) for r in rows.select(S.rendition_geometry(("cw", "ch"), ("vw", "vh"), F.col("p"), (16, 8)).alias("g")).collect()]
    assert got == [(100, 50, None, 112, 56, 5000, 20000, 25088), (102, 112, 60, 112, 112, 5151, 45696, 50176), None, None]


def test_alpha_policy(spark):
    rows = spark.createDataFrame([(r, o) for r in ("auto", "opaque", "packed") for o in (True, False)], "r string, o boolean")
    got = [tuple(x["p"]) for x in rows.select(S.alpha_policy("r", F.col("o")).alias("p")).collect()]
    assert got == [("opaque", False, False), ("packed", False, False), ("opaque", False, False), (None, False, True), ("packed", True, False), ("packed", False, False)]


def test_frame_credit_lends_takes_back_and_clears(spark):
    ops = [("lease", 6), ("lease", 5), ("lease", 4), ("submit", 1), ("submit", 0), ("release", 1), ("release", 1), ("lease", 1), ("clear", 0), ("release", 2)]
    rows = spark.createDataFrame([(1, k, op, n) for k, (op, n) in enumerate(ops)], "key long, n long, op string, a long")
    got = [tuple(r)[2:] for r in ledgers.frame_credit(rows, ["key"], "n", "op", "a", 10, 3).orderBy("n").collect()]
    assert got == [
        ("leased", 1, 1, 6), ("budget-exceeded", None, 1, 6), ("leased", 2, 2, 10), ("no-credit", None, 2, 10), ("credit", None, 2, 10), ("released", None, 1, 4), ("release-invalid", None, 1, 4), ("leased", 3, 2, 5), ("cleared", None, 0, 0), ("release-invalid", None, 0, 0),
    ]


def test_page_admission_keeps_both_limits(spark):
    rows = spark.createDataFrame([(1, k, p, n) for k, (p, n) in enumerate([("a", 5), ("a", 4), ("b", 6), ("a", 1), ("c", 1), ("b", None), ("c", 2)])], "page long, n long, player string, b long")
    got = [tuple(r)[2:] for r in ledgers.page_admission(rows, ["page"], "n", "player", "b", 8, 11).orderBy("n").collect()]
    assert got == [("reserved", 5, 5), ("rejected", 5, 5), ("reserved", 6, 11), ("rejected", 5, 11), ("rejected", 0, 11), ("disposed", 0, 5), ("reserved", 2, 7)]


def test_edges_report_the_first_broken_rule(spark):
    port = [("main", 7)]
    states = spark.createDataFrame([(1, "loop", 9, port), (2, "finite", 9, port), (3, "held", 1, [])], "state long, playback string, frames long, ports array<struct<id string, last long>>")
    base = dict(src=1, dst=2, start="cut", source_port="main", target_port="main", transition=None, unit_kind=None, continuity="exact-authored")
    cases = [
        ({}, None), ({"src": 9}, "from"), ({"dst": 9}, "to"), ({"dst": 3}, "target-port"), ({"start": "portal", "source_port": "side"}, "source-port"), ({"start": "portal", "src": 2}, "held-frame"), ({"start": "finish"}, "finish-of-loop"), ({"transition": "locked"}, "bridge-unit"),
        ({"transition": "locked", "unit_kind": "bridge", "continuity": "free"}, "locked-continuity"), ({"transition": "reversible", "unit_kind": "bridge"}, "reversible-unit"), ({"start": "portal", "continuity": "free"}, "continuity"), ({"continuity": "free"}, None),
    ]
    rows = [(k, *(base | change).values()) for k, (change, _) in enumerate(cases)]
    edges = spark.createDataFrame(rows, "edge long, src long, dst long, start string, source_port string, target_port string, transition string, unit_kind string, continuity string")
    assert {r["edge"]: r["code"] for r in integrity.edge_failures(edges, states).collect()} == {k: code for k, (_, code) in enumerate(cases) if code}


def test_slots_and_counters(spark):
    profiles = spark.createDataFrame([(0, "x", 60, True), (0, "x", 60, True), (1, "x", 120, False), (7, "x", 60, False), (1, "x", 75, False)], "platform long, browser string, refresh int, available boolean")
    required = spark.createDataFrame([(0, "x"), (1, "x"), (2, "x")], "platform long, browser string")
    got = sorted(map(tuple, integrity.slot_matrix(profiles, required, range(3), 60, 120).collect()))
    assert got == [("duplicate", 0, "x", 60), ("missing", 0, "x", 120), ("missing", 1, "x", 60), ("missing", 2, "x", 60), ("unavailable-refresh", 1, "x", 120), ("unknown-platform", 7, "x", 60), ("unknown-refresh", 1, "x", 75)]
    deltas = spark.createDataFrame([("a", 3), ("b", 3), ("c", 0)], "name string, delta long")
    assert [tuple(r) for r in integrity.counter_failures(deltas, {"a": 3, "b": 2}).collect()] == [("b", 3, 2)]


def test_small_rules(spark):
    rows = spark.createDataFrame([("bytes 0-9/10",), (" \tBYTES 3-3/4\t",), ("bytes 00-9/10",), ("bytes 5-4/10",), ("bytes 0-9/9",), ("bytes 0-9/*",)], "h string")
    assert [r["c"] and tuple(r["c"]) for r in rows.select(S.content_range("h").alias("c")).collect()] == [(0, 9, 10), (3, 3, 4), None, None, None, None]
    one = spark.range(1).select(
        S.redact_paths(F.lit("see /home/me/x /Users/a C:\\b\\c end")).alias("r"), S.compare_utf8(F.lit("z"), F.lit("é")).alias("u"), S.lead_frames(F.lit(100.1), F.lit(1001 / 30)).alias("three"), S.lead_frames(F.lit(0.0), F.lit(5.0)).alias("none"), S.lead_frames(F.lit(5.1), F.lit(5.0)).alias("two"),
        S.intrinsic_size(F.lit(30), F.lit(20), F.lit(4), F.lit(3)).alias("s"), S.checked_add(F.lit(1), F.lit(2)).alias("a"), S.checked_multiply(F.lit(3), F.lit(4)).alias("m"), S.range_contains(F.lit(0), F.lit(9), F.lit(2), F.lit(9)).alias("c"),
    ).first()
    assert (one["r"], one["u"], one["three"], one["none"], one["two"], tuple(one["s"]), one["a"], one["m"], one["c"]) == ("see <redacted-path> <redacted-path> <redacted-path> end", -1, 3, 0, 2, (40.0, 20.0, 2.0), 3, 12, True)
