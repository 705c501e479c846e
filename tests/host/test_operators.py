"""Small literal cases: ties, empty groups, boundaries, policies."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import stats
from tidemark.operators import integrity, layout, machine, paths, timeline
from tidemark.plans import catalog


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("n", [1, 2, 5, 20, 99, 400])
def test_nearest_rank_equals_definition(spark, n):
    values = random.Random(n).choices(range(n * 2), k=n)
    df = spark.createDataFrame([(1, float(v)) for v in values], "k int, v double")
    want = {p: float(sorted(values)[max(1, math.ceil(round(p * n, 9))) - 1]) for p in (0.5, 0.95, 0.99)}
    r = df.groupBy("k").agg(*stats.summary("v")).first()
    b = stats.bracketed_rank(df, ["k"], "v", {"median": 0.5, "p95": 0.95, "p99": 0.99}, accuracy=20).first()
    for row in (r, b):
        assert (row["median"], row["p95"], row["p99"]) == tuple(want.values())
        assert (row["n"], row["min"], row["max"]) == (n, min(values), max(values))


def test_nearest_rank_of_nothing(spark):
    empty = spark.createDataFrame([], "v double")
    assert empty.agg(stats.nearest_rank("v", 0.95, 0).alias("x")).first()["x"] == 0
    assert empty.agg(stats.nearest_rank("v", 0.95).alias("x")).first()["x"] is None


def test_frame_micros_round_half_up_exactly(spark):
    for num, den in ((30000, 1001), (24, 1), (60, 1), (3, 2), (2, 1)):
        for f in (0, 1, 2, 3, 1000, 10**9):
            assert one(spark, S.frame_micros(F.lit(f), num, den)) == (2 * f * 1_000_000 * den + num) // (2 * num)


def test_scalars(spark):
    assert one(spark, S.parse_rational(F.lit("30000/1001"))).asDict() == {"num": 30000, "den": 1001}
    assert one(spark, S.parse_rational(F.lit("50/100"))).asDict() == {"num": 1, "den": 2}
    assert one(spark, S.parse_rational(F.lit("1/0"))) is None
    assert one(spark, S.decimal_seconds_micros(F.lit("1.0000005"))) == 1_000_001
    assert one(spark, S.compare_versions(F.lit("1.10"), F.lit("1.9.3"))) == 1
    assert one(spark, S.compare_versions(F.lit("2"), F.lit("2.0.0"))) == 0
    assert one(spark, S.content_range(F.lit("bytes 0-9/10"))).asDict() == {"first": 0, "last": 9, "total": 10}
    assert one(spark, S.content_range(F.lit("bytes 5-4/10"))) is None
    assert one(spark, S.checked_add(F.lit(S.SAFE - 1), F.lit(1))) == S.SAFE
    with pytest.raises(Exception, match="exceeds"):
        one(spark, S.checked_add(F.lit(S.SAFE), F.lit(1)))
    assert one(spark, S.measured_bitrate(F.lit(0), F.lit(5), 30, 1)) == 1
    assert [one(spark, S.next_body_frame(F.lit(k), F.lit(4), F.lit(5)))["frame"] for k in ("loop", "finite", "held")] == [0, 4, 4]


def test_as_of_takes_ties_and_the_last_of_equals(spark):
    probes = spark.createDataFrame([(1, 5), (1, 0), (1, 9), (2, 5)], "k int, at int")
    sources = spark.createDataFrame([(1, 5, "a", 1), (1, 5, "b", 2), (1, 8, "c", 3)], "k int, at int, v string, id int")
    back = {(r["k"], r["at"]): r["_source"] and r["_source"]["v"] for r in timeline.as_of(probes, sources, ["k"], "at", ["v"], "id").collect()}
    assert back == {(1, 5): "b", (1, 0): None, (1, 9): "c", (2, 5): None}
    ahead = {(r["k"], r["at"]): r["_source"] and r["_source"]["v"] for r in timeline.as_of(probes, sources, ["k"], "at", ["v"], "id", forward=True).collect()}
    assert ahead == {(1, 5): "a", (1, 0): "a", (1, 9): None, (2, 5): None}


@pytest.mark.parametrize(("portals", "n", "loop", "finite"), [([0], 8, 7, 0), ([2, 5], 8, 4, 2), ([7], 8, 7, 7), ([0, 1, 2], 3, 0, 0), ([1, 9], 12, 7, 7)])
def test_portal_waits(spark, portals, n, loop, finite):
    ps = F.array(*map(F.lit, portals))
    assert one(spark, timeline.greatest_wait(ps, n)) == loop == max(min((p - f) % n for p in portals) for f in range(n))
    assert one(spark, timeline.greatest_wait_finite(ps)) == finite
    for f in range(n):
        assert one(spark, timeline.portal_boundary(ps, F.lit(f), n)[1]) == min((p - f) % n for p in portals)


def test_ranges_merge_and_split(spark):
    r = spark.createDataFrame([(1, 0, 4), (1, 4, 4), (1, 9, 1), (1, 10, 130)], "k int, off long, len long")
    merged = timeline.merged_ranges(r, ["k"]).orderBy("start")
    assert [tuple(x) for x in merged.collect()] == [(1, 0, 8, 2), (1, 9, 140, 2)]
    assert sorted((x["first"], x["last"]) for x in timeline.split_ranges(merged, 64).collect()) == [(0, 8), (9, 73), (73, 137), (137, 140)]


@pytest.mark.parametrize("buckets", [1, 3, 1024])
def test_prefix_sum(spark, buckets):
    rng = random.Random(buckets)
    rows = [(rng.randrange(-50, 5000), k, rng.randrange(9)) for k in range(300)]
    got = {r["i"]: r["o"] for r in layout.prefix_sum(spark.createDataFrame(rows, "k long, i long, v long"), "k", ["i"], F.col("v"), "o", buckets).collect()}
    total = 0
    for k, i, v in sorted(rows):
        assert got[i] == total
        total += v


def test_use_counts_and_pairs(spark):
    units, uses = spark.createDataFrame([(1,), (2,), (3,)], "u int"), spark.createDataFrame([(1,), (2,), (2,)], "x int")
    assert sorted(map(tuple, integrity.use_counts(units, "u", uses, "x", F.lit(1)).collect())) == [(2, 2), (3, 0)]
    edges = spark.createDataFrame([("u", "e1", "a", "b"), ("u", "e2", "b", "a"), ("v", "e3", "a", "b"), ("v", "e4", "a", "b"), ("w", "e5", "a", "b")], "u string, e string, s string, t string")
    assert [tuple(r) for r in integrity.inverse_pairs(edges, "u", "e", "s", "t").collect()] == [("u", "e1", "e2")]


def test_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (7, 7)], "src long, dst long")
    assert sorted(r["node"] for r in paths.functional_cycles(edges, 32).collect()) == [1, 2, 3, 7]


def test_heaviest_window_by_enumeration():
    rng = random.Random(1)
    for _ in range(60):
        units = {u: [(rng.randrange(9), rng.randrange(3)) for _ in range(rng.randrange(1, 4))] + [(rng.randrange(9), 1)] for u in "abc"}
        after = {u: rng.sample("abc", rng.randrange(3)) for u in "abc"}

        def walk(u, k, left):
            size, frames = units[u][k]
            if frames > left:
                return 0
            ahead = [(u, k + 1)] if k + 1 < len(units[u]) else [(v, 0) for v in after[u]]
            return size + max([0, *(walk(v, j, left - frames) for v, j in ahead)])

        limit = rng.randrange(1, 7)
        assert paths.heaviest_window(units, after, limit) == max(walk(u, k, limit) for u in units for k in range(len(units[u])))


# --- the state machine


def machine_of(begin=True):
    m = machine.Machine(catalog.sample_graph())
    if begin:
        m.apply("begin")
        for _ in range(3):
            m.apply("tick")
    return m


def kinds(effects):
    return [e["type"] for e in effects]


def test_intro_then_stable():
    m = machine_of(begin=False)
    assert kinds(m.apply("begin")) == ["readinesschange"]
    assert m.s["phase"] == "intro"
    for _ in range(3):
        assert m.apply("tick") == []
    assert (m.s["phase"], m.s["frame"]) == ("stable", 0)


def test_requests_join_supersede_and_settle():
    m = machine_of()
    assert kinds(m.apply("request", "hover")) == ["requestedstatechange"]
    assert m.apply("request", "hover") == []
    out = m.apply("request", "busy")
    assert kinds(out) == ["requestedstatechange", "settle"] and out[1]["request_ids"] == [1, 2] and out[1]["outcome"] == "reject:AbortError"
    assert m.apply("request", "nowhere")[0]["outcome"] == "reject:RouteError"
    out = m.apply("request", "idle")
    assert [e.get("outcome") for e in out if e["type"] == "settle"] == ["reject:AbortError", "resolve:stable-noop"]
    assert m.s["phase"] == "stable"


def test_reversal_keeps_the_frame():
    m = machine_of()
    m.apply("request", "hover")
    assert kinds(m.apply("tick")) == ["transitionstart"]
    m.apply("tick")
    assert (m.s["phase"], m.s["frame"]) == ("reversible", 1)
    assert kinds(m.apply("request", "idle")) == ["requestedstatechange", "settle"]
    assert kinds(m.apply("tick")) == ["transitionstart"] and m.s["frame"] == 0
    assert kinds(m.apply("tick")) == ["transitionend", "settle"]


def test_cut_ignores_readiness_and_portals_do_not():
    m = machine_of()
    m.apply("send", "view")
    assert m.apply("tick", ready=False) == [] and m.s["phase"] == "waiting"
    m.s.update(visual="hover", requested="hover", phase="stable", slots={}, frame=0)
    m.apply("send", "click")
    assert kinds(m.apply("tick", ready=False)) == ["transitionstart", "visualstatechange", "transitionend"]


def test_completion_follows_a_finite_body():
    m = machine_of()
    m.s.update(visual="busy", requested="busy", phase="stable", slots={}, frame=4)
    m.apply("tick")
    assert kinds(m.apply("tick")) == ["requestedstatechange", "transitionstart"]
    for _ in range(2):
        m.apply("tick")
    assert kinds(m.apply("tick")) == ["visualstatechange", "transitionend"]


def test_the_33rd_input_of_a_tick_takes_a_number():
    m = machine_of()
    for _ in range(machine.INPUTS_PER_TICK):
        m.apply("send", "nothing")
    assert m.apply("request", "hover")[0]["outcome"] == "reject:InputOverflowError"
    assert m.s["sequence"] == 33
    m.apply("tick")
    assert kinds(m.apply("request", "hover")) == ["requestedstatechange"] and m.s["sequence"] == 34


def test_recovery_disposal_and_preview():
    m = machine_of()
    m.apply("request", "hover")
    before = dict(m.s)
    m.preview("tick")
    assert m.s == before
    out = m.apply("recover", "lost")
    assert kinds(out) == ["readinesschange", "fallback", "transitionstart", "visualstatechange", "transitionend", "settle"]
    assert kinds(m.apply("send", "error")) == ["requestedstatechange", "transitionstart", "visualstatechange", "transitionend"]
    assert kinds(m.apply("resume")) == ["readinesschange"]
    assert kinds(m.apply("dispose")) == ["readinesschange"] and m.apply("dispose") == []
    assert kinds(m.apply("tick")) == ["error"]


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_random_tapes_replay_and_settle(seed):
    rng, graph = random.Random(seed), catalog.sample_graph()
    tape = [("begin", None, True)]
    for _ in range(2500):
        for _ in range(rng.randrange(3)):
            tape.append(("request", rng.choice(list(graph.states)), True) if rng.random() < 0.5 else ("send", rng.choice(["view", "click", "error", "signup", "purchase", "none"]), True))
        tape.append(("tick", None, rng.random() < 0.7))
    tape += [("tick", None, True)] * 80
    a, b = machine.Machine(graph), machine.Machine(graph)
    logs = [[e for x in tape for e in m.apply(*x)] for m in (a, b)]
    assert logs[0] == logs[1] and not [e for e in logs[0] if e["type"] == "error"]
    settled = [i for e in logs[0] if e["type"] == "settle" for i in e["request_ids"]]
    assert sorted(settled) == list(range(1, a.s["next_request"])) and a.s["group"] is None


def test_prefix_sum_keeps_null_and_outlying_keys(spark):
    rows = [(None, 1, 7), (1, 1, 5), (3, 1, 2), (3, 2, 4), (10**15, 1, 1), (-(10**15), 1, 3)]
    got = layout.prefix_sum(spark.createDataFrame(rows, "k long, o long, v long").repartition(3), "k", ["o"], F.col("v"), "before").collect()
    assert {(r["k"], r["o"]): r["before"] for r in got} == {(None, 1): 0, (-(10**15), 1): 7, (1, 1): 10, (3, 1): 15, (3, 2): 17, (10**15, 1): 21}


def test_as_of_in_bands_equals_as_of(spark):
    import random

    rng = random.Random(1)
    side = lambda n: spark.createDataFrame([(rng.choice([None, 1, 2]), rng.randrange(-50, 200), k) for k in range(n)], "key long, at long, id long")
    probes, sources = side(150), side(25)
    rows = lambda df: sorted((str(r["key"]), r["at"], r["id"], r["_source"] and tuple(r["_source"])) for r in df.collect())
    for forward in (False, True):
        whole = rows(timeline.as_of(probes, sources, ["key"], "at", ["id"], "id", forward))
        for band in (1, 7, 1000):
            assert rows(timeline.as_of(probes, sources, ["key"], "at", ["id"], "id", forward, band)) == whole
        assert any(r[3] is None for r in whole) and any(r[3] for r in whole)
