"""Queries over whole tables, against plain Python."""

import os

import pytest

from tidemark.plans import catalog

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def read(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


@here
def test_path_frames_of_every_edge(spark):
    orders, states = read(spark, "orders"), {r[0] for r in read(spark, "customer").select("c_custkey").collect()}
    edges = {r["o_orderkey"]: (r["o_custkey"], (r["o_custkey"] * 7 + r["o_orderkey"]) % 150) for r in orders.collect()}
    want = {k: sum(5 + s % 7 for s in ends) + k % 4 for k, ends in edges.items() if states.issuperset(ends)}
    assert {r["edge"]: r["count"] for r in catalog.QUERIES["path_frames"](spark, DATA).groupBy("edge").count().collect()} == want
    assert any(k % 10 for k in want)


@here
def test_release_set_has_every_name(spark):
    got = catalog.QUERIES["release_set"](spark, DATA).collect()
    names = {f"{r['p_brand']} {r['p_name']}" for r in read(spark, "part").collect()}
    assert len(got) == len(names) and {r["name"] for r in got} == names


@here
def test_readiness_of_every_state(spark):
    suppliers = {r["s_suppkey"] for r in read(spark, "supplier").collect()}
    of, bridged = ({r["o_orderkey"]: r[c] for r in read(spark, "orders").collect()} for c in ("o_custkey", "o_orderstatus"))
    customers = read(spark, "customer").collect()
    want = {(r["c_custkey"], "own-body", r["c_custkey"]) for r in customers} | {(r["c_custkey"], "initial", r["c_nationkey"]) for r in customers if r["c_acctbal"] < 0}
    states = {r["c_custkey"] for r in customers}
    for r in read(spark, "lineitem").collect():
        order, state = r["l_orderkey"], of.get(r["l_orderkey"])
        if state in states:
            want |= {(state, "edge", order), (state, "target-body" if r["l_suppkey"] in suppliers else "missing-target", r["l_suppkey"])}
            want |= {(state, "transition", order)} if bridged[order] != "O" else set()
    got = [(r["state"], r["kind"], r["id"]) for r in catalog.QUERIES["readiness_closure"](spark, DATA).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@here
def test_probes_and_requests_cover_the_layout(spark):
    end = catalog.laid_out(spark, DATA).selectExpr("max(off + len)").first()[0]
    assert sorted(r["p"] for r in catalog.QUERIES["ordinal_span"](spark, DATA).collect()) == list(range(0, end, 997))
    assert sorted(r["request"] for r in catalog.QUERIES["request_overlap"](spark, DATA).collect()) == list(range(-(-end // 4096)))


def test_closure_follows_a_chain_to_its_end(spark):
    from tidemark.operators import paths

    edges = spark.createDataFrame([(k, k + 1) for k in range(12)] + [(12, 5), (20, 21)], "src long, dst long")
    roots = spark.createDataFrame([(0,)], "node long")
    assert sorted(r["node"] for r in paths.closure(edges, roots).collect()) == list(range(13))
    assert paths.closure(edges, roots.limit(0)).collect() == []


@here
def test_cycles_and_closure_over_unfolded_keys(spark):
    orders = [(r["o_custkey"], r["o_orderkey"]) for r in read(spark, "orders").collect()]
    seen, todo = set(), [r["c_custkey"] for r in read(spark, "customer").where("c_nationkey = 7").collect()]
    while todo:
        if (node := todo.pop()) not in seen:
            seen.add(node)
            todo += [b for a, b in orders if a == node]
    assert {r["node"] for r in catalog.QUERIES["import_closure"](spark, DATA).collect()} == seen
    step = {}
    for a, b in orders:
        step[a] = min(b, step.get(a, b))
    cycles = set()
    for a in step:
        b, n = step[a], 0
        while b != a and b in step and n < len(step):
            b, n = step[b], n + 1
        cycles |= {a} if b == a else set()
    assert {r["node"] for r in catalog.QUERIES["completion_cycle"](spark, DATA).collect()} == cycles


def test_edge_lead_plan(spark):
    from tidemark.functions import scalars as S

    rows = spark.createDataFrame([(0, 2), (0, 1), (1, 2), (4, 5), (5, 5), (6, 6), (30, 6)], "t long, a long")
    got = [tuple(r["p"]) for r in rows.select(S.edge_lead_plan("t", "a", 6).alias("p")).collect()]
    body, bridge = "target-body", "bridge"
    assert got == [(body, 2, 0, True), (body, 2, 1, False), (bridge, 2, 0, True), (bridge, 5, 0, True), (bridge, 6, 1, False), (bridge, 6, 0, True), (bridge, 6, 0, True)]
