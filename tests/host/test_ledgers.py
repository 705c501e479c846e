"""Folds and queues on literal logs."""

from pyspark.sql import functions as F

from tidemark.operators import ledgers


def log(spark, values, kind="string"):
    return spark.createDataFrame([(1, k, v) for k, v in enumerate(values)] + [(2, 0, values[0])], f"key long, n long, v {kind}")


def test_alignment_repeats_advances_skips_and_regresses(spark):
    rows = log(spark, ["a", "a", "b", "d", "a", "z", None])
    got = [(r["verdict"], r["place"]) for r in ledgers.aligned(rows, ["key"], "n", "v", ["a", "b", "c", "d"]).where("key = 1").orderBy("n").collect()]
    assert got == [("advance", 0), ("repeat", 0), ("advance", 1), ("skip", 3), ("regression", 3), ("identity", 3), ("identity", 3)]


def test_admission_refuses_what_does_not_fit_and_goes_on(spark):
    got = [(r["ok"], r["held"]) for r in ledgers.admitted(log(spark, [6, 5, 4, -6, 5], "long"), ["key"], "n", "v", 10).where("key = 1").orderBy("n").collect()]
    assert got == [(True, 6), (False, 6), (True, 10), (True, 4), (True, 9)]


def test_grants_park_cancel_and_queue(spark):
    rows = spark.createDataFrame([(1, k, h, s) for k, (h, s) in enumerate([(False, False), (True, False), (False, True), (False, False), (True, False), (False, False)])], "key long, n long, hid boolean, stale boolean")
    got = [r["verdict"] for r in ledgers.granted(rows, ["key"], "n", "hid", "stale", 2).orderBy("n").collect()]
    assert got == ["granted", "parked", "cancelled", "granted", "queued", "queued"]


def test_reclamation_gives_up_at_once_or_covers_exactly(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 9), (2, 1, 3)], "key long, n long, bytes long")
    got = sorted(map(tuple, ledgers.reclaimed(rows, ["key"], ["n"], "bytes", 12).select("key", "n", "asked").collect()))
    assert got == [(1, 1, 5), (1, 2, 7)]


def test_operation_failures(spark):
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    inputs = rows([(1, 1, 10, "a"), (1, 2, 20, "b"), (1, 3, 30, "c")], "key long, op long, at long, target string")
    requests = rows([(1, 1, "a"), (1, 2, "x")], "key long, op long, target string")
    settlements = rows([(1, 1, 11), (1, 2, 15), (1, 9, 90)], "key long, op long, at long")
    got = {tuple(r) for r in ledgers.operation_failures(inputs, requests, settlements).collect()}
    assert got == {(1, 2, "request-evidence"), (1, 2, "settlement-order"), (1, 3, "request-evidence"), (1, 3, "settlement-order"), (1, 9, "settlement-without-input")}


def test_folded_keeps_keys_apart(spark):
    out = ledgers.folded(log(spark, [1, 2, 3], "long"), ["key"], ["n"], ["v"], "total long", lambda: {"s": 0}, lambda s, r: (s.update(s=s["s"] + r[1]) or s["s"],))
    assert {(r["key"], r["n"]): r["total"] for r in out.collect()} == {(1, 0): 1, (1, 1): 3, (1, 2): 6, (2, 0): 1}
    assert out.where(F.col("total").isNull()).count() == 0
