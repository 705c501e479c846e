"""Replayed decisions on literal rows, with values worked out by hand."""

from tidemark.operators import policies


def test_submission_horizon(spark):
    # a finite body of 8 frames and a loop of 8 with portals at 1 and 4; the lead is 3 frames where not said otherwise
    base = dict(start="portal", loops=True, frames=8, portals=[1, 4], displayed=2, submitted=2, elapsed=0, most=20, available=6, transition=2, reversible=False)
    last = dict(loops=False, portals=[3, 7], displayed=7, submitted=7)
    cases = [
        ({"start": "cut", "elapsed": 3, "most": 4}, ("restart", "cut", None, None, 4)), ({"start": "cut", "elapsed": 4, "most": 4}, ("reject", "max-wait-exceeded", None, None, 5)),
        ({}, ("select", "authored-boundary", 4, 2, 2)), ({"submitted": 5}, ("select", "submitted-horizon", 9, 7, 7)), ({"submitted": 5, "reversible": True}, ("select", "authored-boundary", 4, 2, 2)),
        ({"displayed": 20, "submitted": 20}, ("commit", None, 20, 0, 0)), ({"displayed": 20, "submitted": 20, "available": 2}, ("select", "lead-unavailable", 25, 5, 5)), ({"displayed": 20, "submitted": 20, "available": 2, "most": 4}, ("reject", "max-wait-exceeded", None, None, 5)),
        ({"displayed": 20, "submitted": 20, "available": 0, "reversible": True}, ("commit", None, 20, 0, 0)), ({"displayed": 4, "submitted": 4, "elapsed": 5, "most": 4}, ("reject", "max-wait-exceeded", None, None, 5)),
        (last | {"available": 2, "elapsed": 1}, ("hold", None, 7, 19, 1)), (last | {"available": 2, "elapsed": 20}, ("reject", "max-wait-exceeded", None, None, 21)), (last | {"portals": [3]}, ("reject", "no-reachable-boundary", None, None, 21)), ({"portals": []}, ("reject", "no-reachable-boundary", None, None, 21)),
        (last | {"start": "finish", "displayed": 2}, ("continue", None, 7, 5, 5)), (last | {"start": "finish"}, ("commit", None, 7, 0, 0)), (last | {"start": "finish", "available": 2, "elapsed": 3}, ("hold", None, 7, 17, 3)), (last | {"start": "finish", "available": 2, "elapsed": 20}, ("reject", "max-wait-exceeded", None, None, 21)),
        (last | {"start": "finish", "available": 2, "elapsed": 21}, ("reject", "max-wait-exceeded", None, None, 21)), ({"start": "finish"}, ("reject", "no-reachable-boundary", None, None, 21)), ({"start": None}, ("reject", "no-reachable-boundary", None, None, 21)),
    ]
    kinds = "k long, start string, loops boolean, frames long, portals array<long>, displayed long, submitted long, elapsed long, most long, available long, transition long, reversible boolean"
    rows = spark.createDataFrame([(k, *(base | change).values()) for k, (change, _) in enumerate(cases)], kinds)
    got = policies.submission_horizon(rows, 6).orderBy("k")
    assert set(got.columns) == {*rows.columns, "kind", "boundary", "reason", "wait", "total"}
    assert [tuple(r) for r in got.select("kind", "reason", "boundary", "wait", "total").collect()] == [want for _, want in cases]
    assert policies.submission_horizon(rows.limit(0), 6).collect() == []


def test_motion_policy(spark):
    ops = [
        ("next", None, None), ("animated", None, None), ("host", "reduce", None), ("next", None, None), ("policy", "reduce", None), ("commit", None, 0), ("commit", None, 1), ("policy", "full", None), ("next", None, None), ("policy", "auto", None), ("commit", None, None),
        ("fail", "readiness-failed", None), ("policy", "full", None), ("next", None, None), ("fail", "context-loss", None), ("next", None, None), ("cancel", None, None), ("fail", "reduced-motion", None), (None, None, None), ("dispose", None, None), ("policy", "auto", None),
    ]
    rows = spark.createDataFrame([(1, k, *o) for k, o in enumerate(ops)], "key long, n long, op string, v string, g long")
    got = [tuple(r)[2:] for r in policies.motion(rows, ["key"], "n", "op", "v", "g").orderBy("n").collect()]
    assert got == [
        ("none", "unprepared", "full", 0, None, None, False), ("installed", "animated", "full", 0, None, None, False), ("changed", "animated", "reduce", 1, None, None, False), ("enter-reduced", "animated", "reduce", 1, "enter-reduced", None, False),
        ("changed", "animated", "reduce", 2, "enter-reduced", None, False), ("stale", "animated", "reduce", 2, "enter-reduced", None, False), ("committed", "static", "reduce", 2, None, "reduced-motion", False), ("changed", "static", "full", 3, None, "reduced-motion", False),
        ("enter-full", "static", "full", 3, "enter-full", "reduced-motion", False), ("changed", "static", "reduce", 4, None, "reduced-motion", False), ("stale", "static", "reduce", 4, None, "reduced-motion", False), ("failed", "static", "reduce", 5, None, "readiness-failed", True),
        ("changed", "static", "full", 6, None, "readiness-failed", True), ("none", "static", "full", 6, None, "readiness-failed", True), ("failed", "static", "full", 7, None, "context-loss", False), ("enter-full", "static", "full", 7, "enter-full", "context-loss", False),
        ("cancelled", "static", "full", 8, None, "context-loss", False), ("refused", "static", "full", 8, None, "context-loss", False), ("same", "static", "full", 8, None, "context-loss", False), ("disposed", "disposed", "full", 9, None, None, False), ("refused", "disposed", "full", 9, None, None, False),
    ]


def test_visibility_policy(spark):
    ops = [
        ("hidden", None, None), ("next", None, None), ("visible", None, None), ("suspended", 1, 5), ("hidden", None, None), ("next", None, None), ("suspended", 3, 5), ("visible", None, None), ("next", None, None), ("fail", 4, None), ("next", None, None),
        ("hidden", None, None), ("visible", None, None), ("next", None, None), ("active", None, None), ("visible", None, None), ("dispose", None, None), ("hidden", None, None),
    ]
    rows = spark.createDataFrame([(1, k, *o) for k, o in enumerate(ops)], "key long, n long, op string, g long, at long")
    got = [tuple(r)[2:] for r in policies.visibility(rows, ["key"], "n", "op", "g", "at").orderBy("n").collect()]
    assert got == [
        ("changed", "hidden", "suspending", 1, None, False, None), ("suspend", "hidden", "suspending", 1, None, False, "suspend"), ("changed", "visible", "active", 2, None, False, None), ("stale", "visible", "active", 2, None, False, None), ("changed", "hidden", "suspending", 3, None, False, None),
        ("suspend", "hidden", "suspending", 3, None, False, "suspend"), ("committed", "hidden", "suspended", 3, 5, False, None), ("changed", "visible", "suspended", 4, 5, True, None), ("resume", "visible", "suspended", 4, 5, True, "resume"), ("failed", "visible", "suspended", 4, 5, False, None),
        ("none", "visible", "suspended", 4, 5, False, None), ("changed", "hidden", "suspended", 5, 5, False, None), ("changed", "visible", "suspended", 6, 5, True, None), ("resume", "visible", "suspended", 6, 5, True, "resume"), ("committed", "visible", "active", 6, None, False, None),
        ("same", "visible", "active", 6, None, False, None), ("disposed", "visible", "active", 7, None, False, None), ("refused", "visible", "active", 7, None, False, None),
    ]
    first = spark.createDataFrame([(1, 0, "initial", None, 3), (1, 1, "visible", None, None), (2, 0, "visible", None, None)], rows.schema)
    got = sorted(tuple(r) for r in policies.visibility(first, ["key"], "n", "op", "g", "at", "hidden").collect())
    assert got == [(1, 0, "installed", "hidden", "suspended", 0, 3, False, None), (1, 1, "changed", "visible", "suspended", 1, 3, True, None), (2, 0, "changed", "visible", "active", 1, None, False, None)]


def test_automatic_inputs(spark):
    ops = [
        ("pointerenter", False, ""), ("target", True, ""), ("pointerenter", False, ""), ("ready", True, "pointer.enter,focus.out,engagement.on"), ("pointerenter", True, "engagement.off"), ("sample", None, "pointer.leave,focus.out,engagement.off"), ("focusin", False, "focus.in,engagement.on"), ("focusout", True, ""),
        ("pointerleave", False, "pointer.leave"), ("focusout", False, "focus.out,engagement.off"), ("click", None, "activate"), ("shown", False, ""), ("click", None, ""), ("shown", True, "pointer.enter,focus.out,engagement.on"), ("shown", True, ""), ("enabled", False, ""), ("pointerleave", False, ""),
        ("enabled", True, "pointer.enter,focus.out,engagement.on"), ("target", False, ""), ("click", None, ""), (None, None, ""),
    ]
    rows = spark.createDataFrame([(1, k, op, flag, True, False) for k, (op, flag, _) in enumerate(ops)], "key long, n long, op string, f boolean, h boolean, x boolean")
    got = [r["sources"] for r in policies.automatic_inputs(rows, ["key"], "n", "op", "f", "h", "x").orderBy("n").collect()]
    assert got == [want for _, _, want in ops]


def test_realtime_ticks(spark):
    # frames of 10 ms
    ops = [
        ("callback", 0, None), ("start", 1000, None), ("callback", 10999, "advanced"), ("callback", 11000, "advanced"), ("callback", 20000, "advanced"), ("callback", 23000, "underflow"), ("callback", 23001, "underflow"), ("callback", 33000, "advanced"), ("callback", 44000, "advanced"),
        ("callback", 53000, "advanced"), ("callback", 58000, "advanced"), ("manual", 0, "advanced"), ("pause", None, None), ("callback", 60000, "advanced"), ("manual", 0, "advanced"), ("manual", 0, "underflow"), ("resume", 100000, None), ("callback", 110000, "underflow"), ("callback", 140000, "advanced"), ("callback", 139999, "advanced"),
        ("callback", 150000, "advanced"), (None, None, None), ("start", 160000, None), ("callback", 170000, "stopped"), ("start", None, None), ("stop", None, None),
    ]
    rows = spark.createDataFrame([(1, k, *o) for k, o in enumerate(ops)], "key long, n long, op string, at long, result string")
    got = [tuple(r)[2:] for r in policies.realtime_ticks(rows, ["key"], "n", "op", "at", "result", 100, 1).orderBy("n").collect()]
    assert got == [
        ("ignored", None, None, 0, True), ("running", None, 11000, 0, True), ("not-due", None, 11000, 0, True), ("advanced", 1, 21000, 0, True), ("not-due", None, 21000, 0, True), ("underflow", 2, 23000, 1, False), ("underflow", 2, 23001, 1, False), ("advanced", 2, 33001, 1, False),
        ("advanced", 3, 54000, 1, False), ("not-due", None, 54000, 1, False), ("advanced", 4, 64000, 1, False), ("refused", None, 64000, 1, False), ("paused", None, 64000, 1, False), ("ignored", None, 64000, 1, False), ("advanced", 5, 74000, 1, False), ("underflow", 6, 74000, 2, False),
        ("running", None, 110000, 2, False), ("underflow", 6, 110000, 2, False), ("advanced", 6, 150000, 2, False), ("failed", None, 150000, 2, False), ("ignored", None, 150000, 2, False), ("same", None, 150000, 2, False), ("running", None, 150000, 2, False), ("stopped", 7, 150000, 2, False),
        ("failed", None, 150000, 2, False), ("stopped", None, 150000, 2, False),
    ]
