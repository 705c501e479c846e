"""Registered queries that replay a player's decisions: submission horizons, deadlines, motion, visibility and raw inputs; joined into ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import policies
from .catalog import query
from .ledgers import _UNITS, _states
from .rules import _N, _numbered

_RING = 6


def _next(at: str) -> str:
    """SQL for the first portal at or after a place: frames 1, 4, 7, ... of a loop, else every third frame back from the last."""
    lap, rest = f"(({at}) // n * n)", f"(({at}) % n)"
    step = f"({rest} + ((1 - {rest}) % 3 + 3) % 3)"
    return f"CASE WHEN loops THEN {lap} + CASE WHEN {step} < n THEN {step} ELSE n + 1 END WHEN ({at}) < n THEN ({at}) + (n - 1 - ({at})) % 3 END"


def _found(kind: str, reason: str = "NULL", boundary: str = "NULL", wait: str = "NULL", total: str = "NULL") -> str:
    return f"struct_pack(kind := '{kind}', reason := CAST({reason} AS VARCHAR), boundary := CAST({boundary} AS BIGINT), wait := CAST({wait} AS BIGINT), total := CAST({total} AS BIGINT))"


def _late(needed: str) -> str:
    return _found("reject", "'max-wait-exceeded'", total=needed)


@query(f"""WITH {_UNITS}, i AS (SELECT edge, CASE WHEN edge % 5 = 0 THEN 'cut' WHEN edge % 5 = 1 AND unit % 3 = 0 THEN 'finish' ELSE 'portal' END AS start, unit % 3 <> 0 AS loops, frames AS n, edge % 4 AS elapsed, edge % 13 AS most, edge % 7 AS available, edge % 6 AS transition, edge % 8 = 3 AS reversible
FROM e JOIN s ON src = state), j AS (SELECT *, edge % n + CASE WHEN loops THEN edge % 4 * n ELSE 0 END AS shown FROM i), k AS (SELECT *, CASE WHEN loops THEN shown + edge % 11 ELSE least(shown + edge % 3, n - 1) END AS sent, reversible OR available >= least(greatest(transition + 1, 2), {_RING}) AS ready FROM j),
m AS (SELECT *, n - 1 - shown AS w, {_next("shown")} AS own, {_next("CASE WHEN reversible THEN shown ELSE greatest(shown, sent) END")} AS spot, {_next("shown + 1")} AS later FROM k),
d AS (SELECT edge, CASE WHEN elapsed + 1 > most THEN {_late("elapsed + 1")} ELSE {_found("restart", "'cut'", total="elapsed + 1")} END AS d FROM m WHERE start = 'cut'
UNION ALL SELECT edge, CASE WHEN elapsed + w > most THEN {_late("elapsed + w")} WHEN w > 0 THEN {_found("continue", boundary="n - 1", wait="w", total="elapsed + w")} WHEN ready THEN {_found("commit", boundary="n - 1", wait="0", total="elapsed")} WHEN elapsed >= most THEN {_late("elapsed + 1")}
ELSE {_found("hold", boundary="n - 1", wait="most - elapsed", total="elapsed")} END FROM m WHERE start = 'finish'
UNION ALL SELECT edge, CASE WHEN spot IS NULL THEN {_found("reject", "'no-reachable-boundary'", total="most + 1")} WHEN spot = shown AND ready AND elapsed > most THEN {_late("elapsed")} WHEN spot = shown AND ready THEN {_found("commit", boundary="spot", wait="0", total="elapsed")}
WHEN spot = shown AND later IS NULL AND w = 0 AND elapsed >= most THEN {_late("elapsed + 1")} WHEN spot = shown AND later IS NULL AND w = 0 THEN {_found("hold", boundary="spot", wait="most - elapsed", total="elapsed")} WHEN spot = shown AND elapsed + later - shown > most THEN {_late("elapsed + later - shown")}
WHEN spot = shown THEN {_found("select", "'lead-unavailable'", "later", "later - shown", "elapsed + later - shown")} WHEN elapsed + spot - shown > most THEN {_late("elapsed + spot - shown")}
ELSE {_found("select", "CASE WHEN spot > own THEN 'submitted-horizon' ELSE 'authored-boundary' END", "spot", "spot - shown", "elapsed + spot - shown")} END FROM m WHERE start = 'portal')
SELECT edge, d.kind AS kind, d.reason AS reason, d.boundary AS boundary, d.wait AS wait, d.total AS total FROM d""")
def horizon_decision(spark, d):
    """Where each order's edge leaves its source: bodies of one nation in three play once, the others loop."""
    s, e = _states(spark, d)
    edge, n, loops = F.col("edge"), F.col("frames"), F.col("loops")
    i = e.join(s, F.col("src") == F.col("state")).withColumn("loops", F.pmod("unit", F.lit(3)) != 0).withColumns({
        "start": F.when(edge % 5 == 0, "cut").when((edge % 5 == 1) & ~loops, "finish").otherwise("portal"),
        "portals": F.filter(F.sequence(F.lit(0).cast("long"), n - 1), lambda p: F.when(loops, p % 3 == 1).otherwise((n - 1 - p) % 3 == 0)),
        "displayed": edge % n + F.when(loops, edge % 4 * n).otherwise(0),
        "elapsed": edge % 4, "most": edge % 13, "available": edge % 7, "transition": edge % 6, "reversible": edge % 8 == 3,
    })
    i = i.withColumn("submitted", F.when(loops, F.col("displayed") + edge % 11).otherwise(F.least(F.col("displayed") + edge % 3, n - 1)))
    return policies.submission_horizon(i, _RING).select("edge", "kind", "reason", "boundary", "wait", "total")


def _micros(frame: str) -> str:
    return f"((({frame}) * 2002000000 + 30000) // 60000)"


@query(f"""WITH RECURSIVE o AS (SELECT user_id, event_id AS x, event_type AS t, {_N} FROM events), l AS (SELECT user_id, n, CASE WHEN n = 1 THEN 'start' WHEN t = 'signup' AND x % 5 = 0 THEN 'resume' WHEN t = 'error' AND x % 10 = 0 THEN 'pause' WHEN t = 'purchase' AND x % 6 = 1 THEN 'manual' ELSE 'callback' END AS op,
n * 20000 + x * 7919 % 20000 AS at_us, CASE WHEN x % 97 = 0 THEN 'stopped' WHEN x % 6 = 0 THEN 'underflow' ELSE 'advanced' END AS result FROM o),
w AS (SELECT user_id, CAST(0 AS BIGINT) AS n, false AS runs, CAST(NULL AS BIGINT) AS origin, CAST(1 AS BIGINT) AS frame, CAST(NULL AS BIGINT) AS deadline, CAST(NULL AS BIGINT) AS last, CAST(0 AS BIGINT) AS told, CAST(0 AS BIGINT) AS underflows, true AS smooth, '' AS status, CAST(NULL AS BIGINT) AS presented FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT user_id, n, CASE WHEN op IN ('start', 'resume') THEN true WHEN op = 'pause' OR r = 'stopped' THEN false ELSE runs END, o2, CAST(f2 AS BIGINT), CAST(CASE WHEN op = 'resume' OR r IN ('advanced', 'underflow') OR deadline IS NULL THEN o2 + {_micros("f2")} ELSE deadline END AS BIGINT),
CASE WHEN op = 'resume' THEN NULL WHEN op = 'callback' AND runs THEN at_us ELSE last END, CASE r WHEN 'advanced' THEN 0 WHEN 'underflow' THEN frame ELSE told END, CAST(underflows + CASE WHEN r = 'underflow' AND told <> frame THEN 1 ELSE 0 END AS BIGINT), smooth AND coalesce(r, 'advanced') = 'advanced',
CASE WHEN op IN ('start', 'resume') THEN 'running' WHEN op = 'pause' THEN 'paused' WHEN r IS NOT NULL THEN r WHEN op = 'manual' THEN 'refused' WHEN runs THEN 'not-due' ELSE 'ignored' END, CASE WHEN r IS NOT NULL THEN frame END
FROM (SELECT *, CAST(CASE WHEN op = 'resume' THEN at_us + {_micros("1")} - {_micros("frame")} WHEN op = 'callback' AND (r = 'underflow' OR (r = 'advanced' AND (at_us - last > {_micros("1")} OR origin + {_micros("frame + 1")} <= at_us))) THEN origin + at_us - deadline ELSE coalesce(origin, at_us) END AS BIGINT) AS o2, frame + CASE r WHEN 'advanced' THEN 1 ELSE 0 END AS f2
FROM (SELECT w.* EXCLUDE (n), l.n, op, at_us, CASE WHEN op = 'manual' AND NOT runs THEN result WHEN op = 'callback' AND runs AND at_us >= deadline THEN result END AS r FROM w JOIN l ON l.user_id = w.user_id AND l.n = w.n + 1)))
SELECT user_id, n, status, presented, deadline, underflows, smooth FROM w WHERE n > 0""")
def realtime_deadlines(spark, d):
    """Display callbacks of each user about every 20 ms against deadlines at 30000/1001 frames a second."""
    kind, x = F.col("event_type"), F.col("event_id")
    op = F.when(F.col("n") == 1, "start").when((kind == "signup") & (x % 5 == 0), "resume").when((kind == "error") & (x % 10 == 0), "pause").when((kind == "purchase") & (x % 6 == 1), "manual").otherwise("callback")
    result = F.when(x % 97 == 0, "stopped").when(x % 6 == 0, "underflow").otherwise("advanced")
    log = _numbered(spark, d).withColumn("op", op).withColumn("at", F.col("n").cast("long") * 20000 + x * 7919 % 20000).withColumn("result", result)
    return policies.realtime_ticks(log, ["user_id"], "n", "op", "at", "result", 30000, 1001)


_STAYS = ", ".join(f"'{x}'" for x in policies.REENTERED)


@query(f"""WITH RECURSIVE o AS (SELECT user_id, event_id, event_type AS t, {_N} FROM events), l AS (SELECT user_id, n, CASE WHEN n = 1 THEN CASE WHEN user_id % 2 = 0 THEN 'static' ELSE 'animated' END WHEN t = 'click' THEN 'commit' WHEN t = 'signup' THEN 'policy' WHEN t = 'error' THEN 'host'
WHEN t = 'purchase' AND event_id % 7 = 0 THEN 'fail' WHEN t = 'purchase' AND event_id % 7 = 1 THEN 'cancel' ELSE 'next' END AS op, event_id AS x FROM o),
v AS (SELECT *, CASE op WHEN 'static' THEN CASE WHEN user_id % 4 = 0 THEN 'codec-unsupported' ELSE 'reduced-motion' END WHEN 'policy' THEN CASE x % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'reduce' ELSE 'full' END WHEN 'host' THEN CASE WHEN x % 2 = 0 THEN 'reduce' ELSE 'none' END
WHEN 'fail' THEN CASE WHEN x % 5 = 0 THEN 'readiness-failed' ELSE 'context-loss' END END AS v, CASE WHEN op = 'commit' AND x % 4 = 0 THEN x % 6 END AS tok FROM l),
w AS (SELECT user_id, CAST(0 AS BIGINT) AS n, 'auto' AS policy, false AS host, 'unprepared' AS mode, CAST(NULL AS VARCHAR) AS origin, CAST(0 AS BIGINT) AS generation, CAST(NULL AS VARCHAR) AS pending, CAST(NULL AS BIGINT) AS since, '' AS outcome, 'full' AS desired FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT user_id, n, p2, h2, CASE WHEN done THEN CASE pending WHEN 'enter-reduced' THEN 'static' ELSE 'animated' END WHEN op = 'fail' THEN 'static' WHEN op IN ('animated', 'static') THEN op ELSE mode END, CASE WHEN done THEN CASE pending WHEN 'enter-reduced' THEN 'reduced-motion' END WHEN op IN ('fail', 'static') THEN v ELSE origin END,
CAST(generation + CASE WHEN changed OR op = 'fail' OR (op = 'cancel' AND pending IS NOT NULL) THEN 1 ELSE 0 END AS BIGINT), CASE WHEN done OR op IN ('fail', 'cancel') OR (changed AND (pending = 'enter-reduced') <> (d2 = 'reduce')) THEN NULL ELSE coalesce(pending, fresh) END, CASE WHEN pending IS NULL THEN generation ELSE since END,
CASE WHEN op = 'commit' THEN CASE WHEN done THEN 'committed' ELSE 'stale' END WHEN op IN ('animated', 'static') THEN 'installed' WHEN op = 'next' THEN coalesce(pending, fresh, 'none') WHEN op = 'fail' THEN 'failed' WHEN changed THEN 'changed' WHEN op = 'cancel' AND pending IS NOT NULL THEN 'cancelled' ELSE 'same' END, d2
FROM (SELECT *, CASE WHEN op = 'next' AND mode = 'animated' AND d2 = 'reduce' THEN 'enter-reduced' WHEN op = 'next' AND mode = 'static' AND origin IN ({_STAYS}) AND d2 = 'full' THEN 'enter-full' END AS fresh FROM (SELECT *, policy <> p2 OR host <> h2 AS changed, CASE WHEN p2 <> 'auto' THEN p2 WHEN h2 THEN 'reduce' ELSE 'full' END AS d2 FROM
(SELECT w.user_id, v.n, op, v, policy, host, mode, origin, generation, pending, since, op = 'commit' AND pending IS NOT NULL AND coalesce(tok, since) = since AS done, CASE WHEN op = 'policy' THEN v ELSE policy END AS p2, CASE WHEN op = 'host' THEN v = 'reduce' ELSE host END AS h2 FROM w JOIN v ON v.user_id = w.user_id AND v.n = w.n + 1))))
SELECT user_id, n, outcome, mode, desired, generation, pending, origin, coalesce(mode = 'static' AND origin NOT IN ({_STAYS}), false) AS sticky FROM w WHERE n > 0""")
def motion_policy(spark, d):
    kind, x, user = F.col("event_type"), F.col("event_id"), F.col("user_id")
    first = F.when(user % 2 == 0, "static").otherwise("animated")
    op = F.when(F.col("n") == 1, first).when(kind == "click", "commit").when(kind == "signup", "policy").when(kind == "error", "host").when((kind == "purchase") & (x % 7 == 0), "fail").when((kind == "purchase") & (x % 7 == 1), "cancel").otherwise("next")
    log = _numbered(spark, d).withColumn("op", op)
    value = (
        F.when(F.col("op") == "static", F.when(user % 4 == 0, "codec-unsupported").otherwise("reduced-motion")).when(F.col("op") == "policy", F.element_at(F.array(*map(F.lit, ("auto", "reduce", "full"))), (x % 3 + 1).cast("int")))
        .when(F.col("op") == "host", F.when(x % 2 == 0, "reduce").otherwise("none")).when(F.col("op") == "fail", F.when(x % 5 == 0, "readiness-failed").otherwise("context-loss"))
    )
    log = log.withColumn("value", value).withColumn("named", F.when((F.col("op") == "commit") & (x % 4 == 0), x % 6))
    return policies.motion(log, ["user_id"], "n", "op", "value", "named")


@query(f"""WITH RECURSIVE l AS (SELECT user_id, {_N}, CASE WHEN event_type = 'signup' THEN 'hidden' WHEN event_type = 'view' THEN 'visible' WHEN event_type = 'error' AND event_id % 9 = 0 THEN 'fail' WHEN event_type = 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'suspended' ELSE 'active' END ELSE 'next' END AS op, CASE WHEN event_id % 5 = 0 THEN event_id % 8 END AS tok, event_id AS x FROM events),
w AS (SELECT user_id, CAST(0 AS BIGINT) AS n, 'visible' AS visibility, 'active' AS suspension, CAST(0 AS BIGINT) AS generation, CAST(NULL AS BIGINT) AS frozen, false AS rebuild, CAST(NULL AS VARCHAR) AS pending, '' AS outcome FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT user_id, n, CASE WHEN turned THEN op ELSE visibility END, CASE WHEN turned AND op = 'hidden' AND suspension = 'active' THEN 'suspending' WHEN back THEN 'active' WHEN done AND op <> 'fail' THEN op ELSE suspension END, CAST(generation + CASE WHEN turned THEN 1 ELSE 0 END AS BIGINT),
CASE WHEN back OR (done AND op = 'active') THEN NULL WHEN done AND op = 'suspended' THEN x ELSE frozen END, CASE WHEN turned THEN op = 'visible' AND suspension = 'suspended' AND frozen IS NOT NULL WHEN done THEN false ELSE rebuild END, CASE WHEN turned OR done THEN NULL ELSE coalesce(pending, fresh) END,
CASE WHEN op IN ('hidden', 'visible') THEN CASE WHEN turned THEN 'changed' ELSE 'same' END WHEN op = 'next' THEN coalesce(pending, fresh, 'none') WHEN NOT done THEN 'stale' WHEN op = 'fail' THEN 'failed' ELSE 'committed' END
FROM (SELECT w.*  EXCLUDE (n), l.n, op, x, op IN ('hidden', 'visible') AND op <> visibility AS turned, op = 'visible' AND visibility = 'hidden' AND (suspension = 'suspending' OR (suspension = 'suspended' AND frozen IS NULL)) AS back,
coalesce(pending = CASE op WHEN 'suspended' THEN 'suspend' WHEN 'active' THEN 'resume' WHEN 'fail' THEN 'resume' END AND coalesce(tok, generation) = generation, false) AS done, CASE WHEN op = 'next' AND suspension = 'suspending' THEN 'suspend' WHEN op = 'next' AND visibility = 'visible' AND rebuild THEN 'resume' END AS fresh
FROM w JOIN l ON l.user_id = w.user_id AND l.n = w.n + 1)) SELECT * FROM w WHERE n > 0""")
def visibility_policy(spark, d):
    kind, x = F.col("event_type"), F.col("event_id")
    op = F.when(kind == "signup", "hidden").when(kind == "view", "visible").when((kind == "error") & (x % 9 == 0), "fail").when(kind == "click", F.when(x % 2 == 0, "suspended").otherwise("active")).otherwise("next")
    return policies.visibility(_numbered(spark, d).withColumn("op", op).withColumn("named", F.when(x % 5 == 0, x % 8)), ["user_id"], "n", "op", "named", "event_id")


@query(f"""WITH RECURSIVE o AS (SELECT user_id, event_id AS x, event_type AS t, {_N} FROM events), l AS (SELECT user_id, n, x, CASE WHEN n = 1 THEN 'target' WHEN n = 2 THEN 'ready' WHEN t = 'view' THEN 'pointerenter' WHEN t = 'click' THEN CASE WHEN x % 2 = 0 THEN 'click' ELSE 'pointerleave' END WHEN t = 'signup' THEN 'focusin' WHEN t = 'purchase' THEN 'focusout'
ELSE CASE x % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'shown' WHEN 2 THEN 'enabled' ELSE 'sample' END END AS op, n <= 2 OR x % 3 = 0 AS flag, x % 2 = 0 AS hover, x % 7 < 3 AS focused FROM o),
w AS (SELECT user_id, CAST(0 AS BIGINT) AS n, true AS enabled, false AS ready, true AS shown, false AS target, false AS touch, false AS pointer, false AS focus, '' AS sources FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT user_id, n, e2, r2, s2, t2, q, p2, f2, CASE WHEN NOT (e2 AND r2 AND s2) THEN '' WHEN taken THEN CASE WHEN p2 THEN 'pointer.enter' ELSE 'pointer.leave' END || CASE WHEN f2 THEN ',focus.in' ELSE ',focus.out' END || CASE WHEN p2 OR f2 THEN ',engagement.on' ELSE ',engagement.off' END
WHEN NOT heard THEN '' ELSE concat_ws(',', CASE WHEN op = 'pointerenter' AND NOT flag THEN 'pointer.enter' WHEN op = 'pointerleave' AND NOT flag THEN 'pointer.leave' WHEN op = 'focusin' THEN 'focus.in' WHEN op = 'focusout' AND NOT flag THEN 'focus.out' WHEN op = 'click' THEN 'activate' END, CASE WHEN (p2 OR f2) AND NOT (pointer OR focus) THEN 'engagement.on' WHEN (pointer OR focus) AND NOT (p2 OR f2) THEN 'engagement.off' END) END
FROM (SELECT *, CASE WHEN taken THEN hover AND NOT q WHEN heard AND op = 'pointerenter' THEN NOT flag WHEN heard AND op = 'pointerleave' THEN false ELSE pointer END AS p2, CASE WHEN taken THEN focused WHEN heard AND op = 'focusin' THEN true WHEN heard AND op = 'focusout' AND NOT flag THEN false ELSE focus END AS f2
FROM (SELECT *, e2 AND r2 AND s2 AND t2 AND (op = 'sample' OR (flag AND (op = 'ready' OR (op = 'shown' AND NOT shown) OR (op = 'enabled' AND NOT enabled) OR (op = 'target' AND NOT target)))) AS taken, CASE WHEN e2 <> enabled OR t2 <> target THEN false WHEN heard AND op IN ('pointerenter', 'pointerleave') THEN flag ELSE touch END AS q
FROM (SELECT w.* EXCLUDE (n), l.n, op, flag, hover, focused, CASE WHEN op = 'enabled' THEN flag ELSE enabled END AS e2, CASE WHEN op = 'ready' THEN flag ELSE ready END AS r2, CASE WHEN op = 'shown' THEN flag ELSE shown END AS s2, CASE WHEN op = 'target' THEN flag ELSE target END AS t2,
enabled AND target AND op IN ('pointerenter', 'pointerleave', 'focusin', 'focusout', 'click') AS heard FROM w JOIN l ON l.user_id = w.user_id AND l.n = w.n + 1)))) SELECT user_id, n, sources, pointer OR focus AS engaged FROM w WHERE n > 0""")
def input_bindings(spark, d):
    kind, x, n = F.col("event_type"), F.col("event_id"), F.col("n")
    condition = F.when(x % 4 == 0, "ready").when(x % 4 == 1, "shown").when(x % 4 == 2, "enabled").otherwise("sample")
    op = F.when(n == 1, "target").when(n == 2, "ready").when(kind == "view", "pointerenter").when(kind == "click", F.when(x % 2 == 0, "click").otherwise("pointerleave")).when(kind == "signup", "focusin").when(kind == "purchase", "focusout").otherwise(condition)
    log = _numbered(spark, d).withColumn("op", op).withColumn("flag", (n <= 2) | (x % 3 == 0)).withColumn("hover", x % 2 == 0).withColumn("focused", x % 7 < 3)
    return policies.automatic_inputs(log, ["user_id"], "n", "op", "flag", "hover", "focused")
