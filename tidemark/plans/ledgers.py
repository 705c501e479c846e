"""Registered queries on evidence and resource ledgers, boundaries, release sets and selections; joined into ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from ..operators import integrity, ledgers, timeline
from .catalog import DAY, HOUR, query, table, timed

_SCHEDULE = ["view", "click", "purchase", "view", "signup", "error", "click"]


_PLACES = "list_filter(CAST(range(0, 7) AS BIGINT[]), lambda k: ['view', 'click', 'purchase', 'view', 'signup', 'error', 'click'][k + 1] = v)"


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_type AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, {_PLACES.replace("= v", "= event_type")} AS ps FROM events),
w AS (SELECT user_id, CAST(0 AS BIGINT) AS n, '' AS verdict, CAST(-1 AS BIGINT) AS place FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT user_id, n, CASE WHEN list_contains(ps, place) THEN 'repeat' WHEN later = place + 1 THEN 'advance' WHEN later IS NOT NULL THEN 'skip' WHEN len(list_filter(ps, lambda k: k < place)) > 0 THEN 'regression' ELSE 'identity' END, CASE WHEN list_contains(ps, place) THEN place ELSE coalesce(later, place) END
FROM (SELECT e.user_id, e.n, ps, place, list_min(list_filter(ps, lambda k: k > place)) AS later FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)) SELECT user_id, n, verdict, place FROM w WHERE n > 0""")
def schedule_alignment(spark, d):
    e = timed(spark, d).withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("us", "event_id")))
    return ledgers.aligned(e, ["user_id"], "n", "event_type", _SCHEDULE)


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CAST(floor(value) AS BIGINT) * CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS b FROM events),
w AS (SELECT user_id, CAST(0 AS BIGINT) AS n, true AS ok, CAST(0 AS BIGINT) AS held FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT e.user_id, e.n, held + b <= 500, CASE WHEN held + b <= 500 THEN greatest(0, held + b) ELSE held END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1) SELECT user_id, n, ok, held FROM w WHERE n > 0""")
def byte_admission(spark, d):
    e = timed(spark, d, "value").withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("us", "event_id")))
    amount = F.floor("value").cast("long") * F.when(F.col("event_type") == "error", -1).otherwise(1)
    return ledgers.admitted(e.withColumn("bytes", amount), ["user_id"], "n", "bytes", 500)


@query("""WITH t AS (SELECT user_id, event_id, event_type = 'signup' AS stale, event_type = 'error' AS hid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
c AS (SELECT *, coalesce(sum(CASE WHEN NOT stale AND NOT hid THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM t)
SELECT user_id, event_id, CASE WHEN taken >= 8 THEN 'queued' WHEN stale THEN 'cancelled' WHEN hid THEN 'parked' ELSE 'granted' END AS verdict FROM c""")
def decoder_grants(spark, d):
    e = timed(spark, d).withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("us", "event_id")))
    e = e.withColumn("stale", F.col("event_type") == "signup").withColumn("hid", F.col("event_type") == "error")
    return ledgers.granted(e, ["user_id"], "n", "hid", "stale", 8).select("user_id", "event_id", "verdict")


@query("""WITH c AS (SELECT c_nationkey, c_custkey, CASE WHEN c_acctbal < 0 THEN 2 ELSE 4 END AS rank, CAST(floor(abs(c_acctbal)) AS BIGINT) AS bytes FROM customer),
r AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY c_nationkey ORDER BY rank, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(bytes) OVER (PARTITION BY c_nationkey) AS total FROM c)
SELECT c_nationkey, c_custkey, CAST(least(bytes, 20000 - before) AS BIGINT) AS asked FROM r WHERE total >= 20000 AND before < 20000 AND bytes > 0""")
def reclamation_plan(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_acctbal") < 0, 2).otherwise(4).alias("rank"), F.floor(F.abs("c_acctbal")).cast("long").alias("bytes"))
    return ledgers.reclaimed(c, ["c_nationkey"], ["rank", "c_custkey"], "bytes", 20000).select("c_nationkey", "c_custkey", "asked")


_OPS = """c AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS op, epoch_us(ts) AS us, value FROM events WHERE event_type = 'click'),
v AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS op, epoch_us(ts) AS us, value FROM events WHERE event_type = 'view'),
p AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS op, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase')"""


@query(f"""WITH {_OPS}, j AS (SELECT c.key, c.op, c.us, floor(c.value / 50) AS t, floor(v.value / 50) AS a, p.us AS done FROM c LEFT JOIN v ON c.key = v.key AND c.op = v.op LEFT JOIN p ON c.key = p.key AND c.op = p.op)
SELECT key, op, 'request-evidence' AS code FROM j WHERE a IS DISTINCT FROM t UNION ALL SELECT key, op, 'settlement-order' FROM j WHERE done IS NULL OR done < us
UNION ALL SELECT p.key, p.op, 'settlement-without-input' FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.key = p.key AND c.op = p.op)""")
def operation_evidence(spark, d):
    def of(kind):
        n = F.row_number().over(W.partitionBy("user_id").orderBy("us", "event_id"))
        return timed(spark, d, "value").where(F.col("event_type") == kind).select(F.col("user_id").alias("key"), n.alias("op"), F.col("us").alias("at"), F.floor(F.col("value") / 50).alias("target"))

    return ledgers.operation_failures(of("click"), of("view"), of("purchase"))


@query("""WITH s AS (SELECT user_id, epoch_us(ts) AS us, event_id, CASE event_type WHEN 'view' THEN 3 ELSE -1 END AS credit FROM events)
SELECT user_id, event_id, CAST(sum(credit) OVER (PARTITION BY user_id ORDER BY us, event_id) AS BIGINT) AS balance FROM s""")
def frame_credit(spark, d):
    w = W.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return timed(spark, d).select("user_id", "event_id", F.sum(F.when(F.col("event_type") == "view", 3).otherwise(-1)).over(w).alias("balance"))


@query("""WITH p AS (SELECT user_id, list_sort(list(DISTINCT CAST(hour(ts) AS BIGINT))) AS ps FROM events WHERE event_type = 'purchase' GROUP BY user_id),
c AS (SELECT user_id, event_id, CAST(hour(ts) AS BIGINT) AS f FROM events WHERE event_type = 'view'),
b AS (SELECT event_id, f, coalesce(list_min(list_filter(ps, lambda x: x >= f)), ps[1] + 24) AS portal FROM c JOIN p ON c.user_id = p.user_id)
SELECT event_id, least(portal, 23) AS boundary, CASE WHEN 23 < portal THEN 'finish' WHEN portal < 23 THEN 'portal' ELSE 'finish' END AS type, least(portal, 23) + 6 AS horizon FROM b""")
def earliest_boundary(spark, d):
    e = timed(spark, d).withColumn("f", F.pmod(S.int_div("us", HOUR), F.lit(24).cast("long")))
    ps = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.sort_array(F.collect_set("f")).alias("ps"))
    both = e.where("event_type = 'view'").join(ps, "user_id")
    portal, _ = timeline.portal_boundary(F.col("ps"), F.col("f"), 24)
    first = F.array_min(F.array(F.struct(portal.alias("at"), F.lit("portal").alias("type")), F.struct(F.lit(23).cast("long").alias("at"), F.lit("finish").alias("type"))))
    return both.select("event_id", first["at"].alias("boundary"), first["type"].alias("type"), (first["at"] + 6).alias("horizon"))


@query("""WITH s AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS authored, bool_or(l_discount < 0.02) AS ok, count(*) AS n FROM lineitem GROUP BY ALL),
f AS (SELECT l_orderkey, min((authored, l_suppkey)) FILTER (ok) AS best FROM s GROUP BY l_orderkey)
SELECT s.l_orderkey, best[2] AS source, count(*) FILTER (best IS NULL OR (authored, l_suppkey) <= best) AS attempts FROM s JOIN f ON s.l_orderkey = f.l_orderkey GROUP BY s.l_orderkey, best""".replace("best[2]", "struct_extract_at(best, 2)"))
def first_source(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("authored"), F.bool_or(F.col("l_discount") < 0.02).alias("ok"))
    spot = F.struct("authored", "l_suppkey")
    best = s.groupBy("l_orderkey").agg(F.min(F.when(F.col("ok"), spot)).alias("best"))
    return s.join(best, "l_orderkey").groupBy("l_orderkey", "best").agg(F.count_if(F.col("best").isNull() | (spot <= F.col("best"))).alias("attempts")).select("l_orderkey", F.col("best.l_suppkey").alias("source"), "attempts")


@query("""WITH u AS (SELECT o_orderkey, CAST(o_custkey % 7 AS BIGINT) AS a, CAST(o_custkey % 7 + 1 + o_orderkey % 5 AS BIGINT) AS b, o_custkey % 50 AS rendition FROM orders), f AS (SELECT rendition, o_orderkey, unnest(range(a, b)) AS frame FROM u),
g AS (SELECT rendition, frame, min(o_orderkey) AS first_use, count(*) AS uses FROM f GROUP BY ALL) SELECT rendition, frame, first_use, uses, row_number() OVER (PARTITION BY rendition ORDER BY first_use, frame) - 1 AS layer FROM g""")
def semantic_layers(spark, d):
    a = F.pmod("o_custkey", F.lit(7)).cast("long")
    u = table(spark, d, "orders").select("o_orderkey", F.pmod("o_custkey", F.lit(50)).alias("rendition"), F.explode(F.sequence(a, a + F.pmod("o_orderkey", F.lit(5)))).alias("frame"))
    g = u.groupBy("rendition", "frame").agg(F.min("o_orderkey").alias("first_use"), F.count(F.lit(1)).alias("uses"))
    return g.withColumn("layer", F.row_number().over(W.partitionBy("rendition").orderBy("first_use", "frame")) - 1)


@query("""WITH p AS (SELECT concat_ws(' ', p_brand, p_name) AS name, coalesce(p_type < 'M', true) AS declared, p_size FROM part),
b AS (SELECT name, max(p_size) AS v FROM p WHERE declared GROUP BY name), t AS (SELECT name, max(p_size) AS v FROM p WHERE NOT declared GROUP BY name)
SELECT coalesce(b.name, t.name) AS name, CASE WHEN t.name IS NULL THEN 'missing' WHEN b.name IS NULL THEN 'unknown' WHEN b.v <> t.v THEN 'version' ELSE 'ok' END AS verdict FROM b FULL JOIN t ON b.name = t.name""")
def release_set(spark, d):
    declared = F.coalesce(F.col("p_type") < "M", F.lit(True))
    p = table(spark, d, "part").withColumn("name", F.concat_ws(" ", "p_brand", "p_name"))
    return _verdicts(p.where(declared), p.where(~declared))


def _verdicts(declared, found):
    """(name, verdict): each name's largest size on either side."""
    side = lambda df, v: df.groupBy("name").agg(F.max("p_size").alias(v))
    both = side(declared, "b").join(side(found, "t"), "name", "full")
    verdict = F.when(F.col("t").isNull(), "missing").when(F.col("b").isNull(), "unknown").when(F.col("b") != F.col("t"), "version").otherwise("ok")
    return both.select("name", verdict.alias("verdict"))


@query("""WITH s AS (SELECT l_returnflag, l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes, count(*) AS chunks FROM lineitem GROUP BY ALL)
SELECT l_returnflag AS kind, CAST(sum(bytes) AS BIGINT) AS total_bytes, max(bytes) AS largest, min_by(l_orderkey, (-bytes, l_orderkey)) AS largest_unit, (max(bytes) * 5 + 3) // 4 AS allocated FROM s GROUP BY l_returnflag""")
def resource_estimate(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_returnflag", "l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("bytes"))
    return s.groupBy(F.col("l_returnflag").alias("kind")).agg(F.sum("bytes").alias("total_bytes"), F.max("bytes").alias("largest"), F.min_by("l_orderkey", F.struct(-F.col("bytes"), "l_orderkey")).alias("largest_unit"), S.allocation(F.max("bytes")).alias("allocated"))


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 86400000000 AS day, event_type FROM events),
r AS (SELECT user_id, day, event_id, event_type, lead(event_type) OVER (PARTITION BY user_id, day ORDER BY event_id) AS nxt FROM e)
SELECT event_type AS source, nxt AS target, h AS horizon, count(*) AS cases, min(event_id) AS first_case, h >= 2 AS ready FROM r, (SELECT unnest(range(0, 4)) AS h) WHERE nxt IS NOT NULL GROUP BY ALL""")
def edge_scenarios(spark, d):
    e = timed(spark, d).withColumn("day", S.int_div("us", DAY))
    r = e.withColumn("target", F.lead("event_type").over(W.partitionBy("user_id", "day").orderBy("event_id"))).where("target IS NOT NULL")
    pairs = r.groupBy(F.col("event_type").alias("source"), "target").agg(F.count(F.lit(1)).alias("cases"), F.min("event_id").alias("first_case"))
    return pairs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("horizon")).withColumn("ready", F.col("horizon") >= 2)


@query("""SELECT user_id, array_to_string(list_reverse(list(CAST(event_id AS VARCHAR) ORDER BY ts, event_id)), ',') AS rollback FROM events WHERE event_type = 'signup' GROUP BY user_id""")
def rollback_order(spark, d):
    made = F.sort_array(F.collect_list(F.struct("us", "event_id")), asc=False)
    return timed(spark, d).where("event_type = 'signup'").groupBy("user_id").agg(F.array_join(F.transform(made, lambda x: x["event_id"].cast("string")), ",").alias("rollback"))


@query("""SELECT page_id, 'profile-' || left(sha256(coalesce(url, '')), 20) AS profile, regexp_replace(coalesce(url, ''), '://[^/?#]+', '://<host>', 'g') AS redacted FROM pages""")
def public_profiles(spark, d):
    url = F.coalesce("url", F.lit(""))
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("profile-"), F.substring(F.sha2(url.cast("binary"), 256), 1, 20)).alias("profile"), F.regexp_replace(url, "://[^/?#]+", "://<host>").alias("redacted"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'enter' WHEN 'click' THEN 'press' WHEN 'error' THEN 'leave' END AS routed FROM events WHERE event_type IN ('view', 'click', 'error')""")
def bound_events(spark, d):
    bindings = spark.sql("SELECT * FROM VALUES ('view', 'enter'), ('click', 'press'), ('error', 'leave') AS t(event_type, routed)")
    return timed(spark, d).join(F.broadcast(bindings), "event_type").select("event_id", "routed")


@query("""WITH e AS (SELECT o_custkey AS state, o_orderkey, o_orderstatus <> 'O' AS bridged, l_suppkey, s_suppkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey)
SELECT c_custkey AS state, 'own-body' AS kind, c_custkey AS id FROM customer UNION SELECT c_custkey, 'initial', c_nationkey FROM customer WHERE c_acctbal < 0
UNION SELECT state, 'edge', o_orderkey FROM e UNION SELECT state, 'transition', o_orderkey FROM e WHERE bridged UNION SELECT state, CASE WHEN s_suppkey IS NULL THEN 'missing-target' ELSE 'target-body' END, l_suppkey FROM e""")
def readiness_closure(spark, d):
    """Every customer as initial state: its own units, and one hop over its orders' lines to suppliers' bodies and the orders' transitions."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("state"), "c_nationkey", "c_acctbal")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("state"), "o_orderkey", "o_orderstatus").join(c.select("state"), "state")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").distinct()
    targets = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("there"))
    e = o.join(lines, "o_orderkey").join(targets, "l_suppkey", "left")
    unit = lambda kind, key, when=True: F.when(F.lit(when) if when is True else when, F.struct(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id")))
    target = F.struct(F.when(F.col("there"), "target-body").otherwise("missing-target").alias("kind"), F.col("l_suppkey").cast("long").alias("id"))
    own = c.select("state", F.explode(F.array_compact(F.array(unit("own-body", "state"), unit("initial", "c_nationkey", F.col("c_acctbal") < 0)))).alias("u"))
    hops = e.select("state", F.explode(F.array_compact(F.array(unit("edge", "o_orderkey"), unit("transition", "o_orderkey", F.col("o_orderstatus") != "O"), target))).alias("u"))
    return own.unionByName(hops).select("state", "u.kind", "u.id").distinct()


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem), d AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM f GROUP BY ALL HAVING count(*) > 1),
g AS (SELECT l_orderkey, max(l_linenumber) - count(DISTINCT l_linenumber) AS holes FROM f GROUP BY l_orderkey HAVING max(l_linenumber) <> count(DISTINCT l_linenumber))
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS at, 'duplicate' AS code, n FROM d UNION ALL SELECT l_orderkey, NULL, 'holes', holes FROM g""".replace(" AS at,", " AS place,"))
def ledger_invariants(spark, d):
    f = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    n = f.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    twice = n.where("n > 1").select("l_orderkey", F.col("l_linenumber").cast("long").alias("place"), F.lit("duplicate").alias("code"), "n")
    holes = n.groupBy("l_orderkey").agg((F.max("l_linenumber") - F.count(F.lit(1))).cast("long").alias("n")).where("n <> 0")
    return twice.unionByName(holes.select("l_orderkey", F.lit(None).cast("long").alias("place"), F.lit("holes").alias("code"), "n"))


@query("""SELECT count(*) AS rows FROM (SELECT 1 FROM lineitem l LEFT JOIN orders o ON l_orderkey = o_orderkey WHERE o_orderkey IS NULL)""".replace(" AS rows", " AS orphans"))
def orphan_records(spark, d):
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    return integrity.missing(lines.select(F.col("l_orderkey").alias("k")), orders.select(F.col("o_orderkey").alias("k")), ["k"]).agg(F.count(F.lit(1)).alias("orphans"))


@query("""WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events)
SELECT user_id, count(*) AS frames, coalesce(bool_and(step > 0), true) AS rising, coalesce(min(step) = max(step), true) AS constant_rate FROM g GROUP BY user_id""")
def probe_report(spark, d):
    g = timeline.gaps(timed(spark, d), ["user_id"], ["event_id"], F.col("us"), "step")
    return g.groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"), F.coalesce(F.bool_and(F.col("step") > 0), F.lit(True)).alias("rising"), F.coalesce(F.min("step") == F.max("step"), F.lit(True)).alias("constant_rate"))


_UNITS = """s AS (SELECT c_custkey AS state, c_nationkey AS unit, CAST(5 + c_custkey % 7 AS BIGINT) AS frames FROM customer), e AS (SELECT o_orderkey AS edge, o_custkey AS src, (o_custkey * 7 + o_orderkey) % 150 AS dst FROM orders)"""


def _states(spark, d):
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("state"), F.col("c_nationkey").alias("unit"), (F.pmod("c_custkey", F.lit(7)) + 5).alias("frames"))
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("edge"), F.col("o_custkey").alias("src"), F.pmod(F.col("o_custkey") * 7 + F.col("o_orderkey"), F.lit(150)).alias("dst"))
    return s, e


@query(f"""WITH {_UNITS} SELECT edge, a.unit AS from_unit, b.unit AS to_unit, a.frames AS source_frames, n_name AS label FROM e JOIN s a ON src = a.state JOIN s b ON dst = b.state JOIN nation ON n_nationkey = b.unit""")
def lowered_graph(spark, d):
    s, e = _states(spark, d)
    a = s.select(F.col("state").alias("src"), F.col("unit").alias("from_unit"), F.col("frames").alias("source_frames"))
    b = s.select(F.col("state").alias("dst"), F.col("unit").alias("to_unit"))
    names = F.broadcast(table(spark, d, "nation").select(F.col("n_nationkey").alias("to_unit"), F.col("n_name").alias("label")))  # 25 rows
    return e.join(a, "src").join(b, "dst").join(names, "to_unit").select("edge", "from_unit", "to_unit", "source_frames", "label")


@query(f"""WITH {_UNITS} SELECT 'loop' AS kind, state AS place, frames - 1 AS leave, CAST(0 AS BIGINT) AS enter FROM s
UNION ALL SELECT 'departure', edge, p, CAST(0 AS BIGINT) FROM (SELECT edge, unnest(range(0, frames, 3)) AS p FROM e JOIN s ON src = state) UNION ALL SELECT 'arrival', edge, frames - 1, CAST(0 AS BIGINT) FROM e JOIN s ON dst = state""")
def boundary_enumeration(spark, d):
    s, e = _states(spark, d)
    zero = F.lit(0).cast("long").alias("enter")
    loops = s.select(F.lit("loop").alias("kind"), F.col("state").alias("place"), (F.col("frames") - 1).alias("leave"), zero)
    out = e.join(s, F.col("src") == F.col("state")).select(F.lit("departure").alias("kind"), F.col("edge").alias("place"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1, F.lit(3).cast("long"))).alias("leave"), zero)
    into = e.join(s, F.col("dst") == F.col("state")).select(F.lit("arrival").alias("kind"), F.col("edge").alias("place"), (F.col("frames") - 1).alias("leave"), zero)
    return loops.unionByName(out).unionByName(into)


_FRAMES = """x AS (SELECT edge, 0 AS part, unnest(range(0, n)) AS frame FROM p UNION ALL SELECT edge, 1, unnest(range(0, bridge)) FROM p UNION ALL SELECT edge, 2, unnest(range(0, m)) FROM p)
SELECT edge, part, frame, row_number() OVER (PARTITION BY edge ORDER BY part, frame) - 1 AS ordinal FROM x"""


def _path_frames(s, e):
    a, b = s.select(F.col("state").alias("src"), F.col("frames").alias("n")), s.select(F.col("state").alias("dst"), F.col("frames").alias("m"))
    p = e.join(a, "src").join(b, "dst").withColumn("bridge", F.pmod("edge", F.lit(4)))
    part = lambda k, n: F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))), lambda f: f < n), lambda f: F.struct(F.lit(k).alias("part"), f.alias("frame")))
    frames = F.concat(part(0, F.col("n")), part(1, F.col("bridge")), part(2, F.col("m")))
    return p.select("edge", F.posexplode(frames).alias("ordinal", "f")).select("edge", "f.part", "f.frame", "ordinal")


@query(f"""WITH {_UNITS}, p AS (SELECT edge, a.frames AS n, b.frames AS m, edge % 4 AS bridge FROM e JOIN s a ON src = a.state JOIN s b ON dst = b.state),
{_FRAMES}""")
def path_frames(spark, d):
    return _path_frames(*_states(spark, d))


@query("""SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) * 5 + max(CAST(l_quantity AS BIGINT)) * 8 + count(*) * 48 + 80 AS BIGINT) AS total_bytes,
sum(CAST(l_quantity AS BIGINT)) * 5 + max(CAST(l_quantity AS BIGINT)) * 8 + count(*) * 48 + 80 <= 1200 AS fits FROM lineitem GROUP BY l_orderkey""")
def resource_plan(spark, d):
    n = F.col("l_quantity").cast("long")
    total = F.sum(n) * 5 + F.max(n) * 8 + F.count(F.lit(1)) * 48 + 80
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(total.alias("total_bytes"), (total <= 1200).alias("fits"))


_RUN = """f AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice, l_linenumber) - 1 AS frame FROM lineitem)"""


@query(f"""WITH {_RUN} SELECT f.l_orderkey, f.pos, f.frame, g.pos AS shown_at, CAST((2 * CAST(f.frame AS HUGEINT) * 1000000 * 1001 + 30000) // 60000 AS BIGINT) AS start_us FROM f JOIN f g ON f.l_orderkey = g.l_orderkey AND f.pos - 1 = g.frame""")
def sample_batch(spark, d):
    from .catalog import decoded

    f = decoded(spark, d)
    g = f.select("l_orderkey", F.col("pos").alias("shown_at"), (F.col("frame") + 1).alias("pos"))
    return f.join(g, ["l_orderkey", "pos"]).select("l_orderkey", "pos", "frame", "shown_at", S.frame_micros("frame", 30000, 1001).alias("start_us"))
