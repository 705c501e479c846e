"""Registered queries over the driver's tables, each with equivalent SQL.

A driver table stands in for the data an operator is meant for: an event for a frame or an input, an order for a unit,
an order line for a chunk. The other modules hold the operators; this one only names inputs and outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import tables
from ..functions import scalars as S
from ..functions import stats
from ..operators import integrity, layout, timeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

HOUR = 3_600_000_000
DAY = 24 * HOUR
#: A quarter: what an as-of join holds of a key at a time.
BAND = 91 * DAY


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", S.micros("ts").alias("us"), *more)


# --- statistics and gates


@query("""SELECT event_type, count(value) AS n, min(value) AS min, max(value) AS max, quantile_disc(value, 0.5) AS median,
quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type""")
def latency_summary(spark, d):
    return stats.bracketed_rank(table(spark, d, "events"), ["event_type"], "value", {"median": 0.5, "p95": 0.95, "p99": 0.99})


@query("""SELECT user_id, count(value) AS n, min(value) AS min, max(value) AS max, quantile_disc(value, 0.5) AS median,
quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY user_id""")
def latency_summary_by_user(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(*stats.summary("value"))


@query("""WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT user_id, count(gap) AS gaps, max(gap) AS longest, coalesce(quantile_disc(gap, 0.99), 0) AS p99, count(*) FILTER (gap > 21600000000) AS over_6h FROM g GROUP BY user_id""")
def gap_summary_by_user(spark, d):
    g = timeline.gaps(timed(spark, d), ["user_id"], ["us", "event_id"], F.col("us"))
    return g.groupBy("user_id").agg(F.count("gap").alias("gaps"), F.max("gap").alias("longest"), stats.nearest_rank("gap", 0.99, 0).cast("long").alias("p99"), F.count_if(F.col("gap") > 6 * HOUR).alias("over_6h"))


@query("""WITH g AS (SELECT user_id, event_id, event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
t AS (SELECT user_id, greatest(1.5 * 3600000000, coalesce(quantile_disc(gap, 0.99) FILTER (event_type <> 'purchase'), 0) + 0.5 * 3600000000) AS threshold FROM g GROUP BY user_id)
SELECT t.user_id, CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (event_type = 'purchase' AND gap IS NOT NULL) AS boundaries,
min(event_id) FILTER (event_type = 'purchase' AND gap > threshold) AS first_failing FROM t JOIN g ON t.user_id = g.user_id GROUP BY t.user_id, threshold""")
def boundary_gate(spark, d):
    g = timeline.gaps(timed(spark, d), ["user_id"], ["us", "event_id"], F.col("us"))
    boundary = F.col("event_type") == "purchase"
    p99 = g.groupBy("user_id").agg(F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY gap) FILTER (WHERE event_type <> 'purchase')").alias("p"))
    limit = F.greatest(F.lit(1.5 * HOUR), F.coalesce("p", F.lit(0)) + 0.5 * HOUR).alias("threshold")
    both = g.join(p99.select("user_id", limit), "user_id")
    return both.groupBy("user_id", "threshold").agg(F.count_if(boundary & F.col("gap").isNotNull()).alias("boundaries"), F.min(F.when(boundary & (F.col("gap") > F.col("threshold")), F.col("event_id"))).alias("first_failing"))


@query("""SELECT user_id, event_id, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS running_min FROM events""")
def running_min_lead(spark, d):
    w = W.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return timed(spark, d, "value").select("user_id", "event_id", F.min("value").over(w).alias("running_min"))


@query("""WITH e AS (SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS low, epoch_us(ts) AS us FROM events)
SELECT user_id, count(*) AS outputs, min(low) AS worst_lead, quantile_disc(value, 0.99) AS p99,
CASE WHEN max(us) > min(us) THEN CAST(count(*) AS DOUBLE) * 3600000000 / (max(us) - min(us)) END AS per_hour,
array_to_string(list_filter([CASE WHEN count(*) < 24 THEN 'too-few-outputs' END, CASE WHEN min(value) < 0 THEN 'negative-lead' END, CASE WHEN quantile_disc(value, 0.99) > 100 THEN 'p99' END], lambda x: x IS NOT NULL), ',') AS failures
FROM e GROUP BY user_id""")
def readiness_report(spark, d):
    e = timed(spark, d, "value")
    n, span = F.count(F.lit(1)), F.max("us") - F.min("us")
    p99 = stats.nearest_rank("value", 0.99)
    fails = F.array_compact(F.array(F.when(n < 24, "too-few-outputs"), F.when(F.min("value") < 0, "negative-lead"), F.when(p99 > 100, "p99")))
    return e.groupBy("user_id").agg(n.alias("outputs"), F.min("value").alias("worst_lead"), p99.alias("p99"), F.when(span > 0, n.cast("double") * HOUR / span).alias("per_hour"), F.array_join(fails, ",").alias("failures"))


@query("""WITH o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord, epoch_us(ts) AS us FROM events),
m AS (SELECT user_id, count(*) AS n, max(us) FILTER (ord >= 24) - min(us) FILTER (ord >= 24) AS elapsed, count(*) FILTER (ord >= 24) AS measured FROM o GROUP BY user_id)
SELECT user_id, measured, CASE WHEN elapsed > 0 THEN ((measured - 1) * 1000000 * CAST(21600000000 AS HUGEINT) // elapsed)::BIGINT END AS ratio_millionths,
CASE WHEN measured < 30 THEN 'inconclusive' WHEN ((measured - 1) * 1000000 * CAST(21600000000 AS HUGEINT) // elapsed) >= 1500000 THEN 'passed' ELSE 'failed' END AS status FROM m""")
def throughput_gate(spark, d):
    o = timed(spark, d).withColumn("ord", F.row_number().over(W.partitionBy("user_id").orderBy("us", "event_id")) - 1)
    late = F.col("ord") >= 24
    m = o.groupBy("user_id").agg(F.count_if(late).alias("measured"), (F.max(F.when(late, F.col("us"))) - F.min(F.when(late, F.col("us")))).alias("elapsed"))
    ratio = S.int_div((F.col("measured") - 1).cast(S.WIDE) * F.lit(1_000_000 * 6 * HOUR).cast(S.WIDE), F.col("elapsed").cast(S.WIDE)).cast("long")
    m = m.withColumn("ratio_millionths", F.when(F.col("elapsed") > 0, ratio))
    status = F.when(F.col("measured") < 30, "inconclusive").when(F.col("ratio_millionths") >= 1_500_000, "passed").otherwise("failed")
    return m.select("user_id", "measured", "ratio_millionths", status.alias("status"))


@query("""SELECT event_type, count(*) AS samples, CAST((count(*) - 1) AS DOUBLE) * 1000000000.0 / ((max(epoch_us(ts)) - min(epoch_us(ts))) * 1000.0) AS observed_hz,
abs(CAST((count(*) - 1) AS DOUBLE) * 1000000000.0 / ((max(epoch_us(ts)) - min(epoch_us(ts))) * 1000.0) - 0.001) <= greatest(1.0, 0.0001) AS within FROM events GROUP BY event_type HAVING max(ts) > min(ts)""")
def capture_cadence(spark, d):
    rate = (F.count(F.lit(1)) - 1).cast("double") * 1e9 / ((F.max("us") - F.min("us")) * 1000.0)
    g = timed(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("samples"), rate.alias("observed_hz"), (F.max("us") > F.min("us")).alias("_ok")).where("_ok")
    return g.select("event_type", "samples", "observed_hz", (F.abs(F.col("observed_hz") - 0.001) <= F.greatest(F.lit(1.0), F.lit(0.0001))).alias("within"))


@query("""WITH t AS (SELECT user_id, CAST(ts AS DATE) AS day, epoch_us(ts) // 3600000000 AS refresh, event_type, value FROM events)
SELECT user_id, refresh, count(*) AS samples, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) END AS decoded, bool_or(value < 1) AS any_dark FROM t GROUP BY user_id, refresh""")
def refresh_consensus(spark, d):
    t = timed(spark, d, "value").withColumn("refresh", S.int_div("us", HOUR))
    agreed = F.when(F.min("event_type") == F.max("event_type"), F.min("event_type"))
    return t.groupBy("user_id", "refresh").agg(F.count(F.lit(1)).alias("samples"), agreed.alias("decoded"), F.bool_or(F.col("value") < 1).alias("any_dark"))


# --- timelines


@query("""WITH b AS (SELECT user_id, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY user_id),
t AS (SELECT user_id, epoch_us(unnest(generate_series(date_trunc('day', lo) + INTERVAL 1 DAY, date_trunc('day', hi), INTERVAL 1 DAY))) AS tick FROM b),
e AS (SELECT user_id, event_id, epoch_us(ts) AS us, value FROM events)
SELECT t.user_id, tick, e.event_id, e.us AS source_us FROM t ASOF LEFT JOIN e ON t.user_id = e.user_id AND t.tick >= e.us""")
def hold_resample_daily(spark, d):
    held = _held(spark, d)
    return held.select("user_id", F.col("us").alias("tick"), F.col("_source.event_id").alias("event_id"), F.col("_source.source_us").alias("source_us"))


def _held(spark: SparkSession, d: str) -> DataFrame:
    e = timed(spark, d).withColumn("source_us", F.col("us"))
    b = e.groupBy("user_id").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    first, last = (S.int_div("lo", DAY) + 1) * DAY, S.int_div("hi", DAY) * DAY
    ticks = b.where(first <= last).select("user_id", F.explode(F.sequence(first, last, F.lit(DAY))).alias("us"))
    return timeline.as_of(ticks, e, ["user_id"], "us", ["event_id", "source_us"], "event_id", band=BAND)


@query("""WITH b AS (SELECT user_id, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY user_id),
t AS (SELECT user_id, epoch_us(unnest(generate_series(date_trunc('day', lo) + INTERVAL 1 DAY, date_trunc('day', hi), INTERVAL 1 DAY))) AS tick FROM b),
e AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events),
h AS (SELECT t.user_id, e.event_id FROM t ASOF JOIN e ON t.user_id = e.user_id AND t.tick >= e.us),
n AS (SELECT user_id, event_id, count(*) AS c FROM h GROUP BY user_id, event_id)
SELECT e.user_id, count(*) FILTER (n.c > 1) AS duplicated, count(*) FILTER (n.c IS NULL) AS dropped FROM e LEFT JOIN n ON e.user_id = n.user_id AND e.event_id = n.event_id GROUP BY e.user_id""")
def duplicated_dropped_sources(spark, d):
    used = _held(spark, d).where("_source IS NOT NULL").groupBy("user_id", F.col("_source.event_id").alias("event_id")).agg(F.count(F.lit(1)).alias("c"))
    both = timed(spark, d).select("user_id", "event_id").join(used, ["user_id", "event_id"], "left")
    return both.groupBy("user_id").agg(F.count_if(F.col("c") > 1).alias("duplicated"), F.count_if(F.col("c").isNull()).alias("dropped"))


@query("""WITH c AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'click'), p AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase')
SELECT c.user_id, c.event_id, p.event_id AS next_purchase, p.us - c.us AS wait_us FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.us <= p.us""")
def next_purchase_after_click(spark, d):
    e = timed(spark, d)
    clicks = e.where("event_type = 'click'").select("user_id", "event_id", "us")
    bought = e.where("event_type = 'purchase'").withColumn("at", F.col("us"))
    found = timeline.as_of(clicks, bought, ["user_id"], "us", ["event_id", "at"], "event_id", forward=True, band=BAND)
    return found.select("user_id", "event_id", F.col("_source.event_id").alias("next_purchase"), (F.col("_source.at") - F.col("us")).alias("wait_us"))


@query("""WITH p AS (SELECT user_id, list_sort(list(DISTINCT CAST(hour(ts) AS BIGINT))) AS ps FROM events WHERE event_type = 'purchase' GROUP BY user_id),
c AS (SELECT user_id, event_id, CAST(hour(ts) AS BIGINT) AS f FROM events WHERE event_type = 'click')
SELECT event_id, f AS frame, coalesce(list_min(list_filter(ps, lambda x: x >= f)), ps[1] + 24) AS boundary, coalesce(list_min(list_filter(ps, lambda x: x >= f)), ps[1] + 24) - f AS wait,
list_min(list_filter(ps, lambda x: x >= f)) IS NULL AS wraps FROM c JOIN p ON c.user_id = p.user_id""")
def portal_wait_cyclic(spark, d):
    e = timed(spark, d).withColumn("f", F.pmod(S.int_div("us", HOUR), F.lit(24).cast("long")))
    portals = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.sort_array(F.collect_set("f")).alias("ps"))
    both = e.where("event_type = 'click'").join(portals, "user_id")
    boundary, wait = timeline.portal_boundary(F.col("ps"), F.col("f"), 24)
    return both.select("event_id", F.col("f").alias("frame"), boundary.alias("boundary"), wait.alias("wait"), (boundary >= 24).alias("wraps"))


@query("""WITH p AS (SELECT DISTINCT user_id, CAST(hour(ts) AS BIGINT) AS f FROM events WHERE event_type = 'purchase'),
n AS (SELECT user_id, f, coalesce(lead(f) OVER w, first(f) OVER (PARTITION BY user_id ORDER BY f) + 24) - f AS gap, f - lag(f) OVER w - 1 AS g2 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY f))
SELECT user_id, max(gap) - 1 AS worst_loop, greatest(min(f), coalesce(max(g2), 0)) AS worst_finite FROM n GROUP BY user_id""")
def greatest_portal_wait(spark, d):
    e = timed(spark, d).where("event_type = 'purchase'").withColumn("f", F.pmod(S.int_div("us", HOUR), F.lit(24).cast("long")))
    portals = e.groupBy("user_id").agg(F.sort_array(F.collect_set("f")).alias("ps"))
    return portals.select("user_id", timeline.greatest_wait(F.col("ps"), 24).alias("worst_loop"), timeline.greatest_wait_finite(F.col("ps")).alias("worst_finite"))


@query("""WITH e AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM e)
SELECT user_id, CAST(grp AS BIGINT) AS request_group, min(event_type) AS target, count(*) AS joined, min(event_id) AS first_request,
CASE WHEN grp = max(grp) OVER (PARTITION BY user_id) THEN 'settled' ELSE 'superseded' END AS outcome FROM g GROUP BY user_id, grp""")
def latest_wins_requests(spark, d):
    w = W.partitionBy("user_id").orderBy("us", "event_id")
    g = timeline.islands(timed(spark, d), ["user_id"], ["us", "event_id"], ~F.col("event_type").eqNullSafe(F.lag("event_type").over(w)))
    r = g.groupBy("user_id", "island").agg(F.min("event_type").alias("target"), F.count(F.lit(1)).alias("joined"), F.min("event_id").alias("first_request"))
    last = F.max("island").over(W.partitionBy("user_id"))
    return r.select("user_id", F.col("island").cast("long").alias("request_group"), "target", "joined", "first_request", F.when(F.col("island") == last, "settled").otherwise("superseded").alias("outcome"))


@query("""WITH f AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'view' THEN true WHEN 'error' THEN false END AS a, CASE event_type WHEN 'click' THEN true WHEN 'signup' THEN false END AS b FROM events),
s AS (SELECT user_id, event_id, ts, coalesce(last_value(a IGNORE NULLS) OVER w, false) OR coalesce(last_value(b IGNORE NULLS) OVER w, false) AS on FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, lag(on, 1, false) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM s)
SELECT user_id, event_id, on AS engaged FROM c WHERE on <> was""".replace(" AS on ", " AS eng ").replace("lag(on,", "lag(eng,").replace(" on AS engaged", " eng AS engaged").replace("WHERE on <>", "WHERE eng <>"))
def engagement_edges(spark, d):
    kind = F.col("event_type")
    w = W.partitionBy("user_id").orderBy("us", "event_id")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    flag = lambda on, off: F.coalesce(F.last(F.when(kind == on, True).when(kind == off, False), ignorenulls=True).over(upto), F.lit(False))
    s = timed(spark, d).withColumn("engaged", flag("view", "error") | flag("click", "signup"))
    return s.withColumn("was", F.lag("engaged", 1, False).over(w)).where("engaged <> was").select("user_id", "event_id", "engaged")


@query("""SELECT event_id, epoch_us(ts) // 86400000000 AS tick, row_number() OVER w AS seq, row_number() OVER w <= 32 AS admitted FROM events WINDOW w AS (PARTITION BY epoch_us(ts) // 86400000000 ORDER BY ts, event_id)""")
def admission_32_per_tick(spark, d):
    t = timed(spark, d).withColumn("tick", S.int_div("us", DAY))
    n = F.row_number().over(W.partitionBy("tick").orderBy("us", "event_id"))
    return t.select("event_id", "tick", n.alias("seq"), (n <= 32).alias("admitted"))


@query("""SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 256""")
def trace_last_256(spark, d):
    return timeline.last_rows(timed(spark, d), ["user_id"], [F.desc("us"), F.desc("event_id")], 256).select("user_id", "event_id")


@query("""WITH s AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 END AS step, CAST(floor(value) AS BIGINT) AS bytes FROM events WHERE event_type IN ('signup', 'error')),
b AS (SELECT *, sum(step) OVER w AS bal, sum(step * bytes) OVER w AS byt FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, CAST(sum(step) AS BIGINT) AS terminal, CAST(max(bal) AS BIGINT) AS peak, CAST(max(byt) AS BIGINT) AS peak_bytes, min(event_id) FILTER (bal < 0) AS first_negative FROM b GROUP BY user_id""")
def resource_balance(spark, d):
    s = timed(spark, d, "value").where("event_type IN ('signup', 'error')").withColumn("step", F.when(F.col("event_type") == "signup", 1).otherwise(-1))
    w = W.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(W.unboundedPreceding, 0)
    b = s.withColumn("bal", F.sum("step").over(w)).withColumn("byt", F.sum(F.col("step") * F.floor("value").cast("long")).over(w))
    return b.groupBy("user_id").agg(F.sum("step").alias("terminal"), F.max("bal").alias("peak"), F.max("byt").alias("peak_bytes"), F.min(F.when(F.col("bal") < 0, F.col("event_id"))).alias("first_negative"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events), b AS (SELECT *, CASE WHEN us - lag(us) OVER w >= 21600000000 OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS brk FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM b) SELECT user_id, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM g GROUP BY user_id, s""")
def gap_islands(spark, d):
    w = W.partitionBy("user_id").orderBy("us")
    g = timeline.islands(timed(spark, d), ["user_id"], ["us"], F.coalesce(F.col("us") - F.lag("us").over(w) >= 6 * HOUR, F.lit(True)))
    return g.groupBy("user_id", "island").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n")).drop("island")


@query("""WITH u AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us FROM events),
a AS (SELECT user_id, event_type AS v, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS pos FROM u WHERE event_type IN ('view', 'click')),
b AS (SELECT user_id, event_type AS v, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS pos FROM u WHERE event_type IN ('click', 'purchase'))
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.pos, b.pos) AS pos, a.v AS left_value, b.v AS right_value FROM a FULL JOIN b ON a.user_id = b.user_id AND a.pos = b.pos WHERE a.v IS DISTINCT FROM b.v""")
def log_agreement(spark, d):
    e = timed(spark, d)
    return integrity.zipped(e.where("event_type IN ('view', 'click')"), e.where("event_type IN ('click', 'purchase')"), ["user_id"], ["us", "event_id"], "event_type")


# --- layout over order lines

#: Line numbers repeat within an order here, so the order of chunks goes on with what tells lines apart.
_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_O = ", ".join(_ORDER)
_LINES = f"SELECT l_orderkey, {_O}, CAST(l_quantity AS BIGINT) AS len, l_returnflag FROM lineitem"


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("len"), "l_returnflag", "l_partkey", "l_suppkey", "l_extendedprice")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS prev FROM lineitem)
SELECT l_orderkey, l_linenumber, prev FROM l WHERE l_linenumber <> coalesce(prev, 0) + 1""")
def contiguity_violations(spark, d):
    prev = F.lag("l_linenumber").over(W.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return lines(spark, d).select("l_orderkey", "l_linenumber", prev.alias("prev")).where("l_linenumber <> coalesce(prev, 0) + 1")


@query("""WITH c AS (SELECT o_orderkey, count(l_orderkey) AS chunks FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)
SELECT o_orderkey, chunks, CAST(sum(chunks) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) - chunks AS BIGINT) AS chunk_start FROM c""")
def canonical_ordinals(spark, d):
    n = lines(spark, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("chunks"))
    units = table(spark, d, "orders").select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", F.coalesce("chunks", F.lit(0)).alias("chunks"))
    return layout.prefix_sum(units, "o_orderkey", [], F.col("chunks"), "chunk_start")


_LAYOUT = f"""l AS ({_LINES}), a AS (SELECT l_orderkey, l_linenumber, len, l_returnflag, CAST(sum((len + 7) // 8 * 8) OVER (ORDER BY l_orderkey, {_O} ROWS UNBOUNDED PRECEDING) - (len + 7) // 8 * 8 AS BIGINT) AS off FROM l)"""


def laid_out(spark: SparkSession, d: str) -> DataFrame:
    return layout.prefix_sum(lines(spark, d), "l_orderkey", _ORDER, S.align8("len"), "off")


@query(f"WITH {_LAYOUT} SELECT l_orderkey, l_linenumber, len, off FROM a")
def aligned_layout(spark, d):
    return laid_out(spark, d).select("l_orderkey", "l_linenumber", "len", "off")


_MERGED = f"""{_LAYOUT}, r AS (SELECT l_orderkey, off, (len + 7) // 8 * 8 AS al FROM a WHERE l_returnflag <> 'R'),
m AS (SELECT *, CASE WHEN off <> coalesce(lag(off + al) OVER w, -1) THEN 1 ELSE 0 END AS b FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY off)),
i AS (SELECT *, sum(b) OVER (PARTITION BY l_orderkey ORDER BY off) AS g FROM m),
x AS (SELECT l_orderkey, min(off) AS s, max(off + al) AS e, count(*) AS parts FROM i GROUP BY l_orderkey, g)"""


@query(f"WITH {_MERGED} SELECT l_orderkey, s AS start, e AS \"end\", parts FROM x")
def adjacent_ranges_merge(spark, d):
    r = laid_out(spark, d).where("l_returnflag <> 'R'").select("l_orderkey", "off", S.align8("len").alias("al"))
    return timeline.merged_ranges(r, ["l_orderkey"], "off", "al")


@query(f"WITH {_MERGED} SELECT l_orderkey, parts, f AS first, least(f + 64, e) AS last FROM (SELECT *, unnest(range(s, e, 64)) AS f FROM x)")
def transport_split(spark, d):
    return timeline.split_ranges(adjacent_ranges_merge(spark, d), 64)


@query(f"""WITH {_LAYOUT}, g AS (SELECT l_orderkey, min(off) AS s, max(off + len) AS e FROM a GROUP BY l_orderkey), q AS (SELECT unnest(range(0, (SELECT coalesce((max(e) + 996) // 997, 0) FROM g))) * 997 AS p)
SELECT p, g.l_orderkey, p < e AS inside FROM q ASOF JOIN g ON q.p >= g.s""")
def ordinal_span(spark, d):
    a, end = _written_layout(spark, d)
    return _spans_at(a, spark.range(-(-end // 997)).select((F.col("id") * 997).alias("p")))


def _written_layout(spark, d):
    """The layout as a table, and the byte after its last."""
    a = tables.written(laid_out(spark, d).select("l_orderkey", "len", "off"), "layout")
    return a, a.agg(F.max(F.col("off") + F.col("len"))).first()[0] or 0


def _spans_at(a, probes):
    spans = a.groupBy("l_orderkey").agg(F.min("off").alias("p"), F.max(F.col("off") + F.col("len")).alias("e"))
    # spans lie one after another but for padding, so each band of bytes gets the spans that reach into it and needs no other
    wide = 100_000
    cut = spans.withColumn("_k", F.explode(F.sequence(S.int_div("p", wide), S.int_div(S.align8("e") - 1, wide))))
    found = timeline.as_of(probes.withColumn("_k", S.int_div("p", wide)), cut, ["_k"], "p", ["l_orderkey", "e"], "l_orderkey")
    return found.where("_source IS NOT NULL").select("p", F.col("_source.l_orderkey").alias("l_orderkey"), (F.col("p") < F.col("_source.e")).alias("inside"))


@query(f"""WITH {_LAYOUT}, b AS (SELECT l_orderkey, min(off) AS s, max(off + len) AS e FROM a GROUP BY l_orderkey), t AS (SELECT unnest(range(0, (SELECT coalesce((max(e) + 4095) // 4096, 0) FROM b))) AS request), r AS (SELECT request, request * 4096 AS s, request * 4096 + 3000 AS e FROM t)
SELECT request, count(*) AS blobs, CAST(sum(least(r.e, b.e) - greatest(r.s, b.s)) AS BIGINT) AS bytes FROM r JOIN b ON r.s < b.e AND b.s < r.e GROUP BY request""")
def request_overlap(spark, d):
    a, end = _written_layout(spark, d)
    return _blobs_asked(a, spark.range(-(-end // 4096)))


def _blobs_asked(a, requests):
    wide = 4096
    blobs = a.groupBy("l_orderkey").agg(F.min("off").alias("bs"), F.max(F.col("off") + F.col("len")).alias("be"))
    asked = requests.select(F.col("id").alias("request"), (F.col("id") * wide).alias("rs"), (F.col("id") * wide + 3000).alias("re"))
    bands = lambda df, s, e: df.withColumn("band", F.explode(F.sequence(S.int_div(s, wide), S.int_div(F.col(e) - 1, wide))))
    both = bands(asked, "rs", "re").join(bands(blobs, "bs", "be"), "band").where(S.ranges_intersect(F.col("rs"), F.col("re"), F.col("bs"), F.col("be")))
    once = both.where(F.col("band") == F.greatest(S.int_div("rs", wide), S.int_div("bs", wide)))
    return once.groupBy("request").agg(F.count(F.lit(1)).alias("blobs"), F.sum(F.least("re", "be") - F.greatest("rs", "bs")).alias("bytes"))


@query("""WITH s AS (SELECT l_orderkey, count(*) AS records, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS shown, min_by(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS first_flag FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 200 AS declared, coalesce(shown, 0) AS shown, coalesce(records, 0) AS records, coalesce(first_flag = 'A', false) AS random_access FROM orders LEFT JOIN s ON o_orderkey = l_orderkey WHERE coalesce(shown, 0) <> CAST(floor(o_totalprice) AS BIGINT) % 200""")
def span_frame_sum(spark, d):
    s = lines(spark, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("records"), F.sum("len").alias("shown"), F.min_by("l_returnflag", F.struct(*_ORDER)).alias("flag"))
    o = table(spark, d, "orders").select("o_orderkey", F.pmod(F.floor("o_totalprice").cast("long"), F.lit(200).cast("long")).alias("declared")).join(s, "o_orderkey", "left")
    return o.select("o_orderkey", "declared", F.coalesce("shown", F.lit(0)).alias("shown"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce(F.col("flag") == "A", F.lit(False)).alias("random_access")).where("shown <> declared")


@query("""SELECT p_brand, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes, count(*) AS frames, greatest(1, CAST((sum(CAST(l_quantity AS BIGINT)) * 8 * 30000 + count(*) * 1001 - 1) // (count(*) * 1001) AS BIGINT)) AS bitrate
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def bitrate_by_part(spark, d):
    n = lines(spark, d).groupBy("l_partkey").agg(F.sum("len").alias("bytes"), F.count(F.lit(1)).alias("frames"))
    g = n.join(table(spark, d, "part").select("p_partkey", "p_brand"), n["l_partkey"] == F.col("p_partkey")).groupBy("p_brand").agg(F.sum("bytes").alias("bytes"), F.sum("frames").alias("frames"))
    return g.withColumn("bitrate", S.measured_bitrate(F.col("bytes"), F.col("frames"), 30000, 1001))


_DECODED = f"""f AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_O}) AS pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice, l_linenumber) - 1 AS frame FROM lineitem)"""


def decoded(spark: SparkSession, d: str) -> DataFrame:
    """Lines in decode order (pos) with the frame each shows."""
    number = lambda *cols: F.row_number().over(W.partitionBy("l_orderkey").orderBy(*cols))
    return lines(spark, d).select("l_orderkey", number(*_ORDER).alias("pos"), (number(*_ORDER[1:], _ORDER[0]) - 1).alias("frame"))


@query(f"""WITH {_DECODED}, c AS (SELECT *, CASE WHEN max(frame) OVER w + 1 = count(*) OVER w THEN 1 ELSE 0 END AS c FROM f WINDOW w AS (PARTITION BY l_orderkey ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT l_orderkey, pos, frame, CAST(coalesce(sum(c) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "group" FROM c""")
def decode_prefixes(spark, d):
    return layout.decode_groups(decoded(spark, d), ["l_orderkey"], "pos", "frame").select("l_orderkey", "pos", "frame", "group")


@query(f"""WITH {_DECODED}, x AS (SELECT a.l_orderkey, a.pos, a.pos - coalesce(min(b.frame), a.pos) AS waiting FROM f a LEFT JOIN f b ON a.l_orderkey = b.l_orderkey AND b.pos > a.pos GROUP BY a.l_orderkey, a.pos)
SELECT l_orderkey, max(waiting) AS depth FROM x GROUP BY l_orderkey""")
def reorder_depth(spark, d):
    return layout.reorder_depth(decoded(spark, d), ["l_orderkey"], "pos", "frame")


@query("""SELECT l_orderkey, l_linenumber, CAST((2 * CAST(l_orderkey AS HUGEINT) * 1000000 * 1001 + 30000) // 60000 AS BIGINT) AS start_us,
CAST((2 * CAST(l_orderkey + 1 AS HUGEINT) * 1000000 * 1001 + 30000) // 60000 - (2 * CAST(l_orderkey AS HUGEINT) * 1000000 * 1001 + 30000) // 60000 AS BIGINT) AS duration_us, l_orderkey // 24 AS iteration, l_orderkey % 24 AS content_frame FROM lineitem""")
def frame_timestamps(spark, d):
    iteration, local = S.virtual_frame("l_orderkey", 24)
    return lines(spark, d).select("l_orderkey", "l_linenumber", S.frame_micros("l_orderkey", 30000, 1001).alias("start_us"), S.frame_duration("l_orderkey", 30000, 1001).alias("duration_us"), iteration.alias("iteration"), local.alias("content_frame"))


# --- integrity and sets


@query("""SELECT 'lineitem.order' AS "check", CAST(l_orderkey AS BIGINT) AS key, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey
UNION ALL SELECT 'lineitem.part', CAST(l_partkey AS BIGINT), count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) GROUP BY l_partkey
UNION ALL SELECT 'lineitem.supplier', CAST(l_suppkey AS BIGINT), count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY l_suppkey
UNION ALL SELECT 'orders.customer', CAST(o_custkey AS BIGINT), count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey
UNION ALL SELECT 'customer.nation', CAST(c_nationkey AS BIGINT), count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation) GROUP BY c_nationkey
UNION ALL SELECT 'nation.region', CAST(n_regionkey AS BIGINT), count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region) GROUP BY n_regionkey
UNION ALL SELECT 'events.customer', CAST(user_id AS BIGINT), count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY user_id""")
def fk_violations(spark, d):
    t = lambda name: table(spark, d, name)
    return integrity.foreign_key_violations([
        ("lineitem.order", t("lineitem"), "l_orderkey", t("orders"), "o_orderkey"), ("lineitem.part", t("lineitem"), "l_partkey", t("part"), "p_partkey"), ("lineitem.supplier", t("lineitem"), "l_suppkey", t("supplier"), "s_suppkey"),
        ("orders.customer", t("orders"), "o_custkey", t("customer"), "c_custkey"), ("customer.nation", t("customer"), "c_nationkey", t("nation"), "n_nationkey"), ("nation.region", t("nation"), "n_regionkey", t("region"), "r_regionkey"), ("events.customer", t("events"), "user_id", t("customer"), "c_custkey"),
    ])


@query("""SELECT p_partkey, coalesce(uses, 0) AS uses FROM part LEFT JOIN (SELECT l_partkey, count(*) AS uses FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey WHERE coalesce(uses, 0) <> CASE WHEN p_partkey % 2 = 0 THEN 30 ELSE 29 END""")
def use_counts(spark, d):
    return integrity.use_counts(table(spark, d, "part"), "p_partkey", lines(spark, d), "l_partkey", F.when(F.col("p_partkey") % 2 == 0, 30).otherwise(29))


@query("""SELECT n_nationkey, m AS segment FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS m FROM customer) EXCEPT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9000""")
def coverage_matrix(spark, d):
    c = table(spark, d, "customer")
    grid = table(spark, d, "nation").select("n_nationkey").crossJoin(F.broadcast(c.select(F.col("c_mktsegment").alias("segment")).distinct()))
    return integrity.missing(grid, c.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment")), ["n_nationkey", "segment"])


@query("""WITH g AS (SELECT user_id, t AS event_type, r AS day_part FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(['view', 'click', 'purchase']) AS t), (SELECT unnest([0, 1]) AS r)),
s AS (SELECT user_id, event_type, hour(ts) // 12 AS day_part, count(*) AS n FROM events GROUP BY ALL)
SELECT g.user_id, g.event_type, CAST(g.day_part AS BIGINT) AS day_part, coalesce(n, 0) AS n FROM g LEFT JOIN s ON g.user_id = s.user_id AND g.event_type = s.event_type AND g.day_part = s.day_part WHERE coalesce(n, 0) < 2""")
def scenario_coverage(spark, d):
    e = timed(spark, d).withColumn("day_part", S.int_div(F.pmod(S.int_div("us", HOUR), F.lit(24).cast("long")), 12))
    grid = e.select("user_id").distinct().select("user_id", F.explode(F.array(*map(F.lit, ("view", "click", "purchase")))).alias("event_type")).select("*", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("day_part"))
    n = e.groupBy("user_id", "event_type", "day_part").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["user_id", "event_type", "day_part"], "left").select("user_id", "event_type", "day_part", F.coalesce("n", F.lit(0)).alias("n")).where("n < 2")


@query("""WITH s AS (SELECT user_id, list_sort(list(DISTINCT CAST(hour(ts) AS BIGINT))) AS seen FROM events GROUP BY user_id)
SELECT user_id, array_to_string(seen, ',') AS seen, array_to_string(list_sort(list_filter([0, 3, 6, 9, 12, 15, 18, 21]::BIGINT[], lambda x: NOT list_contains(seen, x))), ',') AS missing FROM s""")
def portal_coverage(spark, d):
    s = timed(spark, d).groupBy("user_id").agg(F.sort_array(F.collect_set(F.pmod(S.int_div("us", HOUR), F.lit(24).cast("long")))).alias("seen"))
    legal = F.array(*[F.lit(h).cast("long") for h in range(0, 24, 3)])
    joined = lambda a: F.array_join(a.cast("array<string>"), ",")
    return s.select("user_id", joined(F.col("seen")).alias("seen"), joined(F.array_except(legal, F.col("seen"))).alias("missing"))


@query("""WITH m AS (SELECT o_orderpriority AS name, date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT name, n FROM m WHERE m = (SELECT min(m) FROM m)), t AS (SELECT name, n FROM m WHERE m = (SELECT max(m) FROM m))
SELECT coalesce(b.name, t.name) AS name, coalesce(b.n, 0) AS baseline, coalesce(t.n, 0) AS terminal, coalesce(t.n, 0) - coalesce(b.n, 0) AS delta FROM b FULL JOIN t ON b.name = t.name""")
def ownership_delta(spark, d):
    m = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name"), F.date_trunc("month", "o_orderdate").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    ends = m.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    both = m.crossJoin(F.broadcast(ends))
    return integrity.counters(both.where("m = lo"), both.where("m = hi"), "name", "n")


@query("""SELECT p_brand, min_by(p_partkey, p_partkey) FILTER (p_size <= 10) AS selected, count(*) FILTER (p_partkey <= f) AS attempts FROM part JOIN (SELECT p_brand AS b, min(p_partkey) FILTER (p_size <= 10) AS f FROM part GROUP BY p_brand) ON b = p_brand GROUP BY p_brand""")
def first_supported(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_size")
    first = p.groupBy("p_brand").agg(F.min(F.when(F.col("p_size") <= 10, F.col("p_partkey"))).alias("selected"))
    return p.join(first, "p_brand").groupBy("p_brand", "selected").agg(F.count_if(F.col("p_partkey") <= F.col("selected")).alias("attempts"))


_RANK = "CASE WHEN c_acctbal < 0 THEN 2 WHEN c_mktsegment = 'BUILDING' THEN 3 WHEN c_acctbal < 5000 THEN 4 ELSE 5 END"


@query(f"SELECT c_nationkey, c_custkey, {_RANK} AS rank, row_number() OVER (PARTITION BY c_nationkey ORDER BY {_RANK}, c_acctbal, c_custkey) AS turn FROM customer")
def reclaim_order(spark, d):
    b = F.col("c_acctbal")
    rank = F.when(b < 0, 2).when(F.col("c_mktsegment") == "BUILDING", 3).when(b < 5000, 4).otherwise(5)
    c = table(spark, d, "customer").withColumn("rank", rank)
    return c.select("c_nationkey", "c_custkey", "rank", F.row_number().over(W.partitionBy("c_nationkey").orderBy("rank", "c_acctbal", "c_custkey")).alias("turn"))


@query("""SELECT c_nationkey AS participant, c_mktsegment AS category, CAST(sum(CAST(floor(abs(c_acctbal)) AS BIGINT)) AS BIGINT) AS bytes, count(*) AS leases FROM customer GROUP BY ALL""")
def byte_accounting(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("participant"), F.col("c_mktsegment").alias("category")).agg(F.sum(F.floor(F.abs("c_acctbal")).cast("long")).alias("bytes"), F.count(F.lit(1)).alias("leases"))


@query("""WITH e AS (SELECT c_nationkey AS unit, c_custkey AS edge, c_mktsegment AS s, lead(c_mktsegment) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS t, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) // 2 AS g FROM customer)
SELECT a.unit * 1000000 + a.g AS unit, a.edge AS a, b.edge AS b FROM e a JOIN e b ON a.unit = b.unit AND a.g = b.g AND a.edge < b.edge WHERE a.s = b.t AND a.t = b.s""")
def inverse_edge_pairs(spark, d):
    w = W.partitionBy("c_nationkey").orderBy("c_custkey")
    e = table(spark, d, "customer").select((F.col("c_nationkey").cast("long") * 1000000 + S.int_div(F.row_number().over(w), 2)).alias("unit"), F.col("c_custkey").alias("edge"), F.col("c_mktsegment").alias("s"), F.lead("c_mktsegment").over(w).alias("t"))
    return integrity.inverse_pairs(e, "unit", "edge", "s", "t")


@query("""WITH l AS (SELECT DISTINCT l_suppkey AS need FROM lineitem WHERE l_returnflag = 'R'), s AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
SELECT need AS suppkey FROM l WHERE need NOT IN (SELECT s_suppkey FROM s)""")
def bootstrap_closure(spark, d):
    need = lines(spark, d).where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("suppkey")).distinct()
    return integrity.missing(need, table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("suppkey")), ["suppkey"])


# --- vectors, texts, rollups

_V = "(SELECT vec_id, label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings)"


@query(f"""SELECT label, count(DISTINCT vec_id) AS frames, min(x) AS min_alpha, min(CASE WHEN x < 0 THEN vec_id * 100000 + i END) AS first_transparent FROM {_V} GROUP BY label""")
def alpha_audit(spark, d):
    e = table(spark, d, "embeddings").select("label", "vec_id", F.array_min("embedding").alias("low"), F.array_min(F.filter(F.transform("embedding", lambda x, i: F.when(x < 0, i)), lambda i: i.isNotNull())).alias("at"))
    return e.groupBy("label").agg(F.count_distinct("vec_id").alias("frames"), F.min("low").alias("min_alpha"), F.min(F.col("vec_id") * 100000 + F.col("at")).alias("first_transparent"))


@query("""WITH p AS (SELECT vec_id, label, embedding AS a, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT vec_id, round(sqrt(list_avg(list_transform(range(1, len(a) + 1), lambda i: power(CAST(a[i] AS DOUBLE) - CAST(b[i] AS DOUBLE), 2)))), 6) AS rms FROM p WHERE b IS NOT NULL""")
def frame_rms(spark, d):
    p = _rms(table(spark, d, "embeddings"), ["label"])
    return p.where("rms IS NOT NULL").select("vec_id", F.round("rms", 6).alias("rms"))


def _rms(e: DataFrame, keys: list[str]) -> DataFrame:
    prev = F.lag("embedding").over(W.partitionBy(*keys).orderBy("vec_id"))
    square = F.zip_with("embedding", "_p", lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2.0)))
    return e.withColumn("_p", prev).withColumn("rms", F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x) / F.size("embedding"))).drop("_p")


@query("""WITH p AS (SELECT vec_id, label, embedding AS a, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
r AS (SELECT vec_id, label, round(sqrt(list_avg(list_transform(range(1, len(a) + 1), lambda i: power(CAST(a[i] AS DOUBLE) - CAST(b[i] AS DOUBLE), 2)))), 6) AS rms FROM p WHERE b IS NOT NULL),
w AS (SELECT vec_id, rms, list_concat(coalesce(list(rms) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), []), coalesce(list(rms) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), [])) AS near FROM r)
SELECT vec_id, rms, len(near) AS neighbours, coalesce(list_sort(near)[CAST(ceil(0.95 * len(near)) AS BIGINT)], 0) AS p95 FROM w""")
def seam_neighbours(spark, d):
    r = _rms(table(spark, d, "embeddings"), ["label"]).where("rms IS NOT NULL").withColumn("rms", F.round("rms", 6))
    w = W.partitionBy("label").orderBy("vec_id")
    near = F.array_sort(F.concat(F.collect_list("rms").over(w.rowsBetween(-4, -1)), F.collect_list("rms").over(w.rowsBetween(1, 4))))
    out = r.withColumn("near", near).withColumn("neighbours", F.size("near"))
    return out.select("vec_id", "rms", "neighbours", F.coalesce(F.try_element_at("near", F.ceil(F.lit(0.95) * F.col("neighbours")).cast("int")), F.lit(0.0)).alias("p95"))


@query("""WITH g AS (SELECT source, sha256(text) AS h, min(doc_id) AS first_doc, count(*) AS uses FROM documents GROUP BY ALL) SELECT source, h, first_doc, uses, row_number() OVER (PARTITION BY source ORDER BY first_doc) - 1 AS layer FROM g""")
def layer_ids(spark, d):
    g = table(spark, d, "documents").groupBy("source", F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("uses"))
    return g.withColumn("layer", F.row_number().over(W.partitionBy("source").orderBy("first_doc")) - 1)


@query("SELECT doc_id, sha256(text) AS digest, strlen(text) AS bytes, n_chars = length(text) AS verified FROM documents")
def digest_check(spark, d):
    t = F.col("text").cast("binary")
    return table(spark, d, "documents").select("doc_id", F.sha2(t, 256).alias("digest"), F.octet_length(t).cast("long").alias("bytes"), (F.col("n_chars") == F.char_length("text")).alias("verified"))


_STATUS = "CASE WHEN quality IS NULL THEN 'inconclusive' WHEN toxic = 1 THEN 'failed' WHEN quality = 0 THEN 'unsupported' ELSE 'passed' END"


@query(f"""WITH s AS (SELECT source, {_STATUS} AS status FROM labels JOIN documents USING (doc_id))
SELECT source, count(*) AS results, CASE min(CASE status WHEN 'failed' THEN 0 WHEN 'inconclusive' THEN 1 WHEN 'unsupported' THEN 2 ELSE 3 END) WHEN 0 THEN 'failed' WHEN 1 THEN 'inconclusive' WHEN 2 THEN CASE WHEN bool_and(status = 'unsupported') THEN 'unsupported' ELSE 'withdrawn' END ELSE 'passed' END AS status FROM s GROUP BY source""")
def status_rollup(spark, d):
    status = F.when(F.col("quality").isNull(), "inconclusive").when(F.col("toxic") == 1, "failed").when(F.col("quality") == 0, "unsupported").otherwise("passed")
    s = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").withColumn("status", status)
    has = lambda x: F.bool_or(F.col("status") == x)
    verdict = F.when(has("failed"), "failed").when(has("inconclusive"), "inconclusive").when(F.bool_and(F.col("status") == "unsupported"), "unsupported").when(has("unsupported"), "withdrawn").otherwise("passed")
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("results"), verdict.alias("status"))


@query("""WITH t AS (SELECT conv_id, turn, role, lag(turn) OVER w AS pt, lag(role) OVER w AS pr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, turn = pt + 1 OR pt IS NULL AS contiguous, role IS DISTINCT FROM pr AS alternates FROM t""")
def turn_progression(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", F.lag("turn").over(w).alias("pt"), F.lag("role").over(w).alias("pr"))
    return t.select("conv_id", "turn", ((F.col("turn") == F.col("pt") + 1) | F.col("pt").isNull()).alias("contiguous"), (~F.col("role").eqNullSafe(F.col("pr"))).alias("alternates"))


# --- scalar functions over order lines


@query("""SELECT l_orderkey, l_linenumber, (l_partkey + 7) // 8 * 8 AS aligned, (l_partkey * 5 + 3) // 4 AS allocated, CASE WHEN l_discount <= 0.04045 THEN l_discount / 12.92 ELSE power((l_discount + 0.055) / 1.055, 2.4) END AS linear,
l_partkey & 65535 AS value, xor(l_partkey & 65535, 65535) AS complement, bit_count(l_partkey & 65535) % 2 AS parity, CASE WHEN l_partkey > 0 THEN l_suppkey // gcd(l_suppkey, l_partkey) END AS num, CASE WHEN l_partkey > 0 THEN l_partkey // gcd(l_suppkey, l_partkey) END AS den,
CAST(round(CAST(l_extendedprice AS DECIMAL(18, 2)) * 1000000) AS BIGINT) AS price_us FROM lineitem""")
def scalar_functions(spark, d):
    x = table(spark, d, "lineitem")
    m, r = S.marker_fields("l_partkey"), S.parse_rational(F.concat_ws("/", "l_suppkey", "l_partkey"))
    price = S.decimal_seconds_micros(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
    return x.select(
        "l_orderkey", "l_linenumber", S.align8("l_partkey").alias("aligned"), S.allocation(F.col("l_partkey")).alias("allocated"), S.srgb_to_linear("l_discount").alias("linear"), m["value"].alias("value"), m["complement"].alias("complement"),
        m["parity"].alias("parity"), r.alias("r"), price.alias("price_us"),
    ).select("*", "r.num", "r.den").drop("r")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber - 1 AS BIGINT) AS f, CAST(count(*) OVER (PARTITION BY l_orderkey) AS BIGINT) AS n, CASE l_returnflag WHEN 'R' THEN 'loop' WHEN 'A' THEN 'finite' ELSE 'held' END AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN k = 'held' THEN f WHEN f < n - 1 THEN f + 1 WHEN k = 'loop' THEN 0 ELSE n - 1 END AS frame, k = 'loop' OR (k = 'finite' AND f < n - 1) AS advanced, k = 'loop' AND f >= n - 1 AS wrapped, k = 'held' OR (k = 'finite' AND f >= n - 1) AS held FROM l""")
def body_frames(spark, d):
    n = F.count(F.lit(1)).over(W.partitionBy("l_orderkey"))
    kind = F.when(F.col("l_returnflag") == "R", "loop").when(F.col("l_returnflag") == "A", "finite").otherwise("held")
    rows = lines(spark, d).select("l_orderkey", "l_linenumber", (F.col("l_linenumber") - 1).cast("long").alias("f"), n.alias("n"), kind.alias("k"))
    return rows.select("l_orderkey", "l_linenumber", S.next_body_frame("k", "f", "n").alias("s")).select("l_orderkey", "l_linenumber", "s.*")


# --- machines, paths and formats


def sample_graph():
    """Five states that follow the event types, with every kind of start and transition."""
    from ..operators.machine import Graph

    body = lambda kind, frames: {"kind": kind, "frames": frames, "ports": {"main": list(range(0, frames, 3))}}
    states = {"idle": body("loop", 8) | {"intro": 3}, "hover": body("loop", 5), "busy": body("finite", 6), "done": body("held", 1)}
    edges = [
        {"id": "idle-hover", "from": "idle", "to": "hover", "event": "view", "start": "portal", "port": "main", "transition": {"kind": "reversible", "frames": 4, "direction": "forward"}, "inverse": "hover-idle"},
        {"id": "hover-idle", "from": "hover", "to": "idle", "event": "error", "start": "portal", "port": "main", "transition": {"kind": "reversible", "frames": 4, "direction": "reverse"}, "inverse": "idle-hover"},
        {"id": "hover-busy", "from": "hover", "to": "busy", "event": "click", "start": "cut"},
        {"id": "busy-done", "from": "busy", "to": "done", "start": "finish", "completion": True, "transition": {"kind": "locked", "frames": 3}},
        {"id": "busy-idle", "from": "busy", "to": "idle", "event": "error", "start": "cut"},
        {"id": "done-idle", "from": "done", "to": "idle", "event": "signup", "start": "finish"},
        {"id": "idle-busy", "from": "idle", "to": "busy", "event": "purchase", "start": "finish", "transition": {"kind": "locked", "frames": 2}},
    ]
    return Graph("idle", states, edges)


def machine_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as sends, a request for every fifth, and two ticks after each."""
    e = timed(spark, d).withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("us", "event_id")))
    want = F.element_at(F.array(*map(F.lit, ("idle", "hover", "busy", "done"))), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    step = lambda k, kind, value: F.struct((F.col("n") * 4 + k).cast("long").alias("seq"), kind.alias("kind"), value.alias("value"))
    asks = F.pmod("n", F.lit(5)) == 0
    tick, none = F.lit("tick"), F.lit(None).cast("string")
    rows = e.select(F.col("user_id").cast("long").alias("key"), F.explode(F.array(step(0, F.when(asks, "request").otherwise("send"), F.when(asks, want).otherwise(F.col("event_type"))), step(1, tick, none), step(2, tick, none))).alias("s"))
    begin = e.select(F.col("user_id").cast("long").alias("key")).distinct().select("key", F.lit(0).cast("long").alias("seq"), F.lit("begin").alias("kind"), none.alias("value"))
    return rows.select("key", "s.seq", "s.kind", "s.value").unionByName(begin).withColumn("ready", F.pmod("seq", F.lit(3)) != 0)


@query()
def state_machine_fold(spark, d):
    from ..operators import machine

    return machine.run(machine_inputs(spark, d), sample_graph()).withColumn("request_ids", F.array_join("request_ids", ","))


@query()
def encoded_window_dp(spark, d):
    from ..operators import paths

    chunk = F.struct(F.col("len").alias("bytes"), F.pmod(F.col("l_linenumber"), F.lit(3)).cast("long").alias("frames"))
    shown = F.struct(F.lit(1).cast("long").alias("bytes"), F.lit(1).cast("long").alias("frames"))
    unit = lambda name, flag, after: F.struct(F.lit(name).alias("id"), F.concat(F.array(shown), F.transform(F.filter("ls", lambda x: x["f"] == flag), lambda x: x["c"])).alias("chunks"), F.array(*map(F.lit, after)).alias("after"))
    each = lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*_ORDER, F.col("l_returnflag").alias("f"), chunk.alias("c")))).alias("ls"))
    assets = each.select(F.col("l_orderkey").alias("asset"), F.array(unit("a", "A", ["n", "a"]), unit("n", "N", ["r"]), unit("r", "R", ["a"])).alias("units"))
    return paths.heaviest_windows(assets, 12)


@query("""WITH RECURSIVE e AS (SELECT o_custkey AS src, min(o_orderkey) AS dst FROM orders GROUP BY o_custkey),
w(a, b) AS (SELECT src, dst FROM e UNION SELECT w.a, e.dst FROM w JOIN e ON w.b = e.src) SELECT DISTINCT a AS node FROM w WHERE a = b""")
def completion_cycle(spark, d):
    from ..operators import paths

    e = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("src")).agg(F.min("o_orderkey").alias("dst"))
    return paths.functional_cycles(e, e.count())


@query("""WITH RECURSIVE w(node) AS (SELECT c_custkey FROM customer WHERE c_nationkey = 7 UNION SELECT o_orderkey FROM w JOIN orders ON node = o_custkey) SELECT node FROM w""")
def import_closure(spark, d):
    from ..operators import paths

    e = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return paths.closure(e, table(spark, d, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("node")))


@query("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS canonical, props = '{"k":' || json_extract_string(props, '$.k') || '}' AS was_canonical, CAST(NULL AS VARCHAR) AS error FROM events""")
def canonical_props(spark, d):
    from ..sources import formats

    return formats.canonical_column(table(spark, d, "events"), "props", ["event_id"])

from . import ledgers as _ledgers  # noqa: E402, F401  these register their queries here
from . import policies as _policies  # noqa: E402, F401
from . import rules as _rules  # noqa: E402, F401
