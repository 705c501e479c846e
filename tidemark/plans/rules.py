"""Registered queries on authoring rules, admission with limits, readiness metrics and file round trips; joined into ``catalog``."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import tables
from ..functions import scalars as S
from ..functions import stats
from ..operators import integrity, ledgers, timeline
from ..sources import assets, formats
from .catalog import _ORDER, lines, query, table, timed

_N = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n"


def _numbered(spark, d, *more):
    return timed(spark, d, *more).withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("us", "event_id")))


# --- authoring rules


@query("""WITH f AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, l_linenumber * 1001 AS ticks,
first_value(l_linenumber * 1001) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS f, CASE WHEN l_discount > 0.09 THEN 1000 ELSE 1001 END AS dur FROM lineitem)
SELECT l_orderkey, count(*) AS frames, bool_and((ticks - f) * 30000 = i * 1001 * 30000 AND dur * 30000 = 1001 * 30000) AS exact FROM f GROUP BY l_orderkey""")
def exact_frame_grid(spark, d):
    f = table(spark, d, "lineitem").select("l_orderkey", *_ORDER, (F.col("l_linenumber").cast("long") * 1001).alias("ticks"), F.when(F.col("l_discount") > 0.09, 1000).otherwise(1001).cast("long").alias("duration"))
    return timeline.exact_grid(f, ["l_orderkey"], _ORDER, "ticks", "duration", (30000, 1001), (1, 30000))


_CODECS = """c AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'avc1.6400' || format('{:02X}', p_size) WHEN 1 THEN 'vp09.00.' || p_size || '.08' WHEN 2 THEN 'vp09.00.' || p_size || '.08.01.01.01.01.00'
WHEN 3 THEN 'av01.0.' || format('{:02d}', p_size) || 'M.08' WHEN 4 THEN 'av01.0.' || format('{:02d}', p_size) || 'H.10' WHEN 5 THEN 'av01.0.' || format('{:02d}', p_size) || 'M.10.0.110.01.01.01.0'
WHEN 6 THEN 'hvc1.1.' || format('{:X}', p_size) || '.L' || p_size * 9 || '.B0' WHEN 7 THEN 'hvc1.1.6.H' || p_size || '.' || format('{:02X}', p_size + 128) || '.0' || p_size % 3 ELSE p_type END AS codec FROM part)"""


@query(rf"""WITH {_CODECS}, m AS (SELECT *, regexp_full_match(codec, 'avc1\.6400(0A|0B|0C|0D|14|15|16|1E|1F|20|28|29|2A|32|33|34|3C|3D|3E)') AS h264, regexp_full_match(codec, 'vp09\.00\.(10|11|20|21|30|31|40|41|50|51|52|60|61|62)\.08(\.01\.01\.01\.01\.00)?') AS vp9,
regexp_full_match(codec, 'av01\.0\.(0[0-9]|[12][0-9]|3[01])[MH]\.(08|10)(\.0\.11[0-3]\.01\.01\.01\.0)?') AS av1, regexp_full_match(codec, 'hvc1\.1\.(0|[1-9A-F][0-9A-F]*)\.[LH](0|[1-9][0-9]*)\.(([0-9A-F][0-9A-F]\.){{0,5}}(0[1-9A-F]|[1-9A-F][0-9A-F]))') AS hvc, string_split(codec, '.') AS p FROM c),
h AS (SELECT *, CASE WHEN hvc THEN CAST('0x' || p[3] AS BIGINT) END AS flags, CASE WHEN hvc THEN CAST(substr(p[4], 2) AS BIGINT) END AS lvl, CASE WHEN hvc THEN CAST('0x' || p[5] AS BIGINT) END AS b FROM m),
f AS (SELECT *, hvc AND flags <= 4294967295 AND (flags // 2) % 2 = 1 AND lvl BETWEEN 1 AND 255 AND b & 208 = 144 AS h265 FROM h)
SELECT p_partkey, codec, CASE WHEN h264 THEN 'h264' WHEN h265 THEN 'h265' WHEN vp9 THEN 'vp9' WHEN av1 THEN 'av1' END AS family, CASE WHEN h264 OR h265 OR vp9 THEN 8 WHEN av1 THEN CAST(substr(p[4], 1, 2) AS INT) END AS bit_depth FROM f""")
def codec_strings(spark, d):
    n = F.col("p_size")
    two, dec, text = F.format_string("%02X", n), F.format_string("%02d", n), n.cast("string")
    kinds = [
        F.concat(F.lit("avc1.6400"), two), F.concat(F.lit("vp09.00."), text, F.lit(".08")), F.concat(F.lit("vp09.00."), text, F.lit(".08.01.01.01.01.00")), F.concat(F.lit("av01.0."), dec, F.lit("M.08")), F.concat(F.lit("av01.0."), dec, F.lit("H.10")),
        F.concat(F.lit("av01.0."), dec, F.lit("M.10.0.110.01.01.01.0")), F.concat(F.lit("hvc1.1."), F.format_string("%X", n), F.lit(".L"), (n * 9).cast("string"), F.lit(".B0")),
        F.concat(F.lit("hvc1.1.6.H"), text, F.lit("."), F.format_string("%02X", n + 128), F.lit(".0"), F.pmod(n, F.lit(3)).cast("string")), F.col("p_type"),
    ]
    c = table(spark, d, "part").select("p_partkey", F.element_at(F.array(*kinds), (F.pmod("p_partkey", F.lit(9)) + 1).cast("int")).alias("codec"))
    return c.select("p_partkey", "codec", S.codec_string("codec").alias("s")).select("p_partkey", "codec", "s.family", "s.bit_depth")


@query("""WITH i AS (SELECT p_partkey, p_size * 4 AS cw, p_size * 3 AS ch, p_size * 4 // (1 + p_partkey % 3) AS vw, p_size * 3 // (1 + p_partkey % 3) + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS vh, p_partkey % 2 = 0 AS packed FROM part),
g AS (SELECT *, (vw + 1) // 2 * 2 AS pw, (vh + 1) // 2 * 2 AS ph FROM i WHERE vw >= 1 AND vh >= 1 AND vw <= cw AND vh <= ch AND vw * ch = vh * cw), s AS (SELECT *, CASE WHEN packed THEN 2 * ph + 8 ELSE ph END AS sh FROM g),
c AS (SELECT *, (pw + 15) // 16 * 16 AS codw, (sh + 7) // 8 * 8 AS codh FROM s)
SELECT i.p_partkey, pw AS storage_width, sh AS storage_height, CASE WHEN i.packed THEN ph + 8 END AS alpha_y, codw AS coded_width, codh AS coded_height, c.vw * c.vh AS visible_area, pw * sh * 4 AS decoded_bytes, codw * codh * 4 AS coded_bytes FROM i LEFT JOIN c ON c.p_partkey = i.p_partkey""")
def rendition_geometry(spark, d):
    n, k = F.col("p_size").cast("long"), F.pmod("p_partkey", F.lit(3)) + 1
    visible = S.int_div(n * 4, k), S.int_div(n * 3, k) + F.when(F.pmod("p_partkey", F.lit(7)) == 0, 1).otherwise(0)
    g = S.rendition_geometry((n * 4, n * 3), visible, F.pmod("p_partkey", F.lit(2)) == 0, (16, 8))
    return table(spark, d, "part").select("p_partkey", g.alias("g")).select("p_partkey", "g.*")


@query("""WITH a AS (SELECT vec_id, list_min(embedding) >= -0.3 AS opaque, CASE vec_id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'opaque' ELSE 'packed' END AS requested FROM embeddings)
SELECT vec_id, requested, CASE WHEN requested = 'opaque' AND NOT opaque THEN NULL WHEN requested = 'auto' THEN CASE WHEN opaque THEN 'opaque' ELSE 'packed' END ELSE requested END AS selected,
requested = 'packed' AND opaque AS warning, requested = 'opaque' AND NOT opaque AS rejected FROM a""")
def alpha_policy(spark, d):
    k = F.pmod("vec_id", F.lit(3))
    requested = F.when(k == 0, "auto").when(k == 1, "opaque").otherwise("packed")
    e = table(spark, d, "embeddings").select("vec_id", requested.alias("requested"), (F.array_min("embedding").cast("double") >= -0.3).alias("opaque"))
    return e.select("vec_id", "requested", S.alpha_policy("requested", F.col("opaque")).alias("p")).select("vec_id", "requested", "p.*")


_EDGES = """s AS (SELECT c_custkey AS state, CASE c_nationkey % 3 WHEN 0 THEN 'loop' WHEN 1 THEN 'finite' ELSE 'held' END AS playback, 5 + c_custkey % 7 AS frames, CASE WHEN c_nationkey % 4 = 0 THEN 'side' ELSE 'main' END AS port, CASE WHEN c_nationkey % 5 = 0 THEN 3 ELSE 4 + c_custkey % 7 END AS last FROM customer WHERE c_acctbal > -500),
e AS (SELECT o_orderkey AS edge, o_custkey AS src, (o_custkey * 7 + o_orderkey) % (SELECT count(*) FROM customer) AS dst, CASE o_orderkey % 3 WHEN 0 THEN 'portal' WHEN 1 THEN 'finish' ELSE 'cut' END AS start, CASE WHEN o_orderkey % 11 = 0 THEN 'side' ELSE 'main' END AS sp, CASE WHEN o_orderkey % 5 = 0 THEN 'side' ELSE 'main' END AS tp,
CASE o_orderstatus WHEN 'P' THEN 'locked' WHEN 'F' THEN 'reversible' END AS transition, CASE WHEN o_orderkey % 13 = 0 THEN 'body' WHEN o_orderstatus = 'P' THEN 'bridge' ELSE 'reversible' END AS kind, CASE WHEN o_orderpriority LIKE '1%' THEN 'best-effort' ELSE 'exact-authored' END AS continuity FROM orders)"""


@query(f"""WITH {_EDGES}, j AS (SELECT edge, CASE WHEN a.state IS NULL THEN 'from' WHEN b.state IS NULL THEN 'to' WHEN b.port <> tp THEN 'target-port' WHEN start = 'portal' AND a.port <> sp THEN 'source-port' WHEN start = 'portal' AND a.playback = 'finite' AND a.last <> a.frames - 1 THEN 'held-frame'
WHEN start = 'finish' AND a.playback = 'loop' THEN 'finish-of-loop' WHEN transition = 'locked' AND kind <> 'bridge' THEN 'bridge-unit' WHEN transition = 'locked' AND continuity <> 'exact-authored' THEN 'locked-continuity' WHEN transition = 'reversible' AND kind <> 'reversible' THEN 'reversible-unit'
WHEN transition IS NULL AND start <> 'cut' AND continuity <> 'exact-authored' THEN 'continuity' END AS code FROM e LEFT JOIN s a ON src = a.state LEFT JOIN s b ON dst = b.state) SELECT edge, code FROM j WHERE code IS NOT NULL""")
def edge_references(spark, d):
    c = table(spark, d, "customer")
    frames, nation = F.pmod("c_custkey", F.lit(7)) + 5, F.col("c_nationkey")
    playback = F.element_at(F.array(*map(F.lit, ("loop", "finite", "held"))), (F.pmod(nation, F.lit(3)) + 1).cast("int"))
    port = F.struct(F.when(F.pmod(nation, F.lit(4)) == 0, "side").otherwise("main").alias("id"), F.when(F.pmod(nation, F.lit(5)) == 0, F.lit(3)).otherwise(frames - 1).cast("long").alias("last"))
    states = c.where("c_acctbal > -500").select(F.col("c_custkey").alias("state"), playback.alias("playback"), frames.alias("frames"), F.array(port).alias("ports"))
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    side = lambda by: F.when(F.pmod(k, F.lit(by)) == 0, "side").otherwise("main")
    edges = table(spark, d, "orders").select(
        k.alias("edge"), F.col("o_custkey").alias("src"), F.pmod(F.col("o_custkey") * 7 + k, F.lit(c.count())).alias("dst"), F.element_at(F.array(*map(F.lit, ("portal", "finish", "cut"))), (F.pmod(k, F.lit(3)) + 1).cast("int")).alias("start"),
        side(11).alias("source_port"), side(5).alias("target_port"), F.when(status == "P", "locked").when(status == "F", "reversible").alias("transition"), F.when(F.pmod(k, F.lit(13)) == 0, "body").when(status == "P", "bridge").otherwise("reversible").alias("unit_kind"),
        F.when(F.col("o_orderpriority").startswith("1"), "best-effort").otherwise("exact-authored").alias("continuity"),
    )
    return integrity.edge_failures(edges, states)


@query("""WITH p AS (SELECT c_custkey, c_nationkey % 6 AS platform, c_mktsegment AS browser, CASE WHEN c_custkey % 4 = 0 THEN 120 WHEN c_custkey % 101 = 0 THEN 90 ELSE 60 END AS refresh, c_nationkey % 6 = 2 AS available FROM customer WHERE c_acctbal > 9000),
a AS (SELECT platform, bool_or(available) AS more FROM p GROUP BY platform), r AS (SELECT n % 5 AS platform, m AS browser FROM (SELECT unnest(range(0, 5)) AS n), (SELECT DISTINCT c_mktsegment AS m FROM customer)),
g AS (SELECT r.platform, browser, unnest(CASE WHEN coalesce(more, false) THEN [60, 120] ELSE [60] END) AS refresh FROM r LEFT JOIN a ON a.platform = r.platform), s AS (SELECT platform, browser, refresh, count(*) AS n, bool_or(NOT available) AS bad FROM p GROUP BY ALL)
SELECT 'missing' AS code, platform, browser, CAST(refresh AS BIGINT) AS refresh FROM (SELECT * FROM g EXCEPT SELECT platform, browser, refresh FROM s) UNION ALL SELECT 'duplicate', platform, browser, refresh FROM s WHERE n > 1 UNION ALL SELECT 'unknown-platform', platform, browser, refresh FROM s WHERE platform > 4
UNION ALL SELECT 'unknown-refresh', platform, browser, refresh FROM s WHERE refresh = 90 UNION ALL SELECT 'unavailable-refresh', platform, browser, refresh FROM s WHERE refresh = 120 AND bad""")
def profile_matrix(spark, d):
    c, key = table(spark, d, "customer"), F.col("c_custkey")
    platform = F.pmod("c_nationkey", F.lit(6)).cast("long")
    refresh = F.when(F.pmod(key, F.lit(4)) == 0, 120).when(F.pmod(key, F.lit(101)) == 0, 90).otherwise(60)
    p = c.where("c_acctbal > 9000").select(platform.alias("platform"), F.col("c_mktsegment").alias("browser"), refresh.alias("refresh"), (platform == 2).alias("available"))
    required = c.select(F.col("c_mktsegment").alias("browser")).distinct().select(F.explode(F.array(*[F.lit(k).cast("long") for k in range(5)])).alias("platform"), "browser")
    return integrity.slot_matrix(p, required, range(5), 60, 120)


@query("""WITH m AS (SELECT o_orderpriority AS name, date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT name, n FROM m WHERE m = (SELECT min(m) FROM m)), t AS (SELECT name, n FROM m WHERE m = (SELECT max(m) FROM m)),
x AS (SELECT coalesce(b.name, t.name) AS name, coalesce(t.n, 0) - coalesce(b.n, 0) AS delta FROM b FULL JOIN t ON b.name = t.name) SELECT name, delta, CAST(CASE WHEN name = '5-LOW' THEN 3 ELSE 0 END AS BIGINT) AS allowed FROM x WHERE delta > CASE WHEN name = '5-LOW' THEN 3 ELSE 0 END""")
def counter_window(spark, d):
    from .catalog import ownership_delta

    return integrity.counter_failures(ownership_delta(spark, d), {"5-LOW": 3})


# --- admission, credit, alignment, readiness


@query(f"""WITH RECURSIVE e AS (SELECT user_id, {_N}, CASE event_type WHEN 'view' THEN 'lease' WHEN 'click' THEN 'release' WHEN 'signup' THEN 'clear' WHEN 'error' THEN 'lease' ELSE 'submit' END AS op, CASE event_type WHEN 'click' THEN 1 + event_id % 9 WHEN 'purchase' THEN event_id % 7 ELSE CAST(floor(value) AS BIGINT) END AS a FROM events),
w AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(id BIGINT, b BIGINT)[]) AS held, CAST(1 AS BIGINT) AS nxt, '' AS outcome, CAST(NULL AS BIGINT) AS frame FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT e.user_id, e.n, CASE WHEN op = 'lease' AND t + a <= 300 THEN list_append(held, {{'id': nxt, 'b': a}}) WHEN op = 'release' THEN list_filter(held, lambda x: x.id <> a) WHEN op = 'clear' THEN CAST([] AS STRUCT(id BIGINT, b BIGINT)[]) ELSE held END, CASE WHEN op = 'lease' AND t + a <= 300 THEN nxt + 1 ELSE nxt END,
CASE op WHEN 'lease' THEN CASE WHEN t + a <= 300 THEN 'leased' ELSE 'budget-exceeded' END WHEN 'release' THEN CASE WHEN list_contains(list_transform(held, lambda x: x.id), a) THEN 'released' ELSE 'release-invalid' END WHEN 'clear' THEN 'cleared' ELSE CASE WHEN a + len(held) < 12 THEN 'credit' ELSE 'no-credit' END END,
CASE WHEN op = 'lease' AND t + a <= 300 THEN nxt END FROM (SELECT *, coalesce(list_sum(list_transform(held, lambda x: x.b)), 0) AS t FROM w) w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, n, outcome, frame, CAST(len(held) AS BIGINT) AS count, CAST(coalesce(list_sum(list_transform(held, lambda x: x.b)), 0) AS BIGINT) AS bytes FROM w WHERE n > 0""")
def frame_credit_ledger(spark, d):
    kind = F.col("event_type")
    op = F.when(kind.isin("view", "error"), "lease").when(kind == "click", "release").when(kind == "signup", "clear").otherwise("submit")
    amount = F.when(kind == "click", F.pmod("event_id", F.lit(9)) + 1).when(kind == "purchase", F.pmod("event_id", F.lit(7))).otherwise(F.floor("value")).cast("long")
    return ledgers.frame_credit(_numbered(spark, d, "value").withColumn("op", op).withColumn("amount", amount), ["user_id"], "n", "op", "amount", 300, 12)


@query(f"""WITH RECURSIVE e AS (SELECT user_id, {_N}, event_type AS player, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS a FROM events),
w AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(p VARCHAR, b BIGINT)[]) AS held, '' AS outcome, CAST(0 AS BIGINT) AS player_bytes, CAST(0 AS BIGINT) AS page_bytes FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT user_id, n, CASE WHEN a IS NULL THEN rest WHEN ok THEN list_append(rest, {{'p': player, 'b': own + a}}) ELSE held END, CASE WHEN a IS NULL THEN 'disposed' WHEN ok THEN 'reserved' ELSE 'rejected' END, CAST(CASE WHEN a IS NULL THEN 0 WHEN ok THEN own + a ELSE own END AS BIGINT),
CAST(CASE WHEN a IS NULL THEN t - own WHEN ok THEN t + a ELSE t END AS BIGINT) FROM (SELECT *, own + a <= 150 AND t + a <= 400 AS ok FROM (SELECT e.user_id, e.n, player, a, held, list_filter(held, lambda x: x.p <> player) AS rest, coalesce(list_sum(list_transform(list_filter(held, lambda x: x.p = player), lambda x: x.b)), 0) AS own,
coalesce(list_sum(list_transform(held, lambda x: x.b)), 0) AS t FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))) SELECT user_id, n, outcome, player_bytes, page_bytes FROM w WHERE n > 0""")
def page_admission(spark, d):
    amount = F.when(F.pmod("event_id", F.lit(5)) != 0, F.floor("value").cast("long"))
    return ledgers.page_admission(_numbered(spark, d, "value").withColumn("amount", amount), ["user_id"], "n", "event_type", "amount", 150, 400)


@query(f"""WITH m AS (SELECT user_id, {_N}, value AS decode, value * 1.5 AS upload, 100.0 * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS submit FROM events),
g AS (SELECT user_id, count(*) AS outputs, quantile_disc(decode, 0.99) AS p99_decode, quantile_disc(upload, 0.99) AS p99_upload, min(250.0 - upload) AS worst_lead, max_by(submit + upload, n) - min(submit) AS interval, count(*) * (1000.0 * 1001 / 30000) AS media FROM m GROUP BY user_id),
l AS (SELECT *, CAST(ceil(p99_decode / (1000.0 * 1001 / 30000)) AS BIGINT) + 1 AS decode_lead, CAST(ceil(p99_upload / (1000.0 * 1001 / 30000)) AS BIGINT) + 1 AS upload_lead FROM g), r AS (SELECT *, greatest(decode_lead + 1, upload_lead) AS recovery, greatest(6, decode_lead + 1, upload_lead) AS ring FROM l)
SELECT user_id, outputs, CAST(p99_decode AS DOUBLE) AS p99_decode, CAST(p99_upload AS DOUBLE) AS p99_upload, decode_lead, upload_lead, CAST(recovery AS BIGINT) AS recovery_lead, CAST(CASE WHEN ring <= 12 THEN ring END AS BIGINT) AS ring, CAST(worst_lead AS DOUBLE) AS worst_lead,
array_to_string(list_filter([CASE WHEN outputs < 24 THEN 'measured-output-count' END, CASE WHEN interval <> 0 AND media * 2 < interval * 3 THEN 'throughput' END, CASE WHEN worst_lead < 0 THEN 'upload-deadline' END, CASE WHEN ring > 12 THEN 'ring-capacity' END], lambda x: x IS NOT NULL), ',') AS failures FROM r""")
def readiness_metrics(spark, d):
    """Latencies, leads, ring and ordered failures of each user's outputs: submitted every 100 ms, due 250 ms later, decoded and uploaded after ``value`` and half as long again."""
    frame = F.lit(1000.0 * 1001 / 30000)
    m = _numbered(spark, d, "value").select("user_id", "n", F.col("value").alias("decode"), (F.col("value") * 1.5).alias("upload"), (F.col("n") * 100.0).alias("submit"))
    p99 = lambda c: stats.nearest_rank(c, 0.99)
    g = m.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("outputs"), p99("decode").alias("p99_decode"), p99("upload").alias("p99_upload"), F.min(250.0 - F.col("upload")).alias("worst_lead"),
        (F.max_by(F.col("submit") + F.col("upload"), "n") - F.min("submit")).alias("interval"), (F.count(F.lit(1)) * frame).alias("media"),
    )
    g = g.withColumn("decode_lead", S.lead_frames(F.col("p99_decode"), frame) + 1).withColumn("upload_lead", S.lead_frames(F.col("p99_upload"), frame) + 1)
    recovery = F.greatest(F.col("decode_lead") + 1, "upload_lead")
    ring = F.greatest(F.lit(6).cast("long"), recovery)
    fails = F.array_compact(F.array(F.when(F.col("outputs") < 24, "measured-output-count"), F.when((F.col("interval") != 0) & (F.col("media") * 2 < F.col("interval") * 3), "throughput"), F.when(F.col("worst_lead") < 0, "upload-deadline"), F.when(ring > 12, "ring-capacity")))
    return g.select("user_id", "outputs", "p99_decode", "p99_upload", "decode_lead", "upload_lead", recovery.alias("recovery_lead"), F.when(ring <= 12, ring).alias("ring"), "worst_lead", F.array_join(fails, ",").alias("failures"))


@query("""WITH o AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS ord, epoch_us(ts) AS us FROM events),
m AS (SELECT event_type, max(us) FILTER (ord >= 24) - min(us) FILTER (ord >= 24) AS elapsed, count(*) FILTER (ord >= 24) AS measured FROM o GROUP BY event_type)
SELECT event_type, measured, CASE WHEN elapsed > 0 THEN ((measured - 1) * 1000000 * CAST(1800000000 AS HUGEINT) // elapsed)::BIGINT END AS ratio_millionths,
CASE WHEN measured < 300 THEN 'inconclusive' WHEN ((measured - 1) * 1000000 * CAST(1800000000 AS HUGEINT) // elapsed) >= 1500000 THEN 'passed' ELSE 'failed' END AS status FROM m""")
def decoder_throughput(spark, d):
    """24 outputs to warm up, 300 measured at least, 1.5 times the nominal rate over their intervals. Ranks come from counts, so no task orders a whole type."""
    e = timed(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), F.max("us").alias("last"))
    first = timeline.last_rows(timed(spark, d), ["event_type"], [F.col("us"), F.col("event_id")], 25)
    begin = first.groupBy("event_type").agg(F.max("us").alias("first"))
    m = e.join(begin, "event_type").select("event_type", F.greatest(F.col("total") - 24, F.lit(0)).alias("measured"), F.when(F.col("total") > 24, F.col("last") - F.col("first")).alias("elapsed"))
    ratio = S.int_div((F.col("measured") - 1).cast(S.WIDE) * F.lit(1_800_000_000_000_000).cast("decimal(20,0)"), F.col("elapsed").cast(S.WIDE)).cast("long")
    m = m.withColumn("ratio_millionths", F.when(F.col("elapsed") > 0, ratio))
    status = F.when(F.col("measured") < 300, "inconclusive").when(F.col("ratio_millionths") >= 1_500_000, "passed").otherwise("failed")
    return m.select("event_type", "measured", "ratio_millionths", status.alias("status"))


@query("""WITH p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, event_id AS v FROM events WHERE event_type = 'view')
SELECT p.user_id, p.event_id, count(v) AS upto FROM p LEFT JOIN v ON v.user_id = p.user_id AND v.ts <= p.ts GROUP BY p.user_id, p.event_id""")
def trace_upper_bound(spark, d):
    e = timed(spark, d)
    return timeline.counted_upto(e.where("event_type = 'purchase'").select("user_id", "event_id", "us"), e.where("event_type = 'view'"), ["user_id"], "us").select("user_id", "event_id", "upto")


# --- scalar rules


@query("""SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey AS added, l_partkey * l_suppkey AS multiplied, l_suppkey <= l_partkey AND l_partkey + 5 <= l_suppkey + 100 AS contained, l_partkey * 4 / 3 AS width, CAST(l_suppkey AS DOUBLE) AS height, (l_partkey * 4 / 3) / l_suppkey AS aspect,
CASE WHEN l_partkey % 5 <> l_linenumber THEN sign(l_partkey % 5 - l_linenumber) WHEN l_suppkey % 3 <> 1 THEN sign(l_suppkey % 3 - 1) ELSE 0 END::INT AS version, CASE WHEN l_returnflag < l_linestatus THEN -1 WHEN l_returnflag > l_linestatus THEN 1 ELSE 0 END AS utf8,
CASE WHEN l_partkey <= l_suppkey * 7 AND l_suppkey * 7 < 5000 AND l_linenumber <> 3 THEN l_suppkey * 7 - l_partkey + 1 END AS range_length FROM lineitem WHERE l_suppkey > 0""")
def scalar_rules(spark, d):
    x = table(spark, d, "lineitem").where("l_suppkey > 0")
    p, s, n = F.col("l_partkey").cast("long"), F.col("l_suppkey").cast("long"), F.col("l_linenumber")
    size = S.intrinsic_size(p, s, F.lit(4), F.lit(3))
    versions = F.concat_ws(".", F.pmod(p, F.lit(5)), F.pmod(s, F.lit(3)), F.lit("0")), F.concat_ws(".", n, F.lit("1"), F.lit("0"))
    header = F.concat(F.lit(" Bytes "), F.when(n == 3, "0").otherwise(""), p.cast("string"), F.lit("-"), (s * 7).cast("string"), F.lit("/5000\t"))
    found = S.content_range(header)
    return x.select(
        "l_orderkey", "l_linenumber", S.checked_add(p, s).alias("added"), S.checked_multiply(p, s).alias("multiplied"), S.range_contains(s, s + 100, p, p + 5).alias("contained"), size["width"].alias("width"), size["height"].alias("height"), size["aspect"].alias("aspect"),
        S.compare_versions(*versions).alias("version"), S.compare_utf8("l_returnflag", "l_linestatus").alias("utf8"), found.alias("found"),
    ).select("*", (F.col("found.last") - F.col("found.first") + 1).alias("range_length")).drop("found")


@query(r"""SELECT conv_id, turn, regexp_replace('at /home/' || role || '/x.txt and C:\' || role || '\y ' || coalesce(text, ''), '/(?:Users|home)/\S+|[A-Za-z]:\\\S+', '<redacted-path>', 'g') AS summary FROM conversations""")
def path_redaction(spark, d):
    text = F.concat(F.lit("at /home/"), "role", F.lit("/x.txt and C:\\"), "role", F.lit("\\y "), F.coalesce("text", F.lit("")))
    return table(spark, d, "conversations").select("conv_id", "turn", S.redact_paths(text).alias("summary"))


# --- files and back


def _per_order(spark, d, out: str, work: Callable[[int, list[dict]], list[tuple]]) -> DataFrame:
    """Rows of ``work`` for each order's lines, one order at a time."""
    one = F.struct(*_ORDER, "len", "l_returnflag")
    each = lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("ls")).select(F.col("l_orderkey").cast("long").alias("l_orderkey"), "ls")
    names = [c.split()[0] for c in out.split(", ")]

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        for batch in batches:
            rows = [(key, *r) for key, ls in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in work(key, ls)]
            cols = [pa.array([r[0] for r in rows], pa.int64())] + [pa.array([r[k + 1] for r in rows], kinds[c.split()[1]]) for k, c in enumerate(out.split(", "))]
            yield pa.RecordBatch.from_arrays(cols, ["l_orderkey", *names])

    return each.mapInArrow(batches_of, f"l_orderkey long, {out}")


_LS = f"l AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS len, l_returnflag AS flag, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) - 1 AS ordinal FROM lineitem)"


@query(f"WITH {_LS} SELECT l_orderkey, ordinal, ordinal * 4096 AS byte_offset, len AS byte_length, l_linenumber % 3 AS displayed, ordinal * 1001 AS timestamp, CAST(1001 AS BIGINT) AS duration, flag = 'A' AS random_access FROM l")
def index_round_trip(spark, d):
    """Each order's lines as a binary chunk index, read back."""

    def work(_, ls):
        data = formats.encode_index([(k * 4096, x["len"], x["l_linenumber"] % 3, k * 1001, 1001, x["l_returnflag"] == "A") for k, x in enumerate(ls)])
        return [(k, *r) for k, r in enumerate(formats.decode_index(data))]

    return _per_order(spark, d, "ordinal long, byte_offset long, byte_length long, displayed long, timestamp long, duration long, random_access boolean", work)


@query(f"WITH {_LS} SELECT l_orderkey, ordinal * 7 AS timestamp, len AS bytes, sha256(repeat('x', CAST(len AS INT))) AS digest FROM l")
def ivf_round_trip(spark, d):
    """Each order's lines as frames of an IVF file, taken apart again."""

    def work(_, ls):
        body = b"".join(struct.pack("<IQ", x["len"], k * 7) + b"x" * x["len"] for k, x in enumerate(ls))
        head = b"DKIF" + struct.pack("<HH4sHHIIII", 0, 32, b"AV01", 2, 2, 30, 1, len(ls), 0)
        return [(t, len(p), hashlib.sha256(p).hexdigest()) for t, p in formats.demux_ivf(head + body)]

    return _per_order(spark, d, "timestamp long, bytes long, digest string", work)


@query(f"""WITH {_LS}, u AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, flag ORDER BY ordinal) - 1 AS k, coalesce(sum(len) OVER (PARTITION BY l_orderkey, flag ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
SELECT l_orderkey, flag AS unit, k, CAST(before AS BIGINT) AS in_unit, len AS byte_length, true AS aligned, sha256(repeat('x', CAST(len AS INT))) AS digest FROM u""")
def asset_round_trip(spark, d):
    """Each order as an asset file, a unit for each return flag: header, canonical manifest, index and blobs, read back by ranges."""

    def work(key, ls):
        chunks: dict[str, list] = {}
        for x in ls:
            own = chunks.setdefault(x["l_returnflag"], [])
            own.append((b"x" * x["len"], 1, len(own) * 1001, 1001, not own))
        data = assets.write_asset({"id": key}, chunks)
        head, manifest, records = assets.front_index(data[: assets.decode_header(data).index_at + assets.decode_header(data).index_bytes])
        out, at = [], 0
        for unit in manifest["units"]:
            first = records[at][0]
            for k, (offset, length, *_) in enumerate(records[at : at + unit["chunks"]]):
                out.append((unit["id"], k, offset - first, length, first % 8 == 0 and head.file_bytes == len(data), hashlib.sha256(data[offset : offset + length]).hexdigest()))
            at += unit["chunks"]
        return out

    return _per_order(spark, d, "unit string, k long, in_unit long, byte_length long, aligned boolean, digest string", work)


@query(f"WITH {_LS} SELECT l_orderkey, l_linenumber AS line, flag = 'A' AS black, CASE WHEN len % 4 <> 0 THEN len END AS value FROM l")
def samples_round_trip(spark, d):
    """Order lines as strict CSV in the shared folder, read back under its rules."""
    flag = F.col("l_returnflag")
    rows = lines(spark, d).select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), (flag == "A").alias("black"), F.when(F.pmod("len", F.lit(4)) != 0, F.col("len")).alias("value"))
    path = tables.new_path(spark, "samples")
    rows.write.csv(path, header=True)
    return formats.read_samples(spark, path, "l_orderkey long, line long, black boolean, value long", {"value"})


@query("""SELECT user_id, event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS pts, event_type AS kind FROM events""")
def probe_round_trip(spark, d):
    """Events as compact probe text, a line each, parsed back."""
    e = timed(spark, d)
    line = F.concat_ws("|", F.lit("frame"), F.concat(F.lit("pts="), S.int_div("us", 1000)), F.concat(F.lit("id="), "event_id"), F.concat(F.lit("user="), "user_id"), F.concat(F.lit("kind="), "event_type"))
    path = tables.new_path(spark, "probe")
    e.select(line.alias("value")).write.text(path)
    f = formats.read_probe(spark, path).where("section = 'frame'")
    return f.select(F.col("fields")["user"].cast("long").alias("user_id"), F.col("fields")["id"].cast("long").alias("event_id"), F.col("fields")["pts"].cast("long").alias("pts"), F.col("fields")["kind"].alias("kind"))


@query("""SELECT doc_id, doc_id % 3 <> 0 AND text IS NOT NULL AS good FROM documents""")
def verified_blobs(spark, d):
    """Documents whose stated digest is right, and the others (a third is stated wrongly)."""
    said = F.when(F.pmod("doc_id", F.lit(3)) != 0, F.sha2(F.col("text").cast("binary"), 256)).otherwise("0")
    good, bad = formats.verified(table(spark, d, "documents").withColumn("said", said), "text", "said")
    return good.select("doc_id", F.lit(True).alias("good")).unionByName(bad.select("doc_id", F.lit(False).alias("good")))
