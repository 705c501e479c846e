"""Scalar functions, as Catalyst expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest integer that the formats allow.
SAFE = 9007199254740991
WIDE = "decimal(38,0)"


def _c(x: Column | str | int) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def int_div(a: Column | str | int, b: Column | str | int) -> Column:
    """Integer quotient of non-negative numbers, exact for decimals as well."""
    return F.call_function("div", _c(a), _c(b))


def ceil_div(a: Column | str | int, b: Column | str | int) -> Column:
    return int_div(_c(a) + _c(b) - 1, b)


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp read as UTC."""
    return F.unix_micros(F.to_utc_timestamp(_c(ts).cast("timestamp"), F.current_timezone()))


def frame_micros(frame: Column | str, num: int | Column, den: int | Column) -> Column:
    """Exact microseconds of a frame at the rate num/den, half rounded up."""
    f, n, d = (_c(x).cast(WIDE) for x in (frame, num, den))
    return int_div(f * 2000000 * d + n, n * 2).cast("long")


def frame_duration(frame: Column | str, num: int, den: int) -> Column:
    return frame_micros(_c(frame) + 1, num, den) - frame_micros(frame, num, den)


def virtual_frame(frame: Column | str, count: Column | str | int) -> tuple[Column, Column]:
    """(iteration, local frame) of a looped unit."""
    return int_div(frame, count), F.pmod(_c(frame), _c(count))


def align8(x: Column | str) -> Column:
    return int_div(_c(x) + 7, 8) * 8


def checked_add(a: Column, b: Column, limit: int = SAFE) -> Column:
    """Sum, or an error above ``limit``."""
    total = a.cast(WIDE) + b.cast(WIDE)
    return F.when(total <= limit, total.cast("long")).otherwise(F.raise_error(F.lit("sum exceeds its limit")).cast("long"))


def checked_multiply(a: Column, b: Column, limit: int = SAFE) -> Column:
    total = (a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast(WIDE)
    return F.when(total <= limit, total.cast("long")).otherwise(F.raise_error(F.lit("product exceeds its limit")).cast("long"))


def range_contains(outer_start: Column, outer_end: Column, start: Column, end: Column) -> Column:
    return (outer_start <= start) & (end <= outer_end)


def ranges_intersect(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 < b1) & (b0 < a1)


def _euclid(a: Column, b: Column, finish) -> Column:
    """Euclid's algorithm as a fold, from the greater number down; 1.45 steps for each bit of the lesser one are enough."""
    small, great = F.least(a, b), F.greatest(a, b)
    steps = F.ceil(F.log2(F.greatest(small, F.lit(2).cast("long"))) * 1.45).cast("int") + 2
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.pmod(s["x"], F.when(s["y"] == 0, F.lit(1)).otherwise(s["y"])).cast("long").alias("y")))
    return F.aggregate(F.sequence(F.lit(1), steps), F.struct(great.alias("x"), small.alias("y")), step, finish)


def gcd(a: Column | str, b: Column | str) -> Column:
    return _euclid(_c(a).cast("long"), _c(b).cast("long"), lambda s: s["x"])


def parse_rational(text: Column | str) -> Column:
    """'p/q' as a reduced struct (num, den); null for anything else or a zero denominator."""
    ok = _c(text).rlike(r"^[0-9]+/[0-9]*[1-9][0-9]*$")
    p, q = (F.try_element_at(F.split(_c(text), "/"), F.lit(k)).try_cast("long") for k in (1, 2))
    return F.when(ok, _euclid(p, q, lambda s: F.struct(int_div(p, s["x"]).alias("num"), int_div(q, s["x"]).alias("den"))))


def decimal_seconds_micros(text: Column | str) -> Column:
    """Decimal seconds as microseconds, half rounded up; null for other text."""
    return F.when(_c(text).rlike(r"^[0-9]+(\.[0-9]+)?$"), F.floor(_c(text).cast("decimal(30,12)") * 1000000 + F.lit(0.5).cast("decimal(2,1)")).cast("long"))


def next_body_frame(kind: Column | str, frame: Column | str, count: Column | str) -> Column:
    """(frame, advanced, wrapped, held) after one step of a loop, finite or held body."""
    k, f, n = _c(kind), _c(frame), _c(count)
    last = f >= n - 1
    nxt = F.when(k == "held", f).when(~last, f + 1).when(k == "loop", F.lit(0)).otherwise(n - 1)
    return F.struct(nxt.cast("long").alias("frame"), ((k == "loop") | ((k == "finite") & ~last)).alias("advanced"), ((k == "loop") & last).alias("wrapped"), ((k == "held") | ((k == "finite") & last)).alias("held"))


def srgb_to_linear(v: Column | str) -> Column:
    return F.when(_c(v) <= 0.04045, _c(v) / 12.92).otherwise(F.pow((_c(v) + 0.055) / 1.055, F.lit(2.4)))


def marker_fields(v: Column | str) -> Column:
    """16-bit value, its complement and its parity."""
    low = _c(v).bitwiseAND(F.lit(65535).cast("long"))
    return F.struct(low.alias("value"), low.bitwiseXOR(F.lit(65535).cast("long")).alias("complement"), F.pmod(F.bit_count(low), F.lit(2)).alias("parity"))


def compare_versions(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1; missing parts count as 0."""
    x, y = (F.transform(F.split(_c(v), r"\."), lambda p: p.cast("long")) for v in (a, b))
    signs = F.zip_with(x, y, lambda p, q: F.signum(F.coalesce(p, F.lit(0)) - F.coalesce(q, F.lit(0))).cast("int"))
    return F.coalesce(F.try_element_at(F.filter(signs, lambda s: s != 0), F.lit(1)), F.lit(0))


def content_range(header: Column | str) -> Column:
    """'bytes a-b/n', in any case and between blanks, as (first, last, total); null if malformed, out of order or unsafe."""
    part = [F.regexp_extract(_c(header), r"(?i)^[\t ]*bytes (0|[1-9][0-9]*)-(0|[1-9][0-9]*)/(0|[1-9][0-9]*)[\t ]*$", k).try_cast("long") for k in (1, 2, 3)]
    return F.when((part[0] <= part[1]) & (part[1] < part[2]) & (part[2] <= SAFE), F.struct(part[0].alias("first"), part[1].alias("last"), part[2].alias("total")))


def measured_bitrate(bytes_: Column, frames: Column, num: int, den: int) -> Column:
    """Bits per second over whole frames, rounded up, 1 at least."""
    return F.greatest(F.lit(1).cast("long"), ceil_div(bytes_.cast(WIDE) * 8 * num, frames.cast(WIDE) * den).cast("long"))


def allocation(bytes_: Column, num: int = 5, den: int = 4) -> Column:
    """Bytes with overhead num/den, rounded up."""
    return ceil_div(bytes_ * num, den)


def required_edge_lead(transition_frames: Column | str, ring: Column | str | int) -> Column:
    """Consecutive frames an edge needs: its transition and the target's entry, two at least and the ring at most."""
    return F.least(F.greatest(_c(transition_frames) + 1, F.lit(2)), _c(ring))


def edge_lead_plan(transition_frames: Column | str, available: Column | str, ring: Column | str | int) -> Column:
    """What of the required lead is missing, and what is shown first."""
    required = required_edge_lead(transition_frames, ring)
    missing = F.greatest(required - _c(available), F.lit(0))
    first = F.when(_c(transition_frames) == 0, "target-body").otherwise("bridge")
    return F.struct(first.alias("first"), required.alias("required"), missing.alias("missing"), (missing == 0).alias("ready"))


def intrinsic_size(width: Column, height: Column, num: Column, den: Column) -> Column:
    """Display size of a picture with non-square pixels, and its aspect."""
    w = width * num / den
    return F.struct(w.alias("width"), height.cast("double").alias("height"), (w / height).alias("aspect"))


def compare_utf8(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1 in the order of UTF-8 bytes, which is Spark's own for strings."""
    return F.when(_c(a) < _c(b), -1).when(_c(a) > _c(b), 1).otherwise(0)


def redact_paths(text: Column | str) -> Column:
    """Home folders' paths, on either kind of system, as a placeholder."""
    return F.regexp_replace(_c(text), r"/(?:Users|home)/\S+|[A-Za-z]:\\\S+", "<redacted-path>")


#: Codec strings that the format allows. Fixed values.
H264 = r"^avc1\.6400(0A|0B|0C|0D|14|15|16|1E|1F|20|28|29|2A|32|33|34|3C|3D|3E)$"
H265 = r"^hvc1\.1\.(0|[1-9A-F][0-9A-F]*)\.[LH](0|[1-9][0-9]*)\.(([0-9A-F]{2}\.){0,5}(0[1-9A-F]|[1-9A-F][0-9A-F]))$"
VP9 = r"^vp09\.00\.(10|11|20|21|30|31|40|41|50|51|52|60|61|62)\.08(\.01\.01\.01\.01\.00)?$"
AV1 = r"^av01\.0\.(0[0-9]|[12][0-9]|3[01])[MH]\.(08|10)(\.0\.11[0-3]\.01\.01\.01\.0)?$"


def codec_string(text: Column | str) -> Column:
    """(family, bit_depth) of a canonical codec string; null for any other."""
    t = _c(text)
    whole = lambda pattern, k, base: F.conv(F.regexp_extract(t, pattern, k), base, 10).try_cast("decimal(20,0)")
    flags, level, first = whole(H265, 1, 16), whole(H265, 2, 10), F.conv(F.substring(F.regexp_extract(t, H265, 3), 1, 2), 16, 10).try_cast("int")
    # the second compatibility flag; of the first constraint byte: progressive, not interlaced, frames only
    main = (flags <= 0xFFFFFFFF) & (F.pmod(int_div(flags, 2), F.lit(2)) == 1) & level.between(1, 255) & (first.bitwiseAND(F.lit(0xD0)) == 0x90)
    found = lambda family, depth: F.struct(F.lit(family).alias("family"), depth.cast("int").alias("bit_depth"))
    eight = F.lit(8)
    return (
        F.when(t.rlike(H264), found("h264", eight))
        .when(t.rlike(H265) & main, found("h265", eight))
        .when(t.rlike(VP9), found("vp9", eight))
        .when(t.rlike(AV1), found("av1", F.regexp_extract(t, AV1, 2)))
    )


#: Rows between the colour pane and the alpha pane. Fixed value.
GUTTER = 8


def rendition_geometry(canvas: tuple, visible: tuple, packed: Column, align: tuple) -> Column:
    """Storage and coded geometry of a picture; null where the visible part does not fit the canvas or has another aspect."""
    (cw, ch), (vw, vh) = ([_c(x).cast("long") for x in pair] for pair in (canvas, visible))
    up = lambda x, by: ceil_div(x, _c(by)) * _c(by)
    pane_w, pane_h = up(vw, 2), up(vh, 2)
    stored = F.when(packed, pane_h * 2 + GUTTER).otherwise(pane_h)
    coded_w, coded_h = up(pane_w, align[0]), up(stored, align[1])
    ok = (vw >= 1) & (vh >= 1) & (vw <= cw) & (vh <= ch) & (vw.cast(WIDE) * ch.cast(WIDE) == vh.cast(WIDE) * cw.cast(WIDE))
    return F.when(ok, F.struct(
        pane_w.alias("storage_width"), stored.alias("storage_height"), F.when(packed, pane_h + GUTTER).alias("alpha_y"), coded_w.alias("coded_width"), coded_h.alias("coded_height"),
        checked_multiply(vw, vh).alias("visible_area"), checked_multiply(checked_multiply(pane_w, stored), F.lit(4)).alias("decoded_bytes"), checked_multiply(checked_multiply(coded_w, coded_h), F.lit(4)).alias("coded_bytes"),
    ))


def alpha_policy(requested: Column | str, opaque: Column) -> Column:
    """(selected, warning, rejected): 'auto' packs what is not opaque, 'opaque' rejects it, 'packed' warns of what needs no packing."""
    r = _c(requested)
    rejected = (r == "opaque") & ~opaque
    selected = F.when(rejected, None).when(r == "auto", F.when(opaque, "opaque").otherwise("packed")).otherwise(r)
    return F.struct(selected.alias("selected"), ((r == "packed") & opaque).alias("warning"), rejected.alias("rejected"))


def lead_frames(latency: Column, frame: Column) -> Column:
    """Frames that a latency takes, rounded up but for errors of the last bits."""
    ratio = latency / frame
    near = F.floor(ratio + 0.5)
    tolerance = F.greatest(F.lit(1.0), F.abs(ratio)) * (8 * 2.0**-52)
    return F.when(F.abs(ratio - near) <= tolerance, near).otherwise(F.ceil(ratio)).cast("long")
