"""Decisions of a player, replayed from logs: where a selected edge leaves its source, deadlines, motion, visibility and raw inputs.

The horizon is one expression a row. The others depend on their own earlier decisions and stream over rows sorted by key and order
(``ledgers.folded``): one small state at a time, whatever the length of a key's log. A null operation changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import ledgers


def portal_from(portals: Column, frames: Column, loops: Column, least: Column) -> Column:
    """The first portal at or after ``least``, counted from a body's first lap; null if a body that does not loop has none left."""
    rest = F.when(loops, F.pmod(least, frames)).otherwise(least)
    after = F.array_min(F.filter(portals, lambda p: p >= rest))
    return F.when(loops, least - rest + F.coalesce(after, F.array_min(portals) + frames)).otherwise(after)


def submission_horizon(rows: DataFrame, ring: int) -> DataFrame:
    """Adds kind, reason, boundary, wait and total to rows with the columns ``start`` (cut, finish, portal), ``loops``, ``frames``, ``portals`` (sorted array),
    ``displayed``, ``submitted`` (both counted through all laps), ``elapsed``, ``most``, ``available``, ``transition`` (frames) and ``reversible``.

    Kinds: restart, continue, select, hold, commit, reject. ``wait`` is what remains until the boundary (hold: until the limit); ``total`` adds what has
    elapsed, and of a rejection is the wait that would be needed. A finish of a loop and an empty list of portals have no reachable boundary."""
    c = F.col
    streamed = ~c("reversible")
    a = rows.withColumns({
        "_ready": c("reversible") | (c("available") >= S.required_edge_lead("transition", ring)),
        "_own": portal_from(c("portals"), c("frames"), c("loops"), c("displayed")),
        "_at": portal_from(c("portals"), c("frames"), c("loops"), F.when(streamed, F.greatest("displayed", "submitted")).otherwise(c("displayed"))),
        "_later": portal_from(c("portals"), c("frames"), c("loops"), c("displayed") + 1),
        "_end": c("displayed") == c("frames") - 1,
    })
    # a portal that is shown now but whose edge is not ready gives way to the next one
    late = (c("start") == "portal") & (c("_at") == c("displayed")) & ~c("_ready")
    at = F.when(c("start") == "finish", c("frames") - 1).when(c("start") == "portal", F.when(late, c("_later")).otherwise(c("_at")))
    a = a.withColumns({"_late": F.coalesce(late, F.lit(False)), "boundary": at, "_held": ~c("loops") & c("_end") & ~c("_ready") & ((c("start") == "finish") | late)})
    a = a.withColumn("_wait", F.when(c("start") == "cut", F.lit(1)).when(c("_held"), F.lit(0)).otherwise(c("boundary") - c("displayed")).cast("long"))
    none = ~c("start").eqNullSafe("cut") & (c("_wait").isNull() | ((c("start") == "finish") & c("loops")))
    # a frame that is held adds one more, unless the finish came too late already
    needed = c("elapsed") + c("_wait") + F.when(c("_held") & ((c("start") == "portal") | (c("elapsed") <= c("most"))), 1).otherwise(0)
    a = a.withColumns({"_none": none, "_needed": needed.cast("long")}).withColumn("_over", c("_needed") > c("most"))
    kind = (
        F.when(c("_none") | c("_over"), "reject").when(c("start") == "cut", "restart").when(c("_held"), "hold").when(c("_wait") == 0, "commit").when(c("start") == "finish", "continue").otherwise("select")
    )
    a = a.withColumn("kind", kind)
    why = F.when(c("_none"), "no-reachable-boundary").when(c("_over"), "max-wait-exceeded").when(c("start") == "cut", "cut")
    why = why.when(c("kind") == "select", F.when(c("_late"), "lead-unavailable").when(c("_at") > c("_own"), "submitted-horizon").otherwise("authored-boundary"))
    settled = c("kind").isin("reject", "restart")
    found = {
        "reason": why,
        "boundary": F.when(~settled, F.when(c("_held"), c("displayed")).otherwise(c("boundary"))).cast("long"),
        "wait": F.when(c("kind") == "hold", c("most") - c("elapsed")).when(~settled, c("_wait")).cast("long"),
        "total": F.when(c("_none"), c("most") + 1).when(c("kind") == "hold", c("elapsed")).otherwise(c("_needed")).cast("long"),
    }
    return a.withColumns(found).drop("_ready", "_own", "_at", "_later", "_end", "_late", "_held", "_wait", "_none", "_needed", "_over")


def realtime_ticks(log: DataFrame, keys: list[str], order: str, op: str, at: str, result: str, num: int, den: int) -> DataFrame:
    """Content deadlines at num/den frames a second over logged display callbacks: (keys, order, status, presented, deadline, underflows, smooth).

    Operations at a time in whole microseconds: ``start`` and ``resume`` (which drops the time since), ``callback`` and ``manual`` (a due tick of a clock that does
    not run) with the ``result`` advanced, underflow or stopped, ``pause``, ``stop``. A callback makes one tick at most. An underflow counts once a frame and
    moves the clock by what it is late; an advance does so if a display opportunity was missed or the next deadline has passed. A time that runs backwards, a
    null time and any other result of a due tick end the run as ``failed``; what the state does not allow is ``refused`` or, for callbacks, ``ignored``."""

    def micros(frame: int) -> int:
        return (frame * 2_000_000 * den + num) // (2 * num)

    def fresh() -> dict:
        return {"runs": False, "origin": None, "next": 1, "due": None, "last": None, "told": None, "under": 0, "smooth": True}

    def tick(s: dict, now: int, result: str | None, manual: bool, missed: bool) -> tuple[str, int | None]:
        frame, late = s["next"], max(0, now - s["due"])
        if result == "stopped":
            s["runs"] = s["smooth"] = False
        elif result == "underflow":
            s["smooth"] = False
            s["under"] += s["told"] != frame
            s["told"] = frame
            s["origin"] += late
        elif result == "advanced":
            s["told"], s["next"] = None, frame + 1
            if not manual and (missed or s["origin"] + micros(frame + 1) <= now):
                s["origin"] += late
        else:
            return failed(s), None
        s["due"] = s["origin"] + micros(s["next"])
        return result, frame

    def failed(s: dict) -> str:
        s["runs"] = s["smooth"] = False
        return "failed"

    def act(s: dict, what: str | None, now: int | None, result: str | None) -> tuple[str, int | None]:
        if what == "pause":
            s["runs"] = False
            return "paused", None
        if what == "stop":
            return failed(s).replace("failed", "stopped"), None
        if what not in ("start", "resume", "manual", "callback"):
            return "same", None
        if what == "callback" and not s["runs"]:
            return "ignored", None
        if what == "manual" and s["runs"]:
            return "refused", None
        if now is None:
            return failed(s), None
        if what == "callback":
            before, s["last"] = s["last"], now
            if before is not None and now < before:
                return failed(s), None
            if now < s["due"]:
                return "not-due", None
            return tick(s, now, result, False, before is not None and now - before > micros(1))
        if s["origin"] is None:
            s["origin"], s["due"] = now, now + micros(1)
        elif what == "resume":
            s["due"], s["last"] = now + micros(1), None
            s["origin"] = s["due"] - micros(s["next"])
        if what == "manual":
            return tick(s, s["due"], result, True, False)
        s["runs"] = True
        return "running", None

    def step(s: dict, row: tuple) -> tuple:
        return *act(s, *row[1:]), s["due"], s["under"], s["smooth"]

    out = "status string, presented long, deadline long, underflows long, smooth boolean"
    return ledgers.folded(_named(log, keys, order, op, at, result), keys, [order], ["_a", "_b", "_c"], out, fresh, step)


#: Origins of a static picture from which full motion may be entered again; all others stay.
REENTERED = ("reduced-motion", "context-loss", "visibility-suspended", "decoder-queued")


def motion(log: DataFrame, keys: list[str], order: str, op: str, value: str, generation: str) -> DataFrame:
    """Motion policy: (keys, order, outcome, mode, desired, generation, pending, origin, sticky) after each operation.

    Operations: ``policy`` (value auto, reduce or full), ``host`` (value reduce or none), ``animated``, ``static`` (value: origin) for the first
    preparation, ``next``, ``commit``, ``fail`` (value: origin), ``cancel``, ``dispose``. A commit names the generation of its transition; null is the
    pending one. A change of policy drops a pending transition only if it contradicts it. What the state does not allow is ``refused``, an old commit ``stale``."""

    def fresh() -> dict:
        return {"policy": "auto", "host": False, "mode": "unprepared", "origin": None, "gen": 0, "turn": None}

    def desired(s: dict) -> str:
        return s["policy"] if s["policy"] != "auto" else "reduce" if s["host"] else "full"

    def act(s: dict, what: str | None, v: str | None, gen: int | None) -> str:
        if what == "commit":
            if s["mode"] == "disposed" or s["turn"] is None or gen not in (None, s["turn"][1]):
                return "stale"
            s["mode"], s["origin"] = ("static", "reduced-motion") if s["turn"][0] == "enter-reduced" else ("animated", None)
            s["turn"] = None
            return "committed"
        if s["mode"] == "disposed":
            return "same" if what in ("dispose", None) else "refused"
        if what in ("policy", "host"):
            new = v if what == "policy" else v == "reduce"
            if new == s[what]:
                return "same"
            if what == "policy" and new not in ("auto", "reduce", "full"):
                return "refused"
            s[what] = new
            s["gen"] += 1
            if s["turn"] and (s["turn"][0] == "enter-reduced") != (desired(s) == "reduce"):
                s["turn"] = None
            return "changed"
        if what in ("animated", "static"):
            if s["mode"] != "unprepared" or (what == "static" and v is None):
                return "refused"
            s["mode"], s["origin"] = what, v if what == "static" else None
            return "installed"
        if what == "next":
            if s["turn"] is None and s["mode"] == "animated" and desired(s) == "reduce":
                s["turn"] = ("enter-reduced", s["gen"])
            elif s["turn"] is None and s["mode"] == "static" and s["origin"] in REENTERED and desired(s) == "full":
                s["turn"] = ("enter-full", s["gen"])
            return s["turn"][0] if s["turn"] else "none"
        if what == "fail":
            if s["mode"] == "unprepared" or v in ("reduced-motion", None):
                return "refused"
            s["mode"], s["origin"], s["turn"] = "static", v, None
        elif what == "cancel" and s["turn"]:
            s["turn"] = None
        elif what == "dispose":
            s["mode"], s["origin"], s["turn"] = "disposed", None, None
        else:
            return "same"
        s["gen"] += 1
        return {"fail": "failed", "cancel": "cancelled"}.get(what, "disposed")

    def step(s: dict, row: tuple) -> tuple:
        outcome = act(s, *row[1:])
        sticky = s["mode"] == "static" and s["origin"] is not None and s["origin"] not in REENTERED
        return outcome, s["mode"], desired(s), s["gen"], s["turn"] and s["turn"][0], s["origin"], sticky

    out = "outcome string, mode string, desired string, generation long, pending string, origin string, sticky boolean"
    return ledgers.folded(_named(log, keys, order, op, value, generation), keys, [order], ["_a", "_b", "_c"], out, fresh, step)


def visibility(log: DataFrame, keys: list[str], order: str, op: str, generation: str, ordinal: str, first: str = "visible") -> DataFrame:
    """Visibility policy: (keys, order, outcome, visibility, suspension, generation, frozen, rebuild, pending) after each operation.

    Operations: ``visible``, ``hidden``, ``next``, ``suspended`` (commit; ``ordinal`` is frozen), ``active`` (commit), ``fail`` (of a resume), ``initial``
    (``ordinal`` of a player that starts hidden), ``dispose``. Commits name the generation of their transition; null is the pending one."""

    def fresh() -> dict:
        return {"seen": first, "sus": "active" if first == "visible" else "suspended", "gen": 0, "frozen": None, "rebuild": False, "turn": None, "gone": False}

    def act(s: dict, what: str | None, gen: int | None, at: int | None) -> str:
        if what in ("suspended", "active", "fail"):
            wanted = "suspend" if what == "suspended" else "resume"
            if s["turn"] is None or s["turn"][0] != wanted or gen not in (None, s["turn"][1]) or (what == "suspended" and (at is None or at < 0)):
                return "stale"
            s["turn"], s["rebuild"] = None, False
            if what != "fail":
                s["sus"], s["frozen"] = what, at if what == "suspended" else None
            return "failed" if what == "fail" else "committed"
        if what == "next":
            if s["turn"] is None and not s["gone"]:
                if s["seen"] == "hidden" and s["sus"] == "suspending":
                    s["turn"] = ("suspend", s["gen"])
                elif s["seen"] == "visible" and s["sus"] == "suspended" and s["rebuild"]:
                    s["turn"] = ("resume", s["gen"])
            return s["turn"][0] if s["turn"] else "none"
        if s["gone"]:
            return "same" if what in ("dispose", None) else "refused"
        if what == "initial":
            if (s["seen"], s["sus"]) != ("hidden", "suspended") or at is None or at < 0:
                return "refused"
            s["frozen"] = at
            return "installed"
        if what == "dispose":
            s["gone"], s["turn"], s["rebuild"] = True, None, False
            s["gen"] += 1
            return "disposed"
        if what not in ("visible", "hidden") or what == s["seen"]:
            return "same"
        s["seen"], s["turn"] = what, None
        s["gen"] += 1
        if what == "hidden":
            s["rebuild"] = False
            if s["sus"] == "active":
                s["sus"] = "suspending"
        elif s["sus"] == "suspending":
            s["sus"], s["frozen"], s["rebuild"] = "active", None, False
        elif s["sus"] == "suspended":
            s["rebuild"] = s["frozen"] is not None
            if not s["rebuild"]:
                s["sus"] = "active"
        return "changed"

    def step(s: dict, row: tuple) -> tuple:
        outcome = act(s, *row[1:])
        return outcome, s["seen"], s["sus"], s["gen"], s["frozen"], s["rebuild"], s["turn"] and s["turn"][0]

    out = "outcome string, visibility string, suspension string, generation long, frozen long, rebuild boolean, pending string"
    return ledgers.folded(_named(log, keys, order, op, generation, ordinal), keys, [order], ["_a", "_b", "_c"], out, fresh, step)


#: Raw inputs, the binding each is, the engagement it sets and to what.
INPUTS = {"pointerenter": ("pointer.enter", "pointer", True), "pointerleave": ("pointer.leave", "pointer", False), "focusin": ("focus.in", "focus", True), "focusout": ("focus.out", "focus", False)}


def automatic_inputs(log: DataFrame, keys: list[str], order: str, op: str, flag: str, hover: str, focused: str) -> DataFrame:
    """Raw inputs to binding sources: (keys, order, sources, engaged), the sources of an operation joined by commas in the order they are sent.

    Inputs: ``pointerenter``, ``pointerleave`` (flag: by touch, which hides hovering), ``focusin``, ``focusout`` (flag: to a part of the same element, which is
    no leaving), ``click``. Conditions: ``enabled``, ``ready``, ``shown`` and ``target`` with the flag as value; sources go out while the first three hold, and
    inputs come in while there is a target and inputs are enabled. ``hover`` and ``focused`` are what the element reports when it is sampled: whenever a
    condition comes true, at each ``ready`` and at ``sample``. A null flag counts as false."""

    def fresh() -> dict:
        return {"enabled": True, "ready": False, "shown": True, "target": False, "touch": False, "pointer": False, "focus": False}

    def step(s: dict, row: tuple) -> tuple:
        what, flag, hover, focused = row[1], bool(row[2]), bool(row[3]), bool(row[4])
        sent: list[str] = []
        sampled, before = what == "sample", s["pointer"] or s["focus"]
        if what in ("enabled", "ready", "shown", "target"):
            sampled = flag and (what == "ready" or not s[what])
            if what in ("enabled", "target") and flag != s[what]:
                s["touch"] = False
            s[what] = flag
        elif what == "click" and s["target"] and s["enabled"]:
            sent.append("activate")
        elif what in INPUTS and s["target"] and s["enabled"]:
            source, kind, on = INPUTS[what]
            touched = flag and kind == "pointer"
            if kind == "pointer":
                s["touch"] = touched
            if touched or not (flag and what == "focusout"):
                s[kind] = on and not touched
                if not touched:
                    sent.append(source)
                if (s["pointer"] or s["focus"]) != before:
                    sent.append("engagement.off" if before else "engagement.on")
        live = s["enabled"] and s["ready"] and s["shown"]
        if sampled and live and s["target"]:
            s["pointer"], s["focus"] = hover and not s["touch"], focused
            sent = ["pointer.enter" if s["pointer"] else "pointer.leave", "focus.in" if focused else "focus.out", "engagement.on" if s["pointer"] or focused else "engagement.off"]
        return ",".join(sent) if live else "", s["pointer"] or s["focus"]

    return ledgers.folded(_named(log, keys, order, op, flag, hover, focused), keys, [order], ["_a", "_b", "_c", "_d"], "sources string, engaged boolean", fresh, step)


def _named(log: DataFrame, keys: list[str], order: str, *used: str) -> DataFrame:
    """The columns a fold reads, its arguments under names of their own: one column may serve twice or be named like a result."""
    return log.select(*[F.col(k) for k in keys], F.col(order), *[F.col(u).alias(f"_{x}") for u, x in zip(used, "abcd", strict=False)])
