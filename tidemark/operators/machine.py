"""Deterministic state machine over an ordered input log: one state per key, effects as rows.

``Machine`` is a pure reducer whose whole state is a JSON-able dictionary, so the same code runs over a
sorted batch (rows stream through; a key's rows are never collected) and over a stream with per-key state.

Input kinds: begin, begin-static, resume, recover, fail, dispose, request (target), send (event), tick (ready).
Rules that are easy to get wrong: a rejected 33rd input of a tick still takes a sequence number; a cut
starts on the next tick whether or not the route is ready; a request for the pending target joins its group and one
for another target supersedes it; an event aborts pending requests unless it repeats the pending edge.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed limits of the format.
INPUTS_PER_TICK = 32
ROUTES_PER_TICK = 64

EFFECT = "key long, seq long, pos int, type string, from string, to string, edge_id string, sequence long, reason string, request_ids array<long>, outcome string"
_NAMES = ["type", "from", "to", "edge_id", "sequence", "reason", "request_ids", "outcome"]


class MachineError(ValueError):
    """An input that the machine cannot take in its state."""


@dataclass
class Graph:
    """states: id -> {kind, frames, ports: {name: [frames]}, intro?: frames}; edges: list of
    {id, from, to, event?, completion?, start: cut|portal|finish, port?, transition?: {kind, frames, direction}, inverse?}."""

    initial: str
    states: dict[str, dict]
    edges: list[dict]
    by_id: dict[str, dict] = field(init=False)

    def __post_init__(self) -> None:
        self.by_id = {e["id"]: e for e in self.edges}

    def direct(self, a: str, b: str) -> dict | None:
        return next((e for e in self.edges if e["from"] == a and e["to"] == b), None)

    def by_event(self, a: str, event: str) -> dict | None:
        return next((e for e in self.edges if e["from"] == a and e.get("event") == event), None)

    def completion(self, a: str) -> dict | None:
        return next((e for e in self.edges if e["from"] == a and e.get("completion")), None)

    def inverse(self, edge: dict | None) -> dict | None:
        return self.by_id.get(edge.get("inverse")) if edge else None


def fresh(graph: Graph) -> dict:
    """The state right after installation."""
    return {
        "readiness": "preparing", "phase": "preparing", "requested": graph.initial, "visual": graph.initial, "frame": 0, "intro_due": True, "slots": {}, "group": None,
        "next_request": 1, "sequence": 0, "inputs": 0, "routes": 0, "ordinal": None,
    }


class Machine:
    def __init__(self, graph: Graph, state: dict | None = None) -> None:
        self.graph, self.s = graph, state or fresh(graph)
        self.out: list[dict] = []

    # effects

    def _say(self, kind: str, **more) -> None:
        self.out.append({"type": kind, **more})

    def _settle(self, outcome: str, ids: list[int] | None = None) -> None:
        if ids is None:
            ids, self.s["group"] = (self.s["group"] or {}).get("ids"), None
        if ids:
            self._say("settle", request_ids=ids, outcome=outcome)

    def _readiness(self, to: str, reason: str | None = None) -> None:
        if self.s["readiness"] != to:
            self._say("readinesschange", **{"from": self.s["readiness"]}, to=to, reason=reason)
            self.s["readiness"] = to

    def _move(self, which: str, to: str, sequence: int | None = None) -> None:
        if self.s[which] != to:
            self._say(f"{which}statechange", **{"from": self.s[which]}, to=to, sequence=sequence)
            self.s[which] = to

    def _edge(self, slot: str) -> dict | None:
        held = self.s["slots"].get(slot)
        return self.graph.by_id[held[0]] if held else None

    def _mark(self, kind: str, edge: dict, sequence: int | None = None) -> None:
        self._say(kind, edge_id=edge["id"], **{"from": edge["from"]}, to=edge["to"], sequence=sequence)

    # routes

    def _arrive(self, edge: dict) -> None:
        """An active edge ends: its target's body begins, and what was queued behind it waits."""
        s = self.s
        s["frame"] = 0
        self._move("visual", edge["to"])
        self._mark("transitionend", edge)
        behind = s["slots"].get("follow")
        s["slots"] = {"pending": behind} if behind else {}
        s["phase"] = "waiting" if behind else "stable"
        if not behind and s["requested"] == s["visual"]:
            self._settle("resolve:target-committed")

    def _depart(self, edge: dict, sequence: int) -> None:
        self.s["routes"] += 1
        if self.s["routes"] > ROUTES_PER_TICK:
            raise MachineError("too many routing operations in a tick")
        self.s["slots"] = {"active": [edge["id"], sequence]}
        self._mark("transitionstart", edge, sequence)
        how = edge.get("transition")
        if how is None:
            self._arrive(edge)
            return
        self.s["phase"] = how["kind"]
        self.s["frame"] = how["frames"] - 1 if how.get("direction") == "reverse" else 0

    def _jump(self, edge: dict, sequence: int, outcome: str) -> None:
        """A static machine takes an edge at once."""
        self._mark("transitionstart", edge, sequence)
        self._left_initial(edge["to"])
        self._move("visual", edge["to"])
        self._mark("transitionend", edge)
        self._settle(outcome)
        self.s["slots"], self.s["phase"] = {}, "static"

    def _left_initial(self, to: str) -> None:
        if self.s["readiness"] == "static" and to != self.graph.initial:
            self.s["intro_due"] = False

    # decisions: (action, edge)

    def _want(self, target: str) -> tuple[str, dict | None]:
        s, phase, here = self.s, self.s["phase"], self.s["visual"]
        pending, active = self._edge("pending"), self._edge("active")
        if phase in ("locked", "reversible"):
            ahead = self._edge("reversal") or active
            back = self.graph.inverse(active) if phase == "reversible" else None
            if target == active["to"]:
                return "keep-active", None
            if target == ahead["to"]:
                return "keep-reversal", None
            if back and target == back["to"]:
                return "reverse", back
            edge = self.graph.direct(ahead["to"], target)
            return ("follow", edge) if edge else ("reject", None)
        if phase == "waiting" and target == pending["to"]:
            return "join", None
        if target == here:
            if phase == "waiting":
                return "cancel", None
            early = phase in ("preparing", "intro") and (pending or s["group"])
            return ("cancel-early" if early else "noop"), None
        edge = self.graph.direct(here, target)
        if edge is None:
            return "reject", None
        return ("jump" if phase == "static" else "replace"), edge

    def _event_edge(self, event: str) -> dict | None:
        s, hit = self.s, lambda e: e is not None and e.get("event") == event
        if s["phase"] in ("locked", "reversible"):
            active, ahead = self._edge("active"), self._edge("reversal") or self._edge("active")
            back = self.graph.inverse(active) if s["phase"] == "reversible" else None
            return back if hit(back) else active if hit(active) else self.graph.by_event(ahead["to"], event)
        if s["phase"] in ("preparing", "intro", "waiting"):
            back = self.graph.inverse(self._edge("pending"))
            if hit(back):
                return back
        return self.graph.by_event(s["visual"], event)

    def _heard(self, event: str) -> tuple[str, dict | None]:
        s, phase, edge = self.s, self.s["phase"], self._event_edge(event)
        if edge is None:
            return "reject", None
        if phase == "static":
            return "jump", edge
        if phase in ("locked", "reversible"):
            active, follow = self._edge("active"), self._edge("follow")
            ahead = self._edge("reversal") or active
            back = self.graph.inverse(active) if phase == "reversible" else None
            same = lambda other: other is not None and other["id"] == edge["id"]
            if (same(ahead) and follow is None) or (same(follow) and not same(active) and not same(back)):
                return "noop", edge
            return ("keep-active" if same(active) else "reverse" if same(back) else "follow"), edge
        pending = self._edge("pending")
        if pending and edge["to"] == s["visual"]:
            return "cancel", edge
        return ("noop" if pending and pending["id"] == edge["id"] else "replace"), edge

    def _enact(self, action: str, edge: dict | None, sequence: int) -> None:
        s, slots = self.s, self.s["slots"]
        if action == "replace":
            s["slots"] = {"pending": [edge["id"], sequence]}
            if s["phase"] not in ("preparing", "intro"):
                s["phase"] = "waiting"
        elif action == "keep-active":
            slots.pop("follow", None)
            slots.pop("reversal", None)
        elif action == "keep-reversal":
            slots.pop("follow", None)
        elif action == "reverse":
            slots.pop("follow", None)
            slots["reversal"] = [edge["id"], sequence]
        elif action == "follow":
            slots["follow"] = [edge["id"], sequence]
        elif action in ("cancel", "cancel-early"):
            slots.pop("pending", None)
            if s["phase"] == "waiting":
                s["phase"] = "stable"
        elif action == "jump":
            self._jump(edge, sequence, "resolve:target-committed")

    # inputs

    def _admit(self) -> tuple[int, bool]:
        self.s["sequence"] += 1
        ok = self.s["inputs"] < INPUTS_PER_TICK
        self.s["inputs"] += ok
        return self.s["sequence"], ok

    def _new_id(self) -> int:
        self.s["next_request"] += 1
        return self.s["next_request"] - 1

    def request(self, target: str) -> None:
        sequence, ok = self._admit()
        over = self.s["readiness"] in ("disposed", "error")
        error = "InputOverflowError" if not ok else "AbortError" if over else None if target in self.graph.states else "RouteError"
        action, edge = ("reject", None) if error else self._want(target)
        if action == "reject":
            self._settle(f"reject:{error or 'RouteError'}", [self._new_id()])
            return
        if action == "noop":
            self._settle("resolve:stable-noop", [self._new_id()])
            return
        request, group = self._new_id(), self.s["group"]
        if group and group["target"] == target:
            group["ids"].append(request)
            old = None
        else:
            old, self.s["group"] = group, {"target": target, "ids": [request]}
        if action == "join":
            return
        self._move("requested", target, sequence)
        if old:
            self._settle("reject:AbortError", old["ids"])
        self._enact(action, edge, sequence)
        if action in ("cancel", "cancel-early"):
            self._settle("resolve:stable-noop")

    def send(self, event: str) -> None:
        sequence, ok = self._admit()
        if not ok or self.s["readiness"] in ("disposed", "error"):
            return
        action, edge = self._heard(event)
        if action in ("reject", "noop"):
            return
        self._move("requested", edge["to"], sequence)
        self._settle("reject:AbortError")
        self._enact(action, edge, sequence)

    def tick(self, ready: bool = True, ordinal: int | None = None) -> None:
        s = self.s
        if s["readiness"] in ("disposed", "error"):
            raise MachineError("a terminated machine cannot tick")
        due = 0 if s["ordinal"] is None else s["ordinal"] + 1
        if ordinal is not None and ordinal != due:
            raise MachineError(f"tick {ordinal} is not consecutive: {due} is due")
        s["ordinal"], s["routes"] = due, 0
        getattr(self, f"_tick_{s['phase']}", lambda _: None)(ready)
        s["inputs"] = 0

    def _tick_intro(self, _: bool) -> None:
        s = self.s
        s["frame"] += 1
        if s["frame"] >= self.graph.states[s["visual"]]["intro"]:
            s["frame"], s["intro_due"] = 0, False
            s["phase"] = "waiting" if s["slots"].get("pending") else "stable"

    def _advance(self) -> None:
        body, s = self.graph.states[self.s["visual"]], self.s
        last = s["frame"] >= body["frames"] - 1
        s["frame"] = (0 if body["kind"] == "loop" else s["frame"]) if last else s["frame"] + 1

    def _tick_stable(self, ready: bool) -> None:
        s = self.s
        edge, body = self.graph.completion(s["visual"]), self.graph.states[s["visual"]]
        if edge and s["frame"] == body["frames"] - 1 and (ready or edge["start"] == "cut"):
            s["sequence"] += 1
            self._move("requested", edge["to"], s["sequence"])
            self._depart(edge, s["sequence"])
        else:
            self._advance()

    def _tick_waiting(self, ready: bool) -> None:
        s, edge = self.s, self._edge("pending")
        body = self.graph.states[s["visual"]]
        here = s["frame"] in body["ports"][edge["port"]] if edge["start"] == "portal" else s["frame"] == body["frames"] - 1
        if edge["start"] == "cut" or (here and ready):
            self._depart(edge, s["slots"]["pending"][1])
        else:
            self._advance()

    def _tick_locked(self, _: bool) -> None:
        edge = self._edge("active")
        self.s["frame"] += 1
        if self.s["frame"] >= edge["transition"]["frames"]:
            self._arrive(edge)

    def _tick_reversible(self, _: bool) -> None:
        s = self.s
        if "reversal" in s["slots"]:
            s["slots"]["active"] = s["slots"].pop("reversal")
            self._mark("transitionstart", self._edge("active"), s["slots"]["active"][1])
        edge = self._edge("active")
        s["frame"] += -1 if edge["transition"]["direction"] == "reverse" else 1
        if not 0 <= s["frame"] < edge["transition"]["frames"]:
            self._arrive(edge)

    def begin(self) -> None:
        self._expect("preparing")
        self._readiness("animated")
        self._enter()

    def _enter(self) -> None:
        s = self.s
        s["frame"] = 0
        if "intro" in self.graph.states[s["visual"]] and s["visual"] == self.graph.initial and s["intro_due"]:
            s["phase"] = "intro"
        else:
            s["phase"] = "waiting" if s["slots"].get("pending") else "stable"

    def begin_static(self, reason: str = "") -> None:
        self._expect("preparing")
        self._readiness("static", reason)
        self._say("fallback", reason=reason)
        s = self.s
        s["phase"] = "static"
        if s["visual"] != s["requested"]:
            edge = self.graph.direct(s["visual"], s["requested"])
            if edge is None:
                raise MachineError("no direct route to the prepared target")
            self._jump(edge, (s["slots"].get("pending") or [None, s["sequence"]])[1], "resolve:static-recovery")
        s["slots"] = {}

    def resume(self) -> None:
        self._expect("static")
        if self.s["requested"] != self.s["visual"] or self.s["slots"] or self.s["group"]:
            raise MachineError("only one settled static state can resume")
        self._readiness("animated")
        self._enter()

    def recover(self, reason: str = "") -> None:
        """Falls back to the still of the requested state, finishing the route that represents the intent."""
        s = self.s
        if s["readiness"] in ("disposed", "error"):
            raise MachineError("a terminated machine cannot recover")
        self._readiness("static", reason)
        self._say("fallback", reason=reason)
        if s["visual"] != s["requested"] or s["slots"]:
            slot = next((k for k in ("follow", "reversal", "active", "pending") if s["slots"].get(k)), None)
            edge = self._edge(slot) if slot else self.graph.direct(s["visual"], s["requested"])
            if edge and edge is not self._edge("active"):
                self._mark("transitionstart", edge, s["slots"][slot][1] if slot else s["sequence"])
            self._left_initial(s["requested"])
            self._move("visual", s["requested"])
            if edge:
                self._mark("transitionend", edge)
            self._settle("resolve:static-recovery")
        s["slots"], s["phase"] = {}, "static"

    def fail(self, reason: str = "") -> None:
        self._readiness("error", reason)
        self._settle("reject:PlaybackFallbackError")
        self.s["slots"], self.s["phase"] = {}, "error"

    def dispose(self) -> None:
        if self.s["readiness"] != "disposed":
            self._settle("reject:AbortError")
            self._readiness("disposed")
            self.s["slots"], self.s["phase"] = {}, "disposed"

    def _expect(self, phase: str) -> None:
        if self.s["phase"] != phase:
            raise MachineError(f"needs the phase {phase}, not {self.s['phase']}")

    def apply(self, kind: str, value: str | None = None, ready: bool | None = True) -> list[dict]:
        """Effects of one input; an input that cannot be taken leaves the state as it was and is one ``error`` effect."""
        self.out = []
        before = json.dumps(self.s)
        try:
            if kind == "tick":
                self.tick(True if ready is None else ready)
            elif kind in ("request", "send"):
                getattr(self, kind)(value)
            else:
                call = {"begin": self.begin, "resume": self.resume, "dispose": self.dispose, "begin-static": self.begin_static, "recover": self.recover, "fail": self.fail}[kind]
                call(*([value or ""] if kind in ("begin-static", "recover", "fail") else []))
        except MachineError as x:
            self.s = json.loads(before)
            self.out = [{"type": "error", "reason": str(x)}]
        return self.out

    def preview(self, kind: str, value: str | None = None, ready: bool | None = True) -> list[dict]:
        """What ``apply`` would give, without a change of state."""
        kept = json.dumps(self.s)
        found = self.apply(kind, value, ready)
        self.s = json.loads(kept)
        return found


def effect_rows(key: int, seq: int, effects: list[dict]) -> Iterator[tuple]:
    for pos, e in enumerate(effects):
        yield (key, seq, pos, *[e.get(n) for n in _NAMES])


def run(inputs: DataFrame, graph: Graph) -> DataFrame:
    """Effects of ``inputs`` (key, seq, kind, value, ready), each key from a fresh state."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string()]
        names = ["key", "seq", "pos", *_NAMES]
        now, machine = None, None
        for batch in batches:
            rows: list[tuple] = []
            for key, seq, kind, value, ready in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if machine is None or key != now:
                    now, machine = key, Machine(graph)
                rows += effect_rows(key, seq, machine.apply(kind, value, ready))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    ordered = inputs.select("key", "seq", "kind", "value", "ready").repartition("key").sortWithinPartitions("key", "seq")
    return ordered.mapInArrow(work, EFFECT)
