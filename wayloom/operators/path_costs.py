"""Routes whose cost depends on the way there: turns, buffers of height, classes of roads, destinations. Costs that don't are columns."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.operators.routing import Unproven, in_corridors, leads_on
from wayloom.operators.shared import cut

#: Rule outputs that edges may have, and their values where they are missing.
OUTPUTS = {
    "costfactor": 1.0, "uphillcostfactor": 0.0, "downhillcostfactor": 0.0, "uphillcost": 0.0, "downhillcost": 0.0, "uphillmaxslopecost": 0.0, "downhillmaxslopecost": 0.0,
    "uphillcutoff": 1.5, "downhillcutoff": 1.5, "uphillmaxslope": 1000.0, "downhillmaxslope": 1000.0, "turncost": 0.0, "initialclassifier": 0.0, "initialcost": 0.0,
    "destination": 0.0, "backbone": 0.0, "nodecost": 0.0, "areacost": 0.0,
}
#: Costs from which a way or node is closed.
CLOSED_FACTOR, CLOSED_NODE = 9998.0, 1_000_000.0
#: Numbers of a section: its length in whole metres, its direction, the height at its end (not a number if unknown).
_SECTION = 4


@dataclass(frozen=True)
class Buffers:
    """Metres of height that cost nothing yet, that are held at most, and what of the excess is paid off for each 100 m of way."""

    free: float = 5.0
    most: float = 10.0
    reduce: float = 0.0


def prepared(edges: DataFrame) -> DataFrame:
    """edges(a, b, shape array<struct<x, y, h>> from a to b in metres, cx, cy, rule outputs...) -> a, b, ax, ay, bx, by, cx, cy, rule (array of numbers), sections (array of numbers).

    What needs no path is worked out here once for each edge: lengths, directions, rates a millionth metre of height, the costs behind it
    (of its end node, of areas it runs through). Closed edges and those of fewer than two points go. Missing outputs take the values of OUTPUTS;
    areacost below 0 closes an edge."""
    given = {n: F.coalesce(F.col(n).cast("double"), F.lit(v)) if n in edges.columns else F.lit(v) for n, v in OUTPUTS.items()}
    per_height = lambda c: F.when(F.floor(c) > 0, F.floor(F.lit(1e6) / F.floor(c))).otherwise(F.lit(0)).cast("double")
    rate = {s: per_height(given[f"{s}hillcost"]) for s in ("up", "down")}
    steep = {s: F.when(F.floor(given[f"{s}hillmaxslopecost"]) > 0, per_height(given[f"{s}hillmaxslopecost"])).otherwise(rate[s]) for s in rate}
    factor = {s: F.when(given[f"{s}hillcostfactor"] != 0, given[f"{s}hillcostfactor"]).otherwise(given["costfactor"]) for s in rate}
    after = F.floor(given["areacost"]) + F.floor(given["nodecost"])
    numbers = [given["costfactor"], *factor.values(), *rate.values(), *steep.values(), *(given[f"{s}hill{k}"] * 1e4 for k in ("cutoff", "maxslope") for s in rate), *(given[k] for k in ("turncost", "initialclassifier", "initialcost", "destination", "backbone")), after]
    p = lambda i: F.element_at("shape", i)

    def section(i: Column) -> Column:
        dx, dy = p(i + 1)["x"] - p(i)["x"], p(i + 1)["y"] - p(i)["y"]
        return F.array(F.floor(F.sqrt(dx * dx + dy * dy)).cast("double"), dx.cast("double"), dy.cast("double"), F.coalesce(p(i + 1)["h"].cast("double"), F.lit(float("nan"))))

    sections = F.flatten(F.transform(F.sequence(F.lit(1), F.size("shape") - 1), section))
    open_ = (given["costfactor"] <= CLOSED_FACTOR) & (given["nodecost"] < CLOSED_NODE) & (given["areacost"] >= 0) & (F.size("shape") > 1)
    ends = [p(i)[c].cast("double").alias(n) for i, c, n in ((1, "x", "ax"), (1, "y", "ay"), (-1, "x", "bx"), (-1, "y", "by"))]
    start = F.coalesce(p(1)["h"].cast("double"), F.lit(float("nan"))).alias("ah")
    return edges.where(open_).select("a", "b", *ends, start, "cx", "cy", F.array(*(n.cast("double") for n in numbers)).alias("rule"), sections.alias("sections"))


@dataclass(slots=True)
class State:
    """Where a path stands: its cost, the direction it came in (None at the start), height, buffers in millionths, the class of its last way, whether on a destination way and free to leave it."""

    cost: int = 0
    before: tuple[float, float] | None = None
    height: float = math.nan
    down: int = 0
    up: int = 0
    kind: float = 0.0
    on: bool = False
    may_leave: bool = False
    rates: tuple[float, float] = (0.0, 0.0)


def paid(held: int, metres: float, rate: float, steep: float, slope: float, buffers: Buffers) -> tuple[int, float, float]:
    """(what is held on, share of the section that counts as slope, cost) of a buffer of height after a section."""
    free, most = int(buffers.free * 1e6), int(buffers.most * 1e6)
    if held <= free:
        return max(held, 0), 0.0, 0.0
    due = metres * int(buffers.reduce * 1e4)
    share = 1.0 if due <= held - free else (held - free) / due
    due = max(min(due, held - free), held - most)
    gentle = min(due, metres * slope)
    return int(held - due), share, (gentle / rate if rate else 0.0) + ((due - gentle) / steep if steep else 0.0)


def advanced(s: State, rule: np.ndarray, sections: np.ndarray, buffers: Buffers) -> State | None:
    """The state behind an edge, section by section; None where the edge may not follow."""
    factor, up_factor, down_factor, up_rate, down_rate, up_steep, down_steep, up_cutoff, down_cutoff, up_slope, down_slope, turn, kind, kind_cost, destination, backbone, after = rule
    cost, before, height, down, up = s.cost, s.before, s.height, s.down, s.up
    free = cost == 0 and backbone > 0
    if kind and s.kind and abs(kind - s.kind) > 0.0005:
        if kind_cost >= CLOSED_NODE:
            return None
        cost += int(kind_cost)
    may_leave = destination > 0 if s.before is None else s.may_leave
    if s.before is not None and s.on and not destination:
        if not may_leave:
            return None
        may_leave = False
    for k in range(0, len(sections), _SECTION):
        metres, dx, dy, h = sections[k : k + _SECTION]
        bend = 0.0
        if before is not None:
            size = math.hypot(*before) * math.hypot(dx, dy)
            bend = 1 - (before[0] * dx + before[1] * dy) / size if size else 0.0
        climb = 0 if math.isnan(h) or math.isnan(height) else int(1e6 * (h - height))
        down, low, pay_down = paid(int(down - climb - metres * down_cutoff), metres, down_rate, down_steep, down_slope, buffers)
        up, high, pay_up = paid(int(up + climb - metres * up_cutoff), metres, up_rate, up_steep, up_slope, buffers)
        mean = up_factor * high + factor * (1 - high - low) + down_factor * low
        if not free:
            cost += int(int(bend * turn + 0.2) + pay_down + pay_up + metres * mean + 0.5)
        before, height = (dx, dy), height if math.isnan(h) else h
    return State(cost + int(after), before, height, down, up, kind, destination > 0, may_leave, (down_rate, up_rate))


def worse(s: State, than: State) -> bool:
    """Whether s can't win against a state on the same edge, even if that one has yet to pay what its buffers hold more."""
    cost = than.cost
    for mine, its, my_rate, its_rate in ((s.down, than.down, s.rates[0], than.rates[0]), (s.up, than.up, s.rates[1], than.rates[1])):
        if its_rate:
            cost += max(0, int(its // its_rate) - (int(mine // my_rate) if my_rate else 0))
    return s.cost > cost


def cheapest(out: dict, start: int, goal: int, banned: set, air, coefficient: float, buffers: Buffers, limit: float = math.inf, least: float = 0.0, drop: bool = True, beyond: frozenset = frozenset(), count: list | None = None):
    """(state, nodes) of a path to goal, or None. out: {node: [(end, rule, sections)]}.

    The queue is keyed by cost + whole part of air distance x coefficient. Where cost + air distance x least goes beyond limit, a path isn't followed.
    With drop, states that are worse than one on the same edge (and equal in what they may do) aren't followed either; without, only equal ones aren't."""
    if start == goal:
        return State(), [start]
    queue, seen, n = [(0, 0, start, -1, State(height=air.height(start)), None)], {}, 0
    while queue:
        _, _, node, before, state, trail = heapq.heappop(queue)
        if count is not None:
            count[0] += 1
        if node == goal:
            path = [node]
            while trail:
                path.append(trail[0])
                trail = trail[1]
            return state, path[::-1]
        if node in beyond:
            raise Unproven
        for end, rule, sections in out.get(node, ()):
            if end == before or (before, node, end) in banned:
                continue
            new = advanced(state, rule, sections, buffers)
            if new is None or new.cost + air(end) * least > limit:
                continue
            others = seen.setdefault((node, end, new.on, new.may_leave), [])
            mine = (new.cost, new.down, new.up, new.height)
            if any((drop and worse(new, o)) or (o.cost <= mine[0] and (o.down, o.up, o.height) == mine[1:]) for o in others):
                continue
            others.append(new)
            n += 1
            heapq.heappush(queue, (new.cost + int(air(end) * coefficient), n, end, node, new, (node, trail)))
    return None


class _Air:
    """Air distances to a goal; nodes of unknown place are near."""

    def __init__(self, places: dict, heights: dict, goal: int):
        self.places, self.heights, self.goal = places, heights, places.get(goal)

    def __call__(self, node: int) -> float:
        at = self.places.get(node)
        return math.dist(at, self.goal) if at and self.goal else 0.0

    def height(self, node: int) -> float:
        return self.heights.get(node, math.nan)


def two_passes(out: dict, start: int, goal: int, banned: set, air: _Air, coefficients: tuple[float, float], least: float, buffers: Buffers, beyond: frozenset = frozenset(), count: list | None = None):
    """The cheapest path: a first, hasty pass finds some path, whose cost bounds the second. A negative coefficient skips its pass."""
    found, limit = None, math.inf
    if coefficients[0] >= 0:
        found = cheapest(out, start, goal, banned, air, coefficients[0], buffers, count=count)
        limit = found[0].cost if found else limit
    if coefficients[1] >= 0:
        second = cheapest(out, start, goal, banned, air, coefficients[1], buffers, limit, least, beyond=beyond, count=count)
        found = second or found
    return found


def path_routes(requests: DataFrame, edges: DataFrame, margin: int, restrictions: DataFrame | None = None, coefficients: tuple[float, float] = (1.5, 0.0), least: float = 0.0, buffers: Buffers = Buffers()) -> DataFrame:
    """requests(rid, start, goal, x1, y1, x2, y2 as cells), edges as for `prepared` -> (rid, seq, node, cost): the cheapest paths, cost up to each node.

    Requests are searched in chunks, over the edges of their corridors of cells, which grow until the result is that of the whole graph (see `in_corridors`).
    coefficients: of the two passes; the second has to be one that no edge undercuts for its length, as has least, the one the bound goes by: 0 is always right.
    restrictions(from_n, via, to_n): turns that are forbidden. Goals that no link connects to their start give no rows."""
    led = cut(leads_on(prepared(edges), restrictions))

    def run(asked: list[tuple], frame: pd.DataFrame) -> pd.DataFrame:
        out, places, heights, banned, ends = {}, {}, {}, set(), set()
        for a, b, ax, ay, ah, bx, by, on, rule, sections, ts in zip(*(frame[k].tolist() for k in ("a", "b", "ax", "ay", "ah", "bx", "by", "on", "rule", "sections", "banned"))):
            out.setdefault(a, []).append((b, rule.tolist(), sections.tolist()))
            places[a], places[b], heights[a] = (ax, ay), (bx, by), ah
            if on:
                ends.add(b)
            if ts is not None:
                banned.update((a, b, int(t)) for t in ts)
        beyond, rows = frozenset(ends - out.keys()), []
        for rid, start, goal in asked:
            try:
                found = two_passes(out, start, goal, banned, _Air(places, heights, goal), coefficients, least, buffers, beyond)
                if found:
                    # once more along the path, in detail
                    state, last = State(height=heights.get(start, math.nan)), None
                    for k, node in enumerate(found[1]):
                        if last is not None:
                            ways = [advanced(state, rule, sections, buffers) for b, rule, sections in out[last] if b == node]
                            state = min((w for w in ways if w), key=lambda w: w.cost)
                        rows.append((rid, k, node, state.cost))
                        last = node
            except Unproven:
                rows.append((rid, -1, -1, 0))
        return pd.DataFrame(rows, columns=["rid", "seq", "node", "cost"])

    return in_corridors(requests, led, margin, run, "rid long, seq int, node long, cost long", "seq")
