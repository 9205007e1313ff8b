"""Routes of vehicles that carry momentum: kinetic energy, slowing down at bends and junctions, time and energy spent along the way."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from functools import cached_property
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions.geo import bound, turn_angle
from wayloom.operators.path_costs import CLOSED_FACTOR, CLOSED_NODE
from wayloom.operators.routing import Unproven, in_corridors, leads_on
from wayloom.operators.shared import cut

# A speed that limits nothing, speed along a straight and where bends begin to slow down (m/s, degrees), past a residential way (m/s),
# the priority from which ways belong to the main network, seconds and speeds of changes, metres of a step of the energy, the gravity.
FREE, STRAIGHT, BEND_FROM, RESIDENTIAL, NETWORK = 999.0, 20.0, 10.0, 13.0, 20
NETWORK_SECONDS, LINK_SECONDS, STEP, GRAVITY = 10.0, 2.0, 50.0, 9.81


@dataclass(frozen=True)
class Vehicle:
    """Forces in newton, standby in watt, weight in kg, speeds in km/h, decay of bends in seconds, outside temperature in degrees."""

    roll: float = 232.0
    air: float = 0.4
    recup: float = 400.0
    standby: float = 250.0
    outside: float = 20.0
    efficiency: float = 0.7
    weight: float = 1640.0
    top: float = 80.0
    left: float = 12.0
    right: float = 12.0
    decay: float = 5.0

    @cached_property
    def balance(self) -> float:
        """The power a second is worth: at it, top speed is the cheapest speed."""
        return 2 * self.air * (self.top / 3.6) ** 3 - self.standby

    @cached_property
    def unit(self) -> float:
        """What a metre costs at the cheapest speed."""
        v = self.top / 3.6
        return (self.balance + self.standby) / v + self.roll + self.air * v * v


def braking_speed(limit: Column, car: Vehicle) -> Column:
    """Metres a second from which a limit ahead is worth rolling to: five Newton steps from 0.8 of the limit."""
    power, e = car.balance + car.standby, car.efficiency
    even = power / limit + car.air * e * limit * limit + (1 - e) * car.roll
    step = lambda v, _: v - (power / v + car.air * e * v * v - even) / (2 * e * car.air * v - power / (v * v))
    return F.aggregate(F.sequence(F.lit(1), F.lit(5)), limit * 0.8, step)


def prepared(edges: DataFrame, car: Vehicle) -> DataFrame:
    """edges(a, b, shape array<struct<x, y, h>>, cx, cy, maxspeed, minspeed, priority, and if there are: link, residential, destination, costfactor, nodecost, nodespeed)
    -> a, b, ax, ay, ah, bx, by, cx, cy, rule (numbers), sections (numbers), turns(end, angle, speed, seconds).

    What needs no path is worked out here: a way's energies, bends inside it, and for each way that goes on behind it the turn, the speed
    that the other ways of the junction leave, and the seconds it takes. A node's ways travel as one array, so its degree has to be that of a road graph."""
    have = lambda n, v: F.coalesce(F.col(n).cast("double"), F.lit(v)) if n in edges.columns else F.lit(v)
    p = lambda i: F.element_at("shape", i)
    limit = F.least(have("maxspeed", car.top), F.greatest(have("minspeed", 0.0), F.lit(car.top))) / 3.6
    open_ = (limit > 0) & (have("costfactor", 1.0) <= CLOSED_FACTOR) & (have("nodecost", 0.0) < CLOSED_NODE) & (F.size("shape") > 1)
    energy = lambda v: 0.5 * car.weight * v * v
    rule = F.array(energy(limit), bound(energy, braking_speed(limit, car)), have("destination", 0.0), F.floor(have("nodecost", 0.0)).cast("double"), energy(have("nodespeed", FREE)))
    way = lambda i, j: (p(j)["x"] - p(i)["x"], p(j)["y"] - p(i)["y"])

    def section(i: Column) -> Column:
        dx, dy = way(i, i + 1)
        bend = F.when(i > 1, turn_angle(*way(F.greatest(i - 1, F.lit(1)), i), dx, dy)).otherwise(0.0)
        return F.array(F.floor(F.sqrt(dx * dx + dy * dy)).cast("double"), bend, F.coalesce(p(i + 1)["h"].cast("double"), F.lit(float("nan"))))

    ends = [p(i)[c].cast("double").alias(n) for i, c, n in ((1, "x", "ax"), (1, "y", "ay"), (-1, "x", "bx"), (-1, "y", "by"))]
    kind = F.struct(have("priority", 0.0).alias("priority"), (have("link", 0.0) > 0).alias("link"), (have("residential", 0.0) > 0).alias("residential"))
    ways = edges.where(open_).select(
        "a", "b", *ends, F.coalesce(p(1)["h"].cast("double"), F.lit(float("nan"))).alias("ah"), "cx", "cy", rule.alias("rule"),
        F.flatten(F.transform(F.sequence(F.lit(1), F.size("shape") - 1), section)).alias("sections"),
        kind.alias("kind"), F.struct(*(d.alias(n) for n, d in zip("xy", way(F.lit(1), F.lit(2))))).alias("first"), F.struct(*(d.alias(n) for n, d in zip("xy", way(F.lit(-2), F.lit(-1))))).alias("last"),
    )
    ahead = ways.groupBy(F.col("a").alias("_n")).agg(F.collect_list(F.struct(F.col("b").alias("end"), "first", "kind")).alias("_ahead"))
    met = ways.join(ahead, F.col("b") == F.col("_n"), "left")
    bent = F.transform(
        F.filter(F.coalesce("_ahead", F.array().cast(ahead.schema["_ahead"].dataType)), lambda w: w["end"] != F.col("a")),
        lambda w: F.struct(w["end"].alias("end"), turn_angle(F.col("last.x"), F.col("last.y"), w["first"]["x"], w["first"]["y"]).alias("angle"), w["kind"].alias("kind")),
    )

    def junction(w: Column) -> Column:
        rank, like = w["kind"]["priority"], lambda o: o["kind"]["link"] == w["kind"]["link"]
        rivals = lambda o: like(o) & ((o["kind"]["priority"] > rank) | ((o["kind"]["priority"] == rank) & (rank < NETWORK)))
        from_side = lambda side: F.exists("_bent", lambda o: rivals(o) & ((o["angle"] - w["angle"]) * side > 40) & ((o["angle"] - w["angle"]) * side < 140))
        crosses = (F.col("kind.priority") < NETWORK) != (rank < NETWORK)
        speed = F.least(
            F.when(from_side(-1), car.left / 3.6).otherwise(FREE), F.when(from_side(1), car.right / 3.6).otherwise(FREE),
            F.when(F.exists("_bent", lambda o: like(o) & o["kind"]["residential"]), RESIDENTIAL).otherwise(FREE), F.when(crosses, 0.0).otherwise(FREE),
        )
        seconds = F.when(crosses, NETWORK_SECONDS).otherwise(0.0) + F.when((F.col("kind.priority") != rank) & w["kind"]["link"], LINK_SECONDS).otherwise(0.0)
        return F.struct(w["end"].alias("end"), w["angle"].alias("angle"), speed.alias("speed"), seconds.alias("seconds"))

    return met.withColumn("_bent", bent).withColumn("turns", F.transform("_bent", junction)).drop("_n", "_ahead", "_bent", "kind", "first", "last")


class State(NamedTuple):
    """Where a path stands: cost, seconds, joules spent, kinetic energy, what is left of bends to both sides, height, whether on a destination way and free to leave it."""

    cost: int = 0
    seconds: float = 0.0
    spent: float = 0.0
    moving: float = 0.0
    left: float = 0.0
    right: float = 0.0
    height: float = math.nan
    started: bool = False
    on: bool = False
    may_leave: bool = False


def rolled(moving: float, metres: float, slope: float, air: float, fastest: float, slowest: float, car: Vehicle) -> tuple[float, float, float]:
    """(kinetic energy, seconds, joules lost) after metres under one force of slope.

    The limits are energies. Between them the energy follows dE/dx = force + 2 air / weight (E - E0), solved in closed form by steps of 50 m; a step's time is that of its first force."""
    seconds = lost = 0.0
    weight, standby = car.weight, car.standby
    growth, speed = 2 * air / weight, math.sqrt(2 * moving / weight)
    while metres > 0:
        fast, slow = moving >= fastest, moving < slowest
        drag = car.roll + air * speed * speed + slope
        braked = -drag if fast else (car.recup if slow else 0.0) - slope
        if not braked > 0.0:
            braked = 0.0
        force = drag + braked
        if fast:
            x, gained, moving = metres, metres * force, fastest
            time = x / speed
        else:
            target = slowest if slow else fastest
            gained = target - moving
            x = math.log1p(gained * growth / force) / growth if growth else gained / force
            step = metres if metres < STEP else STEP
            if x >= step:
                x = step
                gained = force * math.expm1(x * growth) / growth if growth else force * x
                moving += gained
            else:
                moving = target
            reached = math.sqrt(2 * moving / weight)
            time, speed = (reached - speed) * weight / force, reached
        metres -= x
        seconds += time
        idle = x * braked * (1 - car.efficiency)
        if time * standby > idle:
            idle = time * standby
        lost += gained - x * (slope + braked * car.efficiency) - 0.5 * idle
    return moving, seconds, lost + seconds * standby


def driven(s: State, rule, sections, onto, car: Vehicle) -> State | None:
    """The state behind a way that is entered by the turn `onto` (angle, speed, seconds; None at the start); None where it may not follow. sections: (metres, bend, height) each."""
    fastest, slowest, destination, node_cost, node_energy = rule
    cost, seconds, spent, moving, left, right, height, started, on, may_leave = s
    if not started:
        may_leave = destination > 0
    elif on and not destination:
        if not may_leave:
            return None
        may_leave = False
    half, first = 0.5 * car.weight, True
    for metres, bend, h in sections:
        extra = 0.0
        if not first or onto is not None:
            speed = FREE
            if first:
                bend, speed, extra = onto
            if car.decay:
                if bend < 0:
                    left -= bend
                else:
                    right += bend
                most = right if right > left else left
                curve = 200.0 / most if most > BEND_FROM else STRAIGHT
                fades = math.exp(-metres / curve / car.decay)
                left, right = left * fades, right * fades
                if curve < STRAIGHT and curve < speed:
                    speed = curve
            most = half * speed * speed
            if most < moving:
                moving = most
        first = False
        if h != h:
            h = height
        climb = h - height
        unknown = climb != climb  # without a height
        air = car.air * (1 + (20 - car.outside) * 0.0035 - 0.0001375 * ((100.0 if h != h else h) - 100))
        time = lost = 0.0
        if metres:
            slope = (0.0 if unknown else climb) * car.weight * GRAVITY / metres
            moving, time, lost = rolled(moving, metres, slope, air, fastest, slowest, car)
            spent += lost + metres * slope
        step = (car.balance * (time + extra) + lost) / car.unit
        if step < 0:
            return None
        cost, seconds, height = cost + int(step), seconds + time + extra, h
    return State(cost + int(node_cost), seconds, spent, node_energy if node_energy < moving else moving, left, right, height, True, destination > 0, may_leave)


@dataclass(slots=True, eq=False)
class Reached:
    """A state at a node on a path: what turns lead on, and the states behind the ways on from here once they are worked out."""

    node: int
    state: State
    turns: dict
    ahead: list[Reached] | None = None


def fastest_path(out: dict, begin: Reached, goal: int, banned: set, car: Vehicle, drop: float = 100.0, air=None, coefficient: float = 0.0, limit: float = math.inf, beyond: frozenset = frozenset()):
    """(state, nodes) of a path to goal, or None. out: {node: [(end, rule, sections, {next: turn})]}.

    States on one edge that cost over `drop` more than another one there aren't followed, nor those equal to one in everything or beyond limit. What lies ahead of a state is kept with it, so a second search from begin works out only what the first one didn't."""
    if begin.node == goal:
        return State(), [goal]
    # of each edge: the least cost of a state that is followed, and all of them
    queue, seen, n = [(0, 0, begin, None)], {}, 0
    while queue:
        _, _, at, trail = heapq.heappop(queue)
        node, before = at.node, trail[0] if trail else -1
        if node == goal:
            path = [node]
            while trail:
                path.append(trail[0])
                trail = trail[1]
            return at.state, path[::-1]
        if node in beyond:
            raise Unproven
        if at.ahead is None:
            at.ahead = []
            for end, rule, sections, onward in out.get(node, ()):
                if end != before and (before, node, end) not in banned:
                    state = driven(at.state, rule, sections, at.turns.get(end), car)
                    if state is not None:
                        at.ahead.append(Reached(end, state, onward))
        trail = node, trail
        for to in at.ahead:
            new = to.state
            if new.cost > limit:
                continue
            key = node, to.node, new.on, new.may_leave
            least, others = seen.get(key, (math.inf, None))
            if others is None:
                seen[key] = new.cost, {new}
            elif new.cost > least + drop or new in others:
                continue
            else:
                others.add(new)
                if new.cost < least:
                    seen[key] = new.cost, others
            n += 1
            heapq.heappush(queue, (new.cost + (int(air(to.node) * coefficient) if air and coefficient else 0), n, to, trail))
    return None


def kinematic_routes(requests: DataFrame, edges: DataFrame, margin: int, car: Vehicle = Vehicle(), restrictions: DataFrame | None = None, drop: float = 100.0, hasty: float = 1.5) -> DataFrame:
    """requests(rid, start, goal, x1, y1, x2, y2 as cells), edges as for `prepared` -> (rid, seq, node, cost, seconds, joules), up to each node.

    Requests are searched in chunks, over the edges of their corridors of cells, which grow until the result is that of the whole graph.
    A first pass towards the goal (hasty: what a metre of air distance counts; negative: none) bounds the exact one. Goals that nothing leads to give no rows."""
    # numbers in plain arrays: an array of structs would become a dict a turn
    numbers = F.flatten(F.transform("turns", lambda t: F.array(t["angle"], t["speed"], t["seconds"])))
    ways = prepared(edges, car).select("*", F.transform("turns", lambda t: t["end"].cast("long")).alias("ends"), numbers.alias("onto")).drop("turns")
    led = cut(leads_on(ways, restrictions))

    def run(asked: list[tuple], frame: pd.DataFrame) -> pd.DataFrame:
        out, places, heights, banned, ends = {}, {}, {}, set(), set()
        threes = lambda numbers: list(zip(*[iter(numbers.tolist())] * 3))
        for a, b, ax, ay, ah, bx, by, on, rule, sections, nexts, onto, ts in zip(*(frame[k].tolist() for k in ("a", "b", "ax", "ay", "ah", "bx", "by", "on", "rule", "sections", "ends", "onto", "banned"))):
            onward = {}
            for end, turn in zip(nexts.tolist(), threes(onto)):
                onward.setdefault(end, turn)  # the first of ways to one node
            out.setdefault(a, []).append((b, rule.tolist(), threes(sections), onward))
            places[a], places[b], heights[a] = (ax, ay), (bx, by), ah
            if on:
                ends.add(b)
            if ts is not None:
                banned.update((a, b, int(t)) for t in ts)
        beyond, rows = frozenset(ends - out.keys()), []
        for rid, start, goal in asked:
            air = lambda node: math.dist(places[node], places[goal]) if node in places and goal in places else 0.0  # noqa: B023, E731
            begin = Reached(start, State(height=heights.get(start, math.nan)), {})
            try:
                first = fastest_path(out, begin, goal, banned, car, drop, air, hasty) if hasty >= 0 else None
                found = fastest_path(out, begin, goal, banned, car, drop, limit=first[0].cost if first else math.inf, beyond=beyond) or first
                if found:
                    state, turns = begin.state, {}
                    rows.append((rid, 0, start, 0, 0.0, 0.0))
                    for k, (a, b) in enumerate(zip(found[1], found[1][1:]), 1):
                        ways = [(driven(state, rule, sections, turns.get(b), car), onward) for end, rule, sections, onward in out[a] if end == b]
                        state, turns = min((w for w in ways if w[0]), key=lambda w: w[0].cost)
                        rows.append((rid, k, b, state.cost, state.seconds, state.spent))
            except Unproven:
                rows.append((rid, -1, -1, 0, 0.0, 0.0))
        return pd.DataFrame(rows, columns=["rid", "seq", "node", "cost", "seconds", "joules"])

    return in_corridors(requests, led, margin, run, "rid long, seq int, node long, cost long, seconds double, joules double", "seq")
