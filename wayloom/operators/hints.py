"""Hints of a route: which junctions need one, roundabouts and their exits, turns close together, and the command of each turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.operators.shared import by_groups

#: Where no other way lies to the left or right of the one taken.
NO_LEFT, NO_RIGHT = -181.0, 181.0

# Fixed values. Angles (without their side) from which a turn is slight or a keep, slight, a turn, sharp, a U-turn.
BANDS = (5.0, 21.0, 45.0, 135.0, 159.0)
# In a band: at least or at most so large an angle, the next way on the near side (towards straight on and beyond) and on the far side, as angles to the side of the turn -> what it is. The first that fits counts.
_TURNS = {
    1: [(dict(near=(-45, None), far=(100, None)), "slight"), (dict(near=(-45, None)), "keep"), (dict(near=(None, -55), far=(None, 35)), "keep away"), ({}, "straight")],
    2: [({}, "slight")],
    3: [(dict(angle=(95, None), near=(30, None), far=(180, None)), "sharp"), (dict(angle=(None, 85), near=(None, 10), far=(None, 180)), "slight"), (dict(angle=(110, None)), "sharp"), (dict(angle=(None, 60)), "slight"), ({}, "turn")],
    4: [({}, "sharp")],
    5: [({}, "back")],
}
_NAMES = {"slight": ("TSLL", "TSLR"), "keep": ("KL", "KR"), "keep away": ("KR", "KL"), "straight": ("C", "C"), "turn": ("TL", "TR"), "sharp": ("TSHL", "TSHR"), "back": ("TLU", "TRU")}


def turn_command(angle: Column, lower: Column, higher: Column, was: Column | None = None) -> Column:
    """The command of a turn by its angle (right is positive) and the nearest other ways to its left and right (NO_LEFT, NO_RIGHT: none).

    Left turns are read as right turns in a mirror. was: a command found before; keeping right isn't made a slight left by it."""
    left = angle < 0
    size = F.abs(angle)
    near, far = F.when(left, -higher).otherwise(lower), F.when(left, -lower).otherwise(higher)
    side = {k: F.when(left, names[0]).otherwise(names[1]) for k, names in _NAMES.items()}
    # a limit itself belongs to the lesser turn on the left, to the greater one on the right
    band = sum((F.when(left, size > t).otherwise(size >= t).cast("int") for t in BANDS), F.lit(0))
    out = F.when((size >= 179) & (size <= 180) & (lower == NO_LEFT) & (higher == NO_RIGHT), "TU")
    if was is not None:
        out = out.when((band == 2) & left & (was == "KR"), "KR")
    out = out.when((band == 0) & (lower > -30), "KR").when((band == 0) & (higher < 30), "KL").when(band == 0, "C")
    for number, turns in _TURNS.items():
        for limits, name in turns:
            fits = band == number
            for c, (least, most) in ((c, limits[k]) for k, c in (("angle", size), ("near", near), ("far", far)) if k in limits):
                fits = fits if least is None else fits & (c > least)
                fits = fits if most is None else fits & (c < most)
            if (name, number) == ("keep", 1):
                fits = fits & (far <= 100)
            out = out.when(fits, side[name])
    return out


#: Metres within which turns are one, and within which angles of bends in a row add up to that of a turn.
NEAR, WIDE = 2.0, 10.0
_BAD = "turn double, prio int, link boolean, oneway boolean, factor double, car boolean"
NODES = f"route long, seq long, angle double, metres double, prio int, old_prio int, link boolean, old_link boolean, roundabout boolean, give_way boolean, beeline boolean, bad array<struct<{_BAD}>>"


def _neighbours(angle: Column, bad: Column) -> tuple[Column, Column]:
    open_ = F.filter(bad, lambda b: ~b["oneway"])
    turns = lambda keep: F.transform(F.filter(open_, keep), lambda b: b["turn"])
    return F.coalesce(F.array_max(turns(lambda b: b["turn"] < angle)), F.lit(NO_LEFT)), F.coalesce(F.array_min(turns(lambda b: b["turn"] > angle)), F.lit(NO_RIGHT))


def junctions(nodes: DataFrame, on_foot: bool = False) -> DataFrame:
    """nodes (see NODES: a row for each node of a route; bad: the ways that aren't taken there) with lower, higher, hint (whether there is one), real (whether it needs a real turn), command and worst (highest class of a way not taken).

    A node gets a hint where another way is of a class that misleads, lies straighter or could be mistaken, or where one has to give way; otherwise
    where another way is at least of the lesser class of the route's two ways, and then only with a real turn. No UDF: one window for the node before."""
    bad, angle, old, new = F.coalesce("bad", F.array().cast(f"array<struct<{_BAD.replace(' ', ':').replace(',:', ',')}>>")), F.col("angle"), F.col("old_prio"), F.col("prio")
    least = F.least(old, new)
    some = F.size(bad) > 0
    behind = lambda b: F.abs(b["turn"]) - F.abs(angle) > 80
    real = F.filter(bad, lambda b: (b["prio"] >= least) & ~b["oneway"] & ~behind(b))

    def straighter(held: Column, b: Column) -> Column:
        """The least angle of a way that cars can well take; the route's own once a way comes first that is no candidate."""
        held = F.when((b["factor"] < 20) & (F.abs(b["turn"]) < held), F.abs(b["turn"])).otherwise(held)
        return F.when((b["prio"] >= least) & (b["oneway"] | behind(b)) & (held == 180.0), F.abs(angle)).otherwise(held)

    straightest = F.aggregate(bad, F.lit(180.0), straighter)
    most = lambda ways, name, none: F.coalesce(F.array_max(F.transform(ways, lambda b: b[name])), F.lit(none))
    # links off a road that is none don't count as better ways
    above = most(F.filter(bad, lambda b: F.col("old_link") | ~b["link"]), "prio", -1)
    rival = most(real, "prio", -1)
    off, onto, links = F.col("old_link") & ~F.col("link"), ~F.col("old_link") & F.col("link"), F.exists(bad, lambda b: b["link"])
    before = F.lag("give_way").over(Window.partitionBy("route").orderBy("seq"))
    yields = F.lit(not on_foot) & some & ~(rival > new) & (F.col("give_way") | F.coalesce(before, F.lit(False)))
    always = ((F.abs(angle) > 35) & some) | ((above > least) & ~off) | (rival > new) | F.abs(angle).between(179, 180) | (~onto & links & (F.abs(angle) > 5)) | (onto & ~links & (F.abs(angle) < 5))
    always = always | ((old == new) & (straightest != 180.0) & (straightest < 35)) | yields
    lower, higher = _neighbours(angle, bad)
    command = turn_command(angle, lower, higher)
    left_most, right_most = F.array_min(F.transform(real, lambda b: b["turn"])), F.array_max(F.transform(real, lambda b: b["turn"]))
    keeps = F.when((F.abs(angle) > 5) & (left_most > angle) & (left_most < angle + 45 - F.least(angle, F.lit(0.0))), "KL")
    keeps = keeps.when((F.abs(angle) > 5) & (right_most < angle) & (right_most > angle - 45 - F.greatest(angle, F.lit(0.0))), "KR")
    made = nodes.withColumns({"bad": bad}).select("*", lower.alias("lower"), higher.alias("higher"), always.alias("_always"), (always | (rival >= least)).alias("hint"), command.alias("_command"), keeps.alias("_keeps"), F.greatest(above, rival).alias("worst"))
    return made.select(*nodes.columns, "lower", "higher", "hint", (~F.col("_always") & (F.col("_command") == "C")).alias("real"), F.coalesce("_keeps", "_command").alias("command"), "worst")


def _walked(rows: list[dict]) -> list[tuple]:
    """The hints of one route, worked out from its end to its start, as angles of bends ahead belong to the turn before them."""
    used, found, gap = set(), [], 0.0
    ring: list[int] = []  # nodes of the roundabout that the walk is in, last first
    turned, exits = 0.0, 0

    def ahead(k: int, reach: float) -> float:
        """Sum of the angles from node k on that no turn has taken yet, within reach."""
        angle = far = 0.0
        while k < len(rows) and far < reach and k not in used and not rows[k]["beeline"]:
            used.add(k)
            angle, far, k = angle + rows[k]["angle"], far + rows[k]["metres"], k + 1
        return angle

    for k in range(len(rows) - 1, -1, -1):
        row = rows[k]
        if row["beeline"]:
            found.append({"at": k, "command": "BL", "angle": 0.0, "next": 0.0, "exit": 0, "real": False, "lower": NO_LEFT, "higher": NO_RIGHT})
            continue
        if k != len(rows) - 1:
            gap += row["metres"]
        ways = [b for b in row["bad"] if not b["oneway"]]
        if row["roundabout"]:
            turned += ahead(k, NEAR)
            if not ring and len(row["bad"]):
                turned += sum(b["turn"] for b in ways) - row["angle"]  # it is left here: the ring goes on in the ways not taken
            exits += int(exits == 0 or any(b["car"] for b in ways))
            ring.append(k)
            continue
        if exits:
            inside, others = 0.0, []
            for j in range(k + 1, ring[0]):
                inside += rows[j]["angle"]
                others += [inside for b in rows[j]["bad"] if not b["oneway"]]
            used.add(k)
            lower, higher = max([a for a in others if a < turned], default=NO_LEFT), min([a for a in others if a > turned], default=NO_RIGHT)
            found.append({"at": k, "command": None, "angle": turned, "next": gap, "exit": exits if turned < 0 else -exits, "real": False, "lower": lower, "higher": higher})
            turned, exits, ring, gap = 0.0, 0, [], 0.0
            continue
        if row["hint"]:
            found.append({"at": k, "command": row["command"], "angle": ahead(k, WIDE), "next": gap, "exit": 0, "real": row["real"], "lower": row["lower"], "higher": row["higher"]})
            gap = 0.0
        if found and gap < NEAR:
            found[-1]["angle"] += ahead(k, NEAR)
    out = []
    while found:  # in the direction of travel
        hint = found.pop()
        if hint["real"] and hint["command"] == "C":
            if out:
                out[-1]["next"] += hint["next"]
            continue
        far = hint["next"]
        while hint["command"] != "BL" and far < NEAR and found:
            other = found.pop()
            far = other["next"]
            hint["next"] += far
            hint["angle"] += other["angle"]
            if other["exit"]:  # a roundabout close by is the hint
                hint = other | {"angle": hint["angle"], "next": other["next"]}
                break
        out.append(hint)
    return [(rows[0]["route"], rows[h["at"]]["seq"], h["command"], float(h["angle"]), float(h["lower"]), float(h["higher"]), h["exit"], float(h["next"])) for h in out]


def route_hints(nodes: DataFrame, on_foot: bool = False) -> DataFrame:
    """nodes as for `junctions` -> (route, seq, command, angle, exit, metres to the next hint), in all routes side by side.

    A roundabout is one hint at the node before it: the number of its exit (negative where it is driven to the right), and the angle between the ways
    to and from it. Hints within 2 m are one; bends within 10 m after a turn count as part of it. A route is walked in one task."""
    number = lambda c: F.coalesce(c, F.lit(float("nan"))).alias(c)
    told = junctions(nodes, on_foot).select("route", "seq", number("angle"), number("metres"), "roundabout", "beeline", "hint", "real", "command", number("lower"), number("higher"), F.transform("bad", lambda b: F.struct(b["turn"].alias("turn"), b["oneway"].alias("oneway"), b["car"].alias("car"))).alias("bad"))
    walked = by_groups(told, "route", ["seq"], _walked, "route long, seq long, was string, angle double, lower double, higher double, exit int, metres double")
    turn = turn_command(F.col("angle"), F.col("lower"), F.col("higher"), F.coalesce("was", F.lit("")))
    command = F.when(F.col("was") == "BL", "BL").when(F.col("exit") > 0, "RNDB").when(F.col("exit") < 0, "RNLB").otherwise(turn)
    return walked.select("route", "seq", command.alias("command"), "angle", "exit", "metres")
