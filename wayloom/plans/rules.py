"""A small rule language over road tags, compiled to column expressions.

Prefix notation in three contexts (---context:global, way, node), assignments only at the top. Numbers are 32-bit floats and
any but 0 is true. Operators: or and xor add sub multiply divide max min equal greater lesser not, switch a b c, if a then b else c.
key=v1|v2 tests a tag, key= its absence, v:key is its number; way:name reads the way's result in the node context.
`%name%` comments may name parameters; `overrides` replace the first assignment of a name. # starts a comment."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions.tags import metric
from wayloom.operators.shared import cut

_TWO = {"or", "and", "xor", "add", "sub", "multiply", "divide", "max", "min", "equal", "greater", "lesser"}


class RuleError(ValueError):
    pass


def tokenize(text: str) -> dict[str, list[str]]:
    """The tokens of each context; brackets and the = after a name are only for readers."""
    out: dict[str, list[str]] = {}
    context = None
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        m = re.fullmatch(r"---context:\s*(\w+)", line)
        if m:
            context = m[1]
            out.setdefault(context, [])
        elif line:
            if context is None:
                raise RuleError("a context must come first")
            out[context] += re.sub(r"[()\[\]]", " ", line).split()
    return out


def _float(c: Column) -> Column:
    return c.cast("float")


def _truth(c: Column) -> Column:
    return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0)).cast("float")


class _Parser:
    def __init__(self, tokens: list[str], known: dict[str, Column], readonly: set[str], tags: Column, foreign: dict[str, Column], overrides: dict[str, float]):
        self.tokens, self.at, self.known, self.readonly, self.tags, self.foreign, self.overrides = tokens, 0, known, readonly, tags, foreign, dict(overrides)

    def next(self) -> str:
        if self.at >= len(self.tokens):
            raise RuleError("the text ends inside an expression")
        self.at += 1
        return self.tokens[self.at - 1]

    def skip(self, word: str) -> bool:
        if self.at < len(self.tokens) and self.tokens[self.at] == word:
            self.at += 1
            return True
        return False

    def assignments(self) -> dict[str, Column]:
        while self.at < len(self.tokens):
            if self.next() != "assign":
                raise RuleError(f"only assign may stand at the top, not {self.tokens[self.at - 1]}")
            name = self.next()
            self.skip("=")
            if name in self.readonly:
                raise RuleError(f"{name} is global")
            value = self.expression()
            if name in self.overrides:
                value = _float(F.lit(self.overrides.pop(name)))
            self.known[name] = value
        return self.known

    def expression(self) -> Column:
        t = self.next()
        if t in _TWO:
            return self.binary(t, self.expression(), self.expression())
        if t == "not":
            return _truth(self.expression() == 0)
        if t == "switch":
            return self.choice(self.expression(), self.expression(), self.expression())
        if t == "if":
            a = self.expression()
            self.expect("then")
            b = self.expression()
            self.expect("else")
            return self.choice(a, b, self.expression())
        if t in ("true", "yes"):
            return _float(F.lit(1.0))
        if t in ("false", "no"):
            return _float(F.lit(0.0))
        if t.startswith("v:"):
            return F.coalesce(_float(metric(self.tags[t[2:]])), F.lit(float("nan")).cast("float"))
        if re.fullmatch(r"way:\w+", t):
            if t[4:] not in self.foreign:
                raise RuleError(f"no {t}")
            return self.foreign[t[4:]]
        if "=" in t:
            key, _, values = t.partition("=")
            tag = self.tags[key]
            return _truth(tag.isNull()) if not values else _truth(F.coalesce(tag.isin(*values.split("|")), F.lit(False)))
        if t in self.known:
            return self.known[t]
        try:
            return _float(F.lit(float(t)))
        except ValueError:
            raise RuleError(f"unknown name {t}") from None

    def expect(self, word: str) -> None:
        if not self.skip(word):
            raise RuleError(f"{word} expected")

    @staticmethod
    def choice(a: Column, b: Column, c: Column) -> Column:
        return F.when(a != 0, b).otherwise(c)

    @staticmethod
    def binary(t: str, a: Column, b: Column) -> Column:
        table: dict[str, Callable[[], Column]] = {
            "or": lambda: _truth((a != 0) | (b != 0)), "and": lambda: _truth((a != 0) & (b != 0)), "xor": lambda: _truth((a != 0) != (b != 0)),
            "add": lambda: _float(a + b), "sub": lambda: _float(a - b), "multiply": lambda: _float(a * b), "divide": lambda: _float(a / b),
            "max": lambda: F.greatest(a, b), "min": lambda: F.least(a, b), "equal": lambda: _truth(a == b), "greater": lambda: _truth(a > b), "lesser": lambda: _truth(a < b),
        }
        return table[t]()


def compile_rules(text: str, context: str, tags: Column, overrides: dict[str, float] | None = None, foreign: dict[str, Column] | None = None) -> dict[str, Column]:
    """Every name that the context assigns (and the globals), as columns over a map of tags. Division by zero is an error, as ANSI SQL has it."""
    parts = tokenize(text)
    overrides = overrides or {}
    globals_ = _Parser(parts.get("global", []), {}, set(), tags, {}, overrides).assignments()
    if context == "global":
        return globals_
    left = {k: v for k, v in overrides.items() if k not in globals_}
    return _Parser(parts.get(context, []), dict(globals_), set(globals_), tags, foreign or {}, left).assignments()


#: So many sets of tags at most have their values broadcast; any other set has less than one in so many of the ways.
FREQUENT = 1000


def evaluate(ways: DataFrame, text: str, outputs: list[str], overrides: dict[str, float] | None = None) -> DataFrame:
    """ways(tags map, ...) with the outputs added for both directions (`name` and `name_back`): backwards, reversedirection=yes joins the tags.

    Rules are evaluated once for each distinct set of tags, and joined back: the sets that most ways have by a broadcast, so that no task gets all ways of one set, the others by a shuffle."""
    entries = F.array_sort(F.map_entries("tags"))
    keyed = ways.withColumn("_tags", F.to_json(entries))
    distinct = keyed.groupBy("_tags").agg(F.any_value(entries).alias("_e"), F.count(F.lit(1)).alias("_n")).select("_tags", "_n", F.map_from_entries("_e").alias("tags"))
    here = compile_rules(text, "way", F.col("tags"), overrides)
    back = compile_rules(text, "way", F.map_concat(F.map_filter("tags", lambda k, v: k != "reversedirection"), F.create_map(F.lit("reversedirection"), F.lit("yes"))), overrides)
    values = cut(distinct.select("_tags", "_n", *(here[o].alias(o) for o in outputs), *(back[o].alias(f"{o}_back") for o in outputs)))
    if values.count() <= FREQUENT:
        return keyed.join(F.broadcast(values.drop("_n")), "_tags").drop("_tags")
    often = cut(values.orderBy(F.desc("_n"), "_tags").limit(FREQUENT).drop("_n"))
    seldom = keyed.join(F.broadcast(often.select("_tags")), "_tags", "left_anti").join(values.drop("_n"), "_tags")
    return keyed.join(F.broadcast(often), "_tags").unionByName(seldom).drop("_tags")


#: A profile of our own, for cars.
CAR = """
---context:global
assign avoid_unpaved = 1   # %avoid_unpaved% | unpaved roads cost more | boolean
assign speed_limit 110
---context:way
assign is_link highway=motorway_link|trunk_link|primary_link|secondary_link|tertiary_link
assign closed or access=no|private highway=path|footway|cycleway|steps|pedestrian|track
assign wrong_way if reversedirection=yes then oneway=yes else oneway=-1
assign unpaved and avoid_unpaved surface=gravel|dirt|sand|ground
assign base
  switch highway=motorway 1
  switch highway=trunk 1.05
  switch highway=primary 1.15
  switch highway=secondary 1.25
  switch highway=tertiary 1.4
  switch highway=residential 2
  switch highway=service 3
  switch is_link 1.3 10
assign costfactor
  if closed then 10000
  else if wrong_way then 10000
  else add base multiply unpaved 1.5
assign turncost = if highway=motorway then 0 else 90
assign initialclassifier switch is_link 1 2
---context:node
assign initialcost switch barrier=gate|bollard 1000000 switch highway=traffic_signals multiply 10 way:turncost 0
"""
