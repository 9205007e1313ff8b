"""Place and address index: dedupe, inverted index, ranked prefix search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions.geo import haversine, lat_of, lon_of
from wayloom.functions.names import address_key, address_name, name_tokens, place_key, query_tokens

#: Candidates that a table of a region may give before the exact order, and hits that are shown.
CANDIDATES, HITS = 500, 20
ADDRESS_RANK = 12
#: The rank of a place that names none.
LEAST_RANK = 20


def dedupe_places(places: DataFrame) -> DataFrame:
    """places(id, name, kind, zoom, ...) -> one row a (name, kind): that of the smallest zoom, first seen (smallest id) among equals.

    An aggregate with partial minima, not a window, so that one very common name doesn't gather in a task."""
    rest = [c for c in places.columns if c not in ("zoom", "id")]
    best = places.withColumn("dedupe_key", place_key(F.col("name"), F.col("kind"))).groupBy("dedupe_key").agg(F.min(F.struct("zoom", "id", *rest)).alias("r"))
    return best.select("dedupe_key", "r.*")


def insert_or_ignore(stored: DataFrame, offered: DataFrame, key: str) -> DataFrame:
    """The rows of `offered` whose key isn't stored yet; stored rows are never replaced."""
    return offered.join(stored.select(key), key, "left_anti").dropDuplicates([key])


def inverted_index(rows: DataFrame, text: str = "name") -> DataFrame:
    """(id, at, token) of rows(id, text)."""
    return rows.select("id", F.posexplode(name_tokens(F.col(text))).alias("at", "token"))


def matching(index: DataFrame, query: str) -> DataFrame:
    """Ids of names that have every word of the query: whole tokens side by side, the last one of each word as a prefix."""
    words = query_tokens(query)
    if not words:
        return index.select("id").limit(0)
    wanted = [(w, k, t, k == len(ts) - 1) for w, ts in enumerate(words) for k, t in enumerate(ts)]
    parts = None
    for w, k, token, last in wanted:
        here = index.where(F.col("token").startswith(token) if last else F.col("token") == token).select("id", F.lit(w).alias("w"), (F.col("at") - k).alias("base"), F.lit(k).alias("k"))
        parts = here if parts is None else parts.union(here)
    lengths = F.create_map(*(F.lit(x) for w, ts in enumerate(words) for x in (w, len(ts))))
    whole = parts.groupBy("id", "w", "base").agg(F.count_distinct("k").alias("n")).where(F.col("n") == lengths[F.col("w")])
    return whole.groupBy("id").agg(F.count_distinct("w").alias("n")).where(F.col("n") == len(words)).select("id")


def ranked(hits: DataFrame, lon: float, lat: float, most: int = HITS) -> DataFrame:
    """hits(id, rank, ilon, ilat, ...) by rank, then by distance in whole metres, then by id."""
    metres = F.floor(haversine(F.lit(lon), F.lit(lat), lon_of(F.col("ilon")), lat_of(F.col("ilat"))) + 0.5).cast("long")
    return hits.withColumn("metres", metres).orderBy("rank", "metres", "id").limit(most)


def candidates(rows: DataFrame, query: str, lon: float, lat: float, most: int = CANDIDATES) -> DataFrame:
    """The hits of one table of one region, cut to `most` by rank and Manhattan distance in millionths of a degree."""
    found = rows.join(matching(inverted_index(rows), query), "id")
    steps = F.abs(F.col("ilon") - round((lon + 180) * 1e6)) + F.abs(F.col("ilat") - round((lat + 90) * 1e6))
    return found.withColumn("steps", steps).orderBy("rank", "steps", "id").limit(most).drop("steps")


def search_regions(tables: list[DataFrame], query: str, lon: float, lat: float) -> DataFrame:
    """Candidates of all tables, exactly ordered."""
    out = None
    for t in tables:
        some = candidates(t, query, lon, lat)
        out = some if out is None else out.unionByName(some)
    return ranked(out, lon, lat)


def addresses(rows: DataFrame) -> DataFrame:
    """rows(id, number, unit, street, ilon, ilat, ...) -> with name and dedupe_key; rows without number or street go; of one key the smallest id stays."""
    ok = rows.where("number is not null and trim(number) <> '' and street is not null and trim(street) <> ''").withColumn("unit", F.coalesce("unit", F.lit("")))
    lon, lat = lon_of(F.col("ilon")), lat_of(F.col("ilat"))
    named = ok.withColumn("name", address_name(F.col("number"), F.col("unit"), F.col("street"))).withColumn("dedupe_key", address_key(F.col("number"), F.col("unit"), F.col("street"), lon, lat))
    rest = [c for c in named.columns if c not in ("id", "dedupe_key")]
    return named.groupBy("dedupe_key").agg(F.min(F.struct("id", *rest)).alias("r")).select("dedupe_key", "r.*")


def projected_places(features: DataFrame) -> DataFrame:
    """features(layer, geom_type, props map<string,string>, ...) -> named places with name, kind, subclass and rank: points of the layers place and poi with a class and a name that isn't blank."""
    name = F.coalesce(F.col("props")["name"], F.col("props")["name:en"])
    ok = features.where(F.col("layer").isin("place", "poi") & (F.col("geom_type") == "point") & F.col("props")["class"].isNotNull() & (F.trim(name) != ""))
    rank = F.coalesce(F.col("props")["rank"].cast("int"), F.lit(LEAST_RANK))
    return ok.withColumns({"name": F.trim(name), "kind": F.col("props")["class"], "subclass": F.col("props")["subclass"], "rank": rank}).drop("props", "layer", "geom_type")
