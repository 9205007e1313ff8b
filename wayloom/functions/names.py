"""Names, addresses, search tokens and texts shown to people, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# State names that stay in capitals, and street types with the short form that is shown.
KEEP_UPPER = ("NSW", "VIC", "QLD", "SA", "WA", "TAS", "NT", "ACT")
STREET_TYPES = {
    "ST": "St", "STREET": "Street", "RD": "Rd", "ROAD": "Road", "AVE": "Ave", "AV": "Ave", "AVENUE": "Avenue", "DR": "Dr", "DRV": "Drv", "DRIVE": "Drive",
    "PL": "Pl", "PLACE": "Place", "CRES": "Cres", "CRESCENT": "Crescent", "PDE": "Pde", "PARADE": "Parade", "TCE": "Tce", "TERRACE": "Terrace",
    "HWY": "Hwy", "HIGHWAY": "Highway", "BLVD": "Blvd", "BOULEVARD": "Boulevard", "LN": "Ln", "LANE": "Lane", "CL": "Cl", "CLOSE": "Close",
    "ESP": "Esp", "ESPLANADE": "Esplanade", "CIR": "Cir", "CIRCUIT": "Circuit", "CT": "Ct", "COURT": "Court", "SQ": "Sq", "SQUARE": "Square",
    "GDNS": "Gdns", "GARDENS": "Gardens", "PKWY": "Pkwy", "PARKWAY": "Parkway", "WAY": "Way", "WALK": "Walk", "VIEW": "View", "HILL": "Hill", "PARK": "Park",
}


def address_word(word: Column) -> Column:
    upper = F.upper(word)
    known = F.create_map(*(F.lit(x) for pair in STREET_TYPES.items() for x in pair))
    plain = F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1_000_000)))
    return F.when(upper.isin(*KEEP_UPPER), upper).when(known[upper].isNotNull(), known[upper]).when(word.rlike(r"\d"), word).otherwise(plain)


def title_case(text: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""), address_word), " ")


def address_name(number: Column, unit: Column, street: Column) -> Column:
    head = F.when(F.trim(unit) == "", F.trim(number)).otherwise(F.concat(F.trim(unit), F.lit("/"), F.trim(number)))
    return F.concat(head, F.lit(" "), title_case(street))


def address_key(number: Column, unit: Column, street: Column, lon: Column, lat: Column) -> Column:
    cell = lambda x: F.floor(x * 1000 + 0.5).cast("long").cast("string")
    return F.concat_ws("|", F.lit("address"), cell(lon), cell(lat), F.trim(unit), F.trim(number), F.upper(F.trim(street)))


def place_key(name: Column, kind: Column) -> Column:
    return F.concat(name, F.lit("|"), kind)


def name_tokens(name: Column) -> Column:
    """What the index holds of a name: lower-cased runs of letters and digits without their accents."""
    plain = F.translate(F.lower(name), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_tokens(query: str) -> list[list[str]]:
    """A query's words; each is the tokens that must stand side by side in a name, the last one as a prefix."""
    import re

    out = []
    for word in query.split():
        word = word.replace('"', "").strip().rstrip("*").strip()
        parts = [p for p in re.split(r"[^\w]|_", word.lower()) if p]
        if parts:
            out.append(parts)
    return out


def is_address_shaped(query: Column) -> Column:
    """At least two words, one that starts with a digit and one that doesn't."""
    words = F.filter(F.transform(F.split(query, r"\s+"), lambda w: F.trim(F.rtrim(F.regexp_replace(F.trim(F.regexp_replace(w, '"', "")), r"\*+$", "")))), lambda w: w != "")
    digit = lambda w: w.rlike(r"^\d")
    return (F.size(words) >= 2) & F.exists(words, digit) & F.exists(words, lambda w: ~digit(w))


def shown_distance(metres: Column) -> Column:
    km = F.format_string("%.1f", metres / 1000.0)
    return F.when(metres < 1000, F.concat(metres.cast("string"), F.lit(" m"))).otherwise(F.concat(km, F.lit(" km")))


def shown_duration(seconds: Column) -> Column:
    minutes = F.floor((seconds + 59) / 60).cast("long")
    hours, rest = F.floor(minutes / 60).cast("long"), minutes % 60
    return F.when(hours == 0, F.concat(rest.cast("string"), F.lit(" min"))).otherwise(F.concat(hours.cast("string"), F.lit(" h "), F.lpad(rest.cast("string"), 2, "0"), F.lit(" min")))


def region_id(file_name: Column, prefix: str = "map-") -> Column:
    """A region's stable id from its file's name: without ending and prefix, lower case, other signs as single dashes."""
    stem = F.when(F.instr(file_name, ".") > 0, F.regexp_replace(file_name, r"\.[^.]*$", "")).otherwise(file_name)
    stem = F.when(stem.startswith(prefix), F.substr(stem, F.lit(len(prefix) + 1))).otherwise(stem)
    slug = F.regexp_replace(F.regexp_replace(F.lower(stem), "[^a-z0-9-]+", "-"), "-{2,}", "-")
    slug = F.regexp_replace(slug, "^-+|-+$", "")
    return F.when(slug == "", "map").otherwise(slug)


def fingerprint(kind: str, version: int, header: Column, length: Column) -> Column:
    """What tells whether an archive has changed: kind/version/, its header bytes and its length, hashed."""
    return F.sha2(F.concat(F.lit(f"{kind}/{version}/").cast("binary"), header.cast("binary"), length.cast("string").cast("binary")), 256)
