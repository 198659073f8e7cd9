"""Names, labels and values read from map tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres a second by road class, and where the class is unknown.
CLASS_SPEED = {"motorway": 31.0, "trunk": 27.0, "primary": 18.0, "secondary": 15.0, "tertiary": 13.0, "residential": 11.0, "living_street": 7.0, "service": 7.0, "unclassified": 11.0}
OTHER_SPEED = 11.0


def slug(name: Column, default: str = "area") -> Column:
    """Lower-case name with single hyphens for everything else."""
    out = F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when((out == "") | out.isNull(), F.lit(default)).otherwise(out)


def speed(tag: Column, road_class: Column) -> Column:
    """Metres a second of a speed tag (miles if it says so), else of the road class."""
    found = F.try_to_number(F.nullif(F.regexp_extract(tag, r"\d+(?:\.\d+)?", 0), F.lit("")), F.lit("99999.99")).cast("double")
    out = F.lit(OTHER_SPEED)
    for k, v in CLASS_SPEED.items():
        out = F.when(road_class == k, F.lit(v)).otherwise(out)
    return F.when(found.isNotNull(), found * F.when(F.lower(tag).contains("mph"), F.lit(0.44704)).otherwise(F.lit(1 / 3.6))).otherwise(out)


def node_kind(tag: Column) -> Column:
    """What a road node is, by the first name that its tag contains."""
    tag = F.coalesce(tag, F.lit(""))
    out = F.when(tag.contains("stop"), "stop_sign").when(tag.contains("signal"), "traffic_light")
    return out.when(tag.contains("crossing"), "crossing").when(tag.contains("roundabout"), "roundabout").otherwise("intersection")


def miles_an_hour(v: Column) -> Column:
    """Whole miles an hour of metres a second."""
    return F.round(v * 2.237).cast("long")


def arrow(angle: Column) -> Column:
    """Which way to point."""
    size = F.abs(angle)
    return F.when(size < 15, "ahead").when(size < 50, F.when(angle > 0, "bear right").otherwise("bear left")).otherwise(F.when(angle > 0, "right").otherwise("left"))


# How a milestone's kind is called.
SPOKEN = {"stop_sign": "stop sign", "traffic_light": "traffic light", "crossing": "crossing", "roundabout": "roundabout"}


def milestone_text(kind: Column, road: Column) -> Column:
    """What is said when a milestone comes near."""
    word = F.lit("the intersection")
    for k, v in SPOKEN.items():
        word = F.when(kind == k, F.lit(v)).otherwise(word)
    on = F.when(F.coalesce(road, F.lit("")).isin("", "unnamed road"), F.lit("")).otherwise(F.concat(F.lit(" on "), road))
    return F.when(kind == "destination", F.lit("Approaching your destination")).otherwise(F.concat(F.lit("Approaching "), word, on))


def limit_text(limit: Column) -> Column:
    """A speed limit in miles an hour, a dash where there is none."""
    return F.when(limit > 0, F.concat(miles_an_hour(limit).cast("string"), F.lit(" mph"))).otherwise("—")


def tenths(value: Column) -> Column:
    """A number that is not negative with one decimal, rounded by its exact binary value, ties to the even tenth."""
    low = F.floor(value * 10)
    # Twenty times the value, less what halfway is: exact, as either half of the value has few bits.
    head = value.cast("float").cast("double")
    over = (head * 20 - (2 * low + 1)) + (value - head) * 20
    n = F.when(over > 0, low + 1).when(over < 0, low).otherwise(low + low % 2)
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def away_text(metres: Column) -> Column:
    """A distance left, in kilometres from one on."""
    return F.when(metres >= 1000, F.concat(F.lit("~"), tenths(metres / 1000), F.lit(" km away"))).otherwise(F.concat(F.lit("~"), F.round(metres).cast("long").cast("string"), F.lit(" m away")))
