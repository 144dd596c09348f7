"""Expressions over tag maps: look-ups, the way filter, edge flags, scenic kinds, forest-road attributes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import FORD, FOURWD_ONLY, PAVED, PRIVATE, ROUGH, SEASONAL, TRAIL, VERY_ROUGH

TRACK_CLASSES = ("track", "path", "bridleway", "cycleway", "footway")
TRAIL_CLASSES = ("path", "footway", "bridleway", "cycleway")
DENIED_ACCESS = ("no", "private")


def raw_tag(tags: Column, key: str) -> Column:
    """The tag as it is; null if missing."""
    return F.try_element_at(tags, F.lit(key))


def get_tag(tags: Column, key: str) -> Column:
    """The tag; an empty one counts as missing."""
    return F.nullif(raw_tag(tags, key), F.lit(""))


def tag_in(tags: Column, key: str, values) -> Column:
    """Membership; never null, and an empty tag is a value like any other."""
    return F.coalesce(raw_tag(tags, key).isin(*values), F.lit(False))


def tags_of(pairs: Column) -> Column:
    """A map of key-value structs; of a repeated key the last value stays."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]))


@dataclass(frozen=True)
class WayFilter:
    """Which ways can be routed on.  ``allowed`` are highway classes."""

    allowed: tuple[str, ...]
    skip_tracks: bool = False
    keep_private: bool = False
    motorized: bool = True

    def keep(self, tags: Column) -> Column:
        rules = tag_in(tags, "highway", [a for a in self.allowed if a])
        if self.skip_tracks:
            rules &= ~tag_in(tags, "highway", TRACK_CLASSES)
        if not self.keep_private:
            rules &= ~tag_in(tags, "access", DENIED_ACCESS)
        rules &= ~tag_in(tags, "vehicle", ("no",))
        if self.motorized:
            rules &= ~tag_in(tags, "motor_vehicle", ("no",))
        return rules


def edge_flags(tags: Column, routing) -> Column:
    """The flag bits of a way's edges."""

    def bit(condition: Column, value: int) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0))

    return (
        bit(tag_in(tags, "surface", routing.paved_surfaces), PAVED)
        + bit(tag_in(tags, "ford", ("yes",)), FORD)
        + bit(tag_in(tags, "4wd_only", ("yes",)), FOURWD_ONLY)
        + bit(tag_in(tags, "seasonal", ("yes",)), SEASONAL)
        + bit(tag_in(tags, "access", ("private",)), PRIVATE)
        + bit(tag_in(tags, "highway", TRAIL_CLASSES), TRAIL)
        + bit(tag_in(tags, "smoothness", routing.smoothness_rough), ROUGH)
        + bit(tag_in(tags, "smoothness", routing.smoothness_very_rough), VERY_ROUGH)
    )


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) == F.lit(bit)


#: Tag, value, kind, and whether the tag counts on ways alone; the first that holds decides.
SCENIC_RULES = (
    ("tourism", "viewpoint", "Viewpoint", False),
    ("natural", "peak", "Peak", False),
    ("natural", "saddle", "Saddle", False),
    ("natural", "water", "Water", False),
    ("natural", "glacier", "Glacier", False),
    ("natural", "cliff", "Cliff", False),
    ("natural", "wood", "Forest", True),
    ("waterway", "river", "River", False),
    ("waterway", "stream", "Stream", False),
    ("landuse", "forest", "Forest", True),
    ("boundary", "protected_area", "ProtectedArea", True),
    ("leisure", "nature_reserve", "NatureReserve", True),
)


def scenic_kind(tags: Column, on_way: bool) -> Column:
    """The scenic kind of a node or way, or null."""
    kind = F.lit(None).cast("string")
    for key, value, name, ways_only in reversed(SCENIC_RULES):
        if on_way or not ways_only:
            kind = F.when(F.coalesce(get_tag(tags, key) == value, F.lit(False)), F.lit(name)).otherwise(kind)
    return kind


# ------------------------------------------------------------- forest-road records

#: Surface codes of forest-road records.
SURFACE_CODES = {"asphalt": ("ASPH", "PAVE", "CONC", "BST", "CHIP", "BITU"), "gravel": ("AGG", "GRAV", "CRUS")}


def attribute(value: Column) -> Column:
    """A text attribute: trimmed, empty if missing."""
    return F.coalesce(F.trim(value), F.lit(""))


def existing(status: Column) -> Column:
    return attribute(status).startswith("EX")


def usfs_tags(oper_maint: Column, open_for_use: Column, objective: Column, surface: Column, name: Column) -> Column:
    """The tag map of a forest road: class and difficulty by maintenance level, access by use and objective."""

    def code(value: Column) -> Column:
        return F.trim(F.split(attribute(value), " - ", 2)[0])

    number = code(oper_maint).try_cast("int")
    level = F.when(number >= 0, number).otherwise(F.lit(3))
    highway = F.when(level.between(0, 3), "track").when(level == 4, "unclassified").otherwise("secondary")
    access = F.when(F.contains(attribute(objective), F.lit("DECOMMISSION")), "no").when(attribute(open_for_use) == "ADMIN", "private")
    kinds = F.lit(None).cast("string")
    for kind, codes in SURFACE_CODES.items():
        kinds = F.when(code(surface).isin(*codes), kind).otherwise(kinds)
    pairs = F.create_map(
        F.lit("highway"), highway,
        F.lit("4wd_only"), F.when(level.between(0, 2), "yes"),
        F.lit("smoothness"), F.when(level.between(0, 1), "very_bad"),
        F.lit("access"), access,
        F.lit("surface"), kinds,
        F.lit("name"), F.nullif(attribute(name), F.lit("")),
    )
    return F.map_filter(pairs, lambda k, v: v.isNotNull())
