"""Costing profiles: factor tables, vehicles and routing settings, read from TOML."""

from __future__ import annotations

import hashlib
import json
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEFAULT_VEHICLE = "high-clearance"
_DEFAULT_FILE = Path(__file__).with_name("default_profile.toml")


@dataclass(frozen=True)
class Vehicle:
    """``narrow_path_bonus`` is carried and reported; no cost uses it."""

    fourwd_only_penalty: float
    min_smoothness: str
    narrow_path_bonus: float | None = None


@dataclass(frozen=True)
class Routing:
    lambda_: float = 1.5
    fuel_buffer: float = 0.2
    grid_step: float = 0.001
    ford_penalty: float = 3.0
    paved_surfaces: tuple[str, ...] = ("asphalt", "paved", "concrete", "cobblestone", "sett")
    smoothness_rough: tuple[str, ...] = ("very_bad", "horrible", "very_horrible", "impassable")
    smoothness_very_rough: tuple[str, ...] = ("horrible", "very_horrible", "impassable")


@dataclass(frozen=True)
class Profile:
    base: dict[str, float]
    surface: dict[str, float]
    tracktype: dict[str, float]
    smoothness: dict[str, float]
    vehicle: dict[str, Vehicle]
    routing: Routing = field(default_factory=Routing)

    @property
    def allowed(self) -> tuple[str, ...]:
        """Highway classes that are loaded at all."""
        return tuple(sorted(self.base))

    def factor(self, table: str, value: Column) -> Column:
        """The FLOAT factor of a tag value; 1 if the table has none.  The table is a constant of the plan."""
        entries = sorted(getattr(self, table).items())
        if not entries:
            return F.lit(1.0).cast("float")
        literals = [x for key, number in entries for x in (F.lit(key), F.lit(float(number)).cast("float"))]
        return F.coalesce(F.try_element_at(F.create_map(*literals), value), F.lit(1.0).cast("float"))

    def vehicle_for(self, name: Column) -> Column:
        """The name of the vehicle that serves a request; an unknown one falls back."""
        return F.when(name.isin(*self.vehicle), name).otherwise(F.lit(DEFAULT_VEHICLE))

    def fingerprint(self) -> str:
        """SHA-256 of a canonical form: the same settings in any order of keys give the same value."""

        def plain(value):
            if isinstance(value, Vehicle | Routing):
                value = vars(value)
            if isinstance(value, dict):
                return {k: plain(v) for k, v in value.items()}
            return float(value) if isinstance(value, int | float) else list(value) if isinstance(value, tuple) else value

        return hashlib.sha256(json.dumps(plain(vars(self)), sort_keys=True).encode()).hexdigest()


def parse_profile(text: str) -> Profile:
    data = tomllib.loads(text)
    missing = [k for k in ("base", "surface", "tracktype", "smoothness", "vehicle") if k not in data]
    if missing:
        raise ValueError(f"profile lacks {', '.join(missing)}")
    vehicles = {name: Vehicle(float(v["fourwd_only_penalty"]), v["min_smoothness"], v.get("narrow_path_bonus")) for name, v in data["vehicle"].items()}
    settings = {("lambda_" if k == "lambda" else k): tuple(v) if isinstance(v, list) else v for k, v in data.get("routing", {}).items()}
    tables = {k: {n: float(x) for n, x in data[k].items()} for k in ("base", "surface", "tracktype", "smoothness")}
    return Profile(**tables, vehicle=vehicles, routing=Routing(**settings))


def load_profile(path: str | None = None) -> Profile:
    """A profile file (``.toml``, no parent folders in the path), or the default."""
    if path is None:
        return parse_profile(_DEFAULT_FILE.read_text())
    if not path.endswith(".toml"):
        raise ValueError(f"profile must be a .toml file: {path}")
    if ".." in Path(path).parts:
        raise ValueError(f"profile path must not contain '..': {path}")
    return parse_profile(Path(path).read_text())


def report(spark: SparkSession, profile: Profile) -> DataFrame:
    """section, key, value (and text), sorted: the factor tables and the vehicles."""
    rows = [(t, k, float(v), None) for t in ("base", "surface", "tracktype", "smoothness") for k, v in getattr(profile, t).items()]
    for name, v in profile.vehicle.items():
        rows.append(("vehicle", name, float(v.fourwd_only_penalty), v.min_smoothness))
        if v.narrow_path_bonus is not None:
            rows.append(("vehicle.narrow_path_bonus", name, float(v.narrow_path_bonus), None))
    return spark.createDataFrame(rows, "section string, key string, value double, detail string").orderBy("section", "key")


#: The tag that each factor table reads.
TABLE_TAGS = {"base": "highway", "surface": "surface", "tracktype": "tracktype", "smoothness": "smoothness"}


def usage(profile: Profile, ways: DataFrame) -> DataFrame:
    """The report with each entry's place in it (from 1) and n_ways, the ways (with tags) that carry its tag; null where an entry is no tag's."""
    rows = report(ways.sparkSession, profile)
    place = F.rank().over(Window.orderBy("section", "key"))  # as many rows as the profile has entries
    carried = F.array(*(F.struct(F.lit(t).alias("section"), F.try_element_at("tags", F.lit(tag)).alias("key")) for t, tag in TABLE_TAGS.items()))
    counts = ways.select(F.explode(carried).alias("c")).groupBy("c.section", "c.key").agg(F.count(F.lit(1)).alias("n_ways"))
    known = rows.withColumn("place", place.cast("long")).join(counts, ["section", "key"], "left")
    return known.select("place", "section", "key", "value", "detail", F.when(F.col("section").isin(*TABLE_TAGS), F.coalesce("n_ways", F.lit(0))).alias("n_ways"))
