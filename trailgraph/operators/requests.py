"""Route requests: decoding, defaults, validation, vehicles, edge penalties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import has_flag
from ..plans.profile import DEFAULT_VEHICLE, Profile
from ..schemas import FORD, FOURWD_ONLY, PAVED, ROUGH, TRAIL, VERY_ROUGH

#: The request body and the defaults of its fields.
BODY = (
    "`from` array<double>, `to` array<double>, tank_range_km float, avoid_paved boolean, avoid_fords boolean, prefer_scenic boolean, scenic_weight float, "
    "alternatives int, diversity float, max_detour float, lambda float, fuel_buffer float, vehicle string"
)
DEFAULTS = {
    "avoid_paved": (True, "boolean"), "avoid_fords": (True, "boolean"), "prefer_scenic": (True, "boolean"), "scenic_weight": (1.0, "float"), "alternatives": (1, "int"),
    "diversity": (0.35, "float"), "max_detour": (1.6, "float"), "lambda": (1.5, "float"), "fuel_buffer": (0.2, "float"), "vehicle": (DEFAULT_VEHICLE, "string"),
}
#: Penalties and the effect of scenery.
BLOCKED = 9999.0
AVOID_PAVED, AVOID_FORDS = 10.0, 20.0
SCENIC_EFFECT, SCENIC_FLOOR = 0.35, 0.65


def decode(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Requests from JSON bodies (request_id, body); absent fields get their defaults."""
    parsed = bodies.withColumn("_b", F.from_json(column, BODY))
    plain = [F.coalesce(F.col(f"_b.{name}"), F.lit(value).cast(kind)).alias(name) for name, (value, kind) in DEFAULTS.items()]
    ends = [F.try_element_at(F.col(f"_b.{end}"), F.lit(i + 1)).alias(f"{end}_{axis}") for end in ("from", "to") for i, axis in enumerate(("lat", "lon"))]
    return parsed.select("request_id", *ends, F.col("_b.tank_range_km").alias("tank_range_km"), *plain)


def validate(requests: DataFrame) -> DataFrame:
    """``requests`` with ``error``: the first rule broken, or null."""
    rules: list[tuple[Column, Column]] = []

    def text(template: str, column: str) -> Column:
        return F.concat(F.lit(template), F.col(column).cast("string"))

    for end in ("from", "to"):
        for axis, long, limit in (("lat", "latitude", 90), ("lon", "longitude", 180)):
            ok = F.col(f"{end}_{axis}").between(-limit, limit)
            rules.append((~F.coalesce(ok, F.lit(False)), F.concat(F.lit(f"{end} {long} "), F.coalesce(F.col(f"{end}_{axis}").cast("string"), F.lit("missing")), F.lit(f" is not within -{limit} and {limit}"))))
    rules.append((F.col("max_detour") <= 0, text("max_detour has to exceed 0, not ", "max_detour")))
    for name in ("diversity", "scenic_weight"):
        rules.append(((F.col(name) < 0) | (F.col(name) > 1), text(f"{name} has to be within 0 and 1, not ", name)))
    error = F.lit(None).cast("string")
    for broken, message in reversed(rules):
        error = F.when(broken, message).otherwise(error)
    return requests.withColumn("error", error)


def with_vehicle(requests: DataFrame, profile: Profile) -> DataFrame:
    """Adds the serving vehicle's name, its 4wd-only penalty and least smoothness."""
    penalty, smoothness = F.lit(None).cast("float"), F.lit(None).cast("string")
    for name, v in profile.vehicle.items():
        own = F.col("vehicle_used") == name
        penalty = F.when(own, F.lit(v.fourwd_only_penalty).cast("float")).otherwise(penalty)
        smoothness = F.when(own, F.lit(v.min_smoothness)).otherwise(smoothness)
    return requests.withColumn("vehicle_used", profile.vehicle_for(F.col("vehicle"))).withColumns({"fourwd_only_penalty": penalty, "min_smoothness": smoothness})


def scenic_multiplier(score: Column, prefer: Column, weight: Column) -> Column:
    """Below 1 for scenic edges, never below the floor."""
    lowered = F.greatest(F.lit(SCENIC_FLOOR), F.least(F.lit(1.0), F.lit(1.0) - weight * F.lit(SCENIC_EFFECT) * (score / F.lit(255.0))))
    return F.when(prefer & (score > 0), lowered).otherwise(F.lit(1.0))


def initial_penalty(flags: Column, score: Column) -> Column:
    """The penalty of an edge for a request (columns of ``with_vehicle``): the largest hard term that applies, else the scenic one.

    A hard term, even one of 1, replaces the scenic bonus.
    """

    def term(applies: Column, value: Column) -> Column:
        return F.when(applies, value.cast("double"))

    rough = ((F.col("min_smoothness") == "bad") & has_flag(flags, ROUGH)) | ((F.col("min_smoothness") == "very_bad") & has_flag(flags, VERY_ROUGH))
    return F.greatest(
        scenic_multiplier(score, F.col("prefer_scenic"), F.col("scenic_weight").cast("double")),
        term(F.col("avoid_paved") & has_flag(flags, PAVED), F.lit(AVOID_PAVED)),
        term(F.col("avoid_fords") & has_flag(flags, FORD), F.lit(AVOID_FORDS)),
        term((F.col("vehicle") != "dirtbike") & has_flag(flags, TRAIL), F.lit(BLOCKED)),
        term(has_flag(flags, FOURWD_ONLY), F.col("fourwd_only_penalty")),
        term(rough, F.lit(BLOCKED)),
    )
