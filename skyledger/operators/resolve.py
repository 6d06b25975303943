"""Natural-key -> surrogate-key resolution of fact rows over the dimension roles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import NATURAL_KEYS
from .broadcast import broadcast_if_small


@dataclass(frozen=True)
class Role:
    fk: str            # fact column receiving the id
    table: str         # dimension table
    source: str        # staged column holding the natural key
    required: bool     # inner-join semantics (row dropped when unresolved)


# The ten roles of a flight fact row.  Only the actual departure time is optional.
FACT_ROLES = [
    Role("flight_id", "dim_flight", "flight_number", True),
    Role("airline_id", "dim_airline", "airline_code", True),
    Role("origin_airport_id", "dim_airport", "origin_airport_code", True),
    Role("destination_airport_id", "dim_airport", "destination_airport_code", True),
    Role("date_id", "dim_date", "flight_date", True),
    Role("scheduled_departure_time_id", "dim_time", "scheduled_departure_time", True),
    Role("actual_departure_time_id", "dim_time", "actual_departure_time", False),
    Role("aircraft_id", "dim_aircraft", "aircraft_type", True),
    Role("weather_condition_id", "dim_weather_condition", "weather_condition", True),
    Role("delay_cause_id", "dim_delay_cause", "delay_cause", True),
]


def resolve_keys(staged: DataFrame, dims: dict[str, DataFrame], roles=FACT_ROLES):
    """Attach every role's surrogate id with one LEFT join per role, then split.

    Returns ``(resolved, unresolved)``: resolved rows have every required id (what the inner
    joins keep); unresolved rows carry ``reason`` naming the first role that found no member.
    Dimensions under the size check are broadcast, so the fact is never shuffled for them;
    larger ones fall back to a shuffle join that AQE can still convert or skew-split.
    """
    out = staged
    small = {}
    for role in roles:
        id_col, key = NATURAL_KEYS[role.table]
        if role.table not in small:
            small[role.table] = broadcast_if_small(dims[role.table].select(id_col, key))
        dim = small[role.table].select(F.col(id_col).alias(role.fk), F.col(key).alias(f"_k_{role.fk}"))
        out = out.join(dim, out[role.source] == dim[f"_k_{role.fk}"], "left").drop(f"_k_{role.fk}")
    required = [r for r in roles if r.required]
    ok = F.lit(True)
    for r in required:
        ok = ok & F.col(r.fk).isNotNull()
    reason = F.lit(None).cast("string")
    for r in reversed(required):
        reason = F.when(F.col(r.fk).isNull(), F.lit(f"no {r.table} member for {r.source}")).otherwise(reason)
    resolved = out.where(ok)
    unresolved = out.where(~ok).withColumn("reason", reason)
    return resolved, unresolved
