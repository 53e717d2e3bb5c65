"""Column names and types of the gold tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Names:
    """Column names an operator reads; the defaults are domain-neutral."""

    entity: str = "entity_id"
    name: str = "entity_name"
    group: str = "group_name"
    year: str = "year"
    # entity x year mart
    events: str = "event_count"
    severe: str = "severe_count"
    avg_damage: str = "avg_damage"
    declarations: str = "declaration_count"
    damage: str = "total_damage"
    loss: str = "loss_score"
    risk: str = "risk_score"
    vulnerability: str = "vulnerability_score"
    resilience: str = "resilience_score"
    # entity x category x year events
    category: str = "category"
    event_count: str = "event_count"
    event_severe: str = "severe_count"
    event_minor: str = "minor_count"
    event_avg_damage: str = "avg_damage"


# County data: FIPS-keyed mart with NOAA, FEMA, NRI and census columns.
COUNTY = Names(
    entity="county_fips",
    name="county_name",
    group="state",
    events="noaa_event_count",
    severe="noaa_total_fatalities",
    avg_damage="noaa_avg_property_damage",
    declarations="fema_declaration_count",
    damage="fema_total_damage",
    loss="nri_eal_score",
    risk="nri_risk_score",
    vulnerability="nri_sovi_score",
    resilience="nri_resl_score",
    category="hazard_type",
    event_severe="total_fatalities",
    event_minor="total_injuries",
    event_avg_damage="avg_property_damage",
)


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

# FIPS codes are strings: "01001" keeps its zero.
COUNTY_DIM = _struct(county_fips=_S, county_name=_S, state=_S)

COUNTY_MART = _struct(
    county_fips=_S,
    year=_I,
    noaa_event_count=_L,
    noaa_total_fatalities=_L,
    noaa_avg_property_damage=_D,
    fema_declaration_count=_L,
    fema_total_damage=_D,
    fema_valid_registrations=_L,
    fema_total_approved_ihp_amount=_D,
    fema_repair_replace_amount=_D,
    fema_rental_amount=_D,
    fema_other_needs_amount=_D,
    fema_total_inspected=_L,
    nri_eal_score=_D,
    nri_risk_score=_D,
    nri_sovi_score=_D,
    nri_resl_score=_D,
    population_total=_D,
    median_household_income=_D,
    median_home_value=_D,
    in_labor_force=_D,
    unemployed=_D,
    education_universe_total=_D,
    high_school_grad=_D,
    bachelors=_D,
    graduate_degree=_D,
)

COUNTY_EVENTS = _struct(
    county_fips=_S,
    hazard_type=_S,
    year=_I,
    event_count=_L,
    total_fatalities=_L,
    total_injuries=_L,
    avg_property_damage=_D,
)


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns become model features, and how."""

    numeric: tuple[str, ...]
    log: tuple[str, ...] = ()
    lag: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    lags: tuple[int, ...] = (1, 2, 3)
    key: str = "entity_id"
    order: str = "year"
    drop: tuple[str, ...] = ("entity_name", "geometry")
    passthrough: tuple[str, ...] = field(
        default=("entity_id", "year", "risk_bucket", "damage_bucket", "total_damage")
    )


# Event frequencies, casualties, demography and geography.  Money totals stay out: the
# target is cut from money totals of the same events.
COUNTY_FEATURES = FeatureSpec(
    numeric=(
        "noaa_event_count", "noaa_total_fatalities", "noaa_total_injuries",
        "flood_events", "wind_events", "tornado_events", "hail_events", "lightning_events",
        "debris_flow_events", "wildfire_events", "heat_events", "tropical_events",
        "winter_events", "population_total", "median_household_income", "median_home_value",
        "in_labor_force", "unemployed", "high_school_grad", "bachelors", "graduate_degree",
        "unemployment_rate", "bachelors_rate", "events_per_capita",
    ),
    log=("median_household_income",),
    categorical=("state",),
    key="county_fips",
    drop=("county_name", "state_name", "geometry"),
    passthrough=("county_fips", "year", "risk_bucket", "damage_bucket", "fema_total_damage"),
)


def require_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in order, cast to its types; a missing one is an error."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select([df[f.name].cast(f.dataType).alias(f.name) for f in schema])
