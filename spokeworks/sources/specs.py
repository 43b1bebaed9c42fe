"""Declared source layouts: header contract, renaming, types and target table.

A new file layout is one more ``register(SourceSpec(...))`` call. Files are
matched to layouts by header only, in registration order.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Field:
    """One raw column: where it comes from, what it becomes."""

    header: str
    name: str
    kind: str = "string"
    required: bool = True
    layouts: tuple[str, ...] = ("iso",)


@dataclass(frozen=True)
class SourceSpec:
    name: str
    prefix: str
    table: str
    location: str
    generation: str
    fields: tuple[Field, ...]

    @property
    def required_headers(self) -> tuple[str, ...]:
        return tuple(f.header for f in self.fields if f.required)

    @property
    def columns(self) -> tuple[str, ...]:
        """Declared raw columns in order, ending with the lineage column."""
        return tuple(f.name for f in self.fields) + ("source_file",)

    def raw_schema(self) -> str:
        """Schema of the raw table: declared columns, load time, landed object."""
        declared = [f"{f.name} {f.kind}" for f in self.fields]
        return ", ".join([*declared, "ingested_at timestamp", "source_file string", "landed_id string"])


_REGISTRY: dict[str, SourceSpec] = {}


def register(spec: SourceSpec) -> SourceSpec:
    if spec.name in _REGISTRY:
        raise ValueError(f"source {spec.name!r} is registered already")
    _REGISTRY[spec.name] = spec
    return spec


def unregister(name: str) -> None:
    _REGISTRY.pop(name, None)


def registered() -> tuple[SourceSpec, ...]:
    return tuple(_REGISTRY.values())


def get(name: str) -> SourceSpec:
    return _REGISTRY[name]


def for_prefix(prefix: str) -> tuple[SourceSpec, ...]:
    """Layouts a file under this prefix may have, in the order they are tried."""
    return tuple(s for s in registered() if s.prefix == prefix)


def prefixes() -> tuple[str, ...]:
    return tuple(dict.fromkeys(s.prefix for s in registered()))


NYC_TIMES = ("iso", "month_first")

# Fixed values below: headers, column names and table names of the four layouts.

LONDON_LEGACY = register(SourceSpec(
    name="london_legacy", prefix="london_csv/", table="raw_london_legacy",
    location="london", generation="legacy",
    fields=(
        Field("Rental Id", "rental_id"),
        Field("Bike Id", "bike_id"),
        Field("Start Date", "start_date", "timestamp_ntz", layouts=("day_first_minutes",)),
        Field("End Date", "end_date", "timestamp_ntz", layouts=("day_first_minutes",)),
        Field("Duration", "duration", "bigint"),
        Field("StartStation Id", "start_station_id"),
        Field("StartStation Name", "start_station_name"),
        Field("EndStation Id", "end_station_id"),
        Field("EndStation Name", "end_station_name"),
    ),
))

LONDON_MODERN = register(SourceSpec(
    name="london_modern", prefix="london_csv/", table="raw_london_modern",
    location="london", generation="modern",
    fields=(
        Field("Number", "number"),
        Field("Bike number", "bike_number", required=False),
        Field("Bike model", "bike_model"),
        Field("Start date", "start_date", "timestamp_ntz", layouts=("iso_minutes",)),
        Field("End date", "end_date", "timestamp_ntz", layouts=("iso_minutes",)),
        Field("Total duration", "total_duration"),
        Field("Total duration (ms)", "total_duration_ms", "bigint", required=False),
        Field("Start station number", "start_station_number"),
        Field("Start station", "start_station"),
        Field("End station number", "end_station_number"),
        Field("End station", "end_station"),
    ),
))

NYC_LEGACY = register(SourceSpec(
    name="nyc_legacy", prefix="nyc_csv/", table="raw_nyc_legacy",
    location="nyc", generation="legacy",
    fields=(
        Field("tripduration", "tripduration", "bigint"),
        Field("bikeid", "bikeid"),
        Field("starttime", "starttime", "timestamp_ntz", layouts=NYC_TIMES),
        Field("stoptime", "stoptime", "timestamp_ntz", layouts=NYC_TIMES),
        Field("start station id", "start_station_id"),
        Field("start station name", "start_station_name"),
        Field("start station latitude", "start_station_latitude", "double"),
        Field("start station longitude", "start_station_longitude", "double"),
        Field("end station id", "end_station_id"),
        Field("end station name", "end_station_name"),
        Field("end station latitude", "end_station_latitude", "double"),
        Field("end station longitude", "end_station_longitude", "double"),
        Field("usertype", "usertype"),
        Field("birth year", "birth_year", "bigint"),
        Field("gender", "gender", "bigint"),
    ),
))

NYC_MODERN = register(SourceSpec(
    name="nyc_modern", prefix="nyc_csv/", table="raw_nyc_modern",
    location="nyc", generation="modern",
    fields=(
        Field("ride_id", "ride_id"),
        Field("rideable_type", "rideable_type"),
        Field("started_at", "started_at", "timestamp_ntz", layouts=NYC_TIMES),
        Field("ended_at", "ended_at", "timestamp_ntz", layouts=NYC_TIMES),
        Field("start_station_id", "start_station_id"),
        Field("start_station_name", "start_station_name"),
        Field("end_station_id", "end_station_id"),
        Field("end_station_name", "end_station_name"),
        Field("start_lat", "start_lat", "double"),
        Field("start_lng", "start_lng", "double"),
        Field("end_lat", "end_lat", "double"),
        Field("end_lng", "end_lng", "double"),
        Field("member_casual", "member_casual"),
    ),
))
