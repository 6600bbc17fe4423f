"""Constants of the analysis."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values.
PEAK_HOURS = (7, 8, 9, 17, 18, 19, 20)
NIGHT_HOURS = (18, 19, 20, 21, 22, 23, 0, 1, 2, 3, 4, 5)


@dataclass(frozen=True)
class Config:
    """Fixed values; distances in metres unless named otherwise."""

    data_from: str = "2024-07-01"
    data_to: str = "2026-06-30"
    months: int = 24
    walk_radius: float = 500.0
    route_buffer: float = 40.0
    route_crossing_radius: float = 45.0
    near_hot: int = 300
    high_count: int = 15
    shown_crossings: int = 12
    sample_step: float = 20.0
    ride_kmh: float = 24.0
    route_limit: float = 30000.0
    route_alternatives: int = 1
    snap_max: float = 400.0
    fatality_weight: float = 20.0
    strata: int = 8
    walk_shrinkage_km: float = 1.0
    ride_shrinkage_km: float = 0.5
    ride_sample_m: float = 500.0
    minimum_walk_km: float = 0.8
    points_per_crossing: int = 400
    fallback_below: int = 8
    jitter: float = 25.0
    # ours: the origin of the plane, and how far an accident may lie from its crossing
    origin: tuple[float, float] = (25.0, 121.0)
    assign_max: float = 100.0
    # cells of a boundary's edges
    ring_cell: float = 100.0
    # routes of a trip that are compared, the shortest included
    route_choices: int = 3
    no_rides: tuple[str, ...] = ("motorway", "elevated")


DEFAULT = Config()
