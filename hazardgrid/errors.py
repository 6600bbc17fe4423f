"""Errors with a code, a message and a status, and the checks of a request."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The errors of a request, in the order of the checks: name, code, status, message.
REQUEST_ERRORS = [
    ("mode", "DATA_UNAVAILABLE", 422, "invalid request (mode)"),
    ("walk_point", "DATA_UNAVAILABLE", 400, "walk needs lat and lon"),
    ("walk_outside", "OUT_OF_COVERAGE", 400, "the place is outside the boundary"),
    ("route_points", "DATA_UNAVAILABLE", 400, "route needs from and to"),
    ("route_outside", "OUT_OF_COVERAGE", 400, "start or end is outside the boundary"),
    ("start_far", "OUT_OF_COVERAGE", 400, "no road near the start"),
    ("end_far", "OUT_OF_COVERAGE", 400, "no road near the end"),
    ("same_node", "NO_ROUTE", 422, "start and end are at the same crossing"),
    ("no_path", "NO_ROUTE", 422, "no ride leads from start to end"),
]


def first_error(failing: Mapping[str, Column]) -> Column:
    """The error column of rows beside their results: struct(code, status, message) of the first of REQUEST_ERRORS
    whose condition in ``failing`` holds, null if none does. A null condition does not hold."""
    unknown = set(failing) - {name for name, *_ in REQUEST_ERRORS}
    if unknown:
        raise ValueError(f"unknown checks: {sorted(unknown)}")
    out = F.lit(None).cast("struct<code:string,status:int,message:string>")
    for name, code, status, message in reversed(REQUEST_ERRORS):
        if name in failing:
            error = F.struct(F.lit(code).alias("code"), F.lit(status).alias("status"), F.lit(message).alias("message"))
            out = F.when(failing[name], error).otherwise(out)
    return out


class AnalysisError(Exception):
    def __init__(self, code: str, message: str, status: int = 400):
        super().__init__(message)
        self.code, self.message, self.status = code, message, status

    def body(self) -> dict:
        return {"error": {"code": self.code, "message": self.message}}


def _pair(request: Mapping, name: str) -> tuple[float, float] | None:
    value = request.get(name)
    if value is None:
        return None
    if not isinstance(value, (list, tuple)) or len(value) != 2 or not all(isinstance(v, (int, float)) for v in value):
        raise AnalysisError("DATA_UNAVAILABLE", f"invalid request ({name})", 422)
    return float(value[0]), float(value[1])


def validate_request(request: Mapping) -> dict:
    """The request with defaults, or the error of its first wrong field."""
    mode = request.get("mode")
    if mode not in ("walk", "route"):
        raise AnalysisError("DATA_UNAVAILABLE", "invalid request (mode)", 422)
    if request.get("vehicle", "motorcycle") != "motorcycle":
        raise AnalysisError("DATA_UNAVAILABLE", "invalid request (vehicle)", 422)
    for name in ("lat", "lon"):
        if request.get(name) is not None and not isinstance(request[name], (int, float)):
            raise AnalysisError("DATA_UNAVAILABLE", f"invalid request ({name})", 422)
    out = {"mode": mode, "lat": request.get("lat"), "lon": request.get("lon"), "from": _pair(request, "from"), "to": _pair(request, "to"), "vehicle": "motorcycle"}
    if mode == "walk" and (out["lat"] is None or out["lon"] is None):
        raise AnalysisError("DATA_UNAVAILABLE", "walk needs lat and lon")
    if mode == "route" and (out["from"] is None or out["to"] is None):
        raise AnalysisError("DATA_UNAVAILABLE", "route needs from and to")
    return out


def validate_geocode(q: str, limit: int = 8) -> tuple[str, int]:
    if not 1 <= len(q) <= 60:
        raise AnalysisError("DATA_UNAVAILABLE", "invalid request (q)", 422)
    if not 1 <= limit <= 20:
        raise AnalysisError("DATA_UNAVAILABLE", "invalid request (limit)", 422)
    return q, limit


def validate_radius(r: float) -> float:
    if not 5 <= r <= 300:
        raise AnalysisError("DATA_UNAVAILABLE", "invalid request (r)", 422)
    return r
