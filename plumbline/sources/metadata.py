"""The metadata contract: a JSON object, configuration rather than data."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

# The keys each mode needs and the values a key may have.
COMMON = ("velocity_units", "coordinate_crs", "vertical_positive", "reference_frame", "observation_window", "comparison_role")
LOS = ("los_sign", "incidence_definition", "heading_convention", "angle_units", "insar_product_stage")
ALLOWED = {
    "velocity_units": ("mm/year", "mm/yr"),
    "vertical_positive": ("up",),
    "comparison_role": ("internal", "independent"),
    "los_sign": ("toward_satellite", "away_from_satellite"),
    "incidence_definition": ("from_vertical",),
    "heading_convention": ("satellite_flight_heading_clockwise_from_north",),
    "angle_units": ("degrees",),
}
SIGMA_SEMANTICS = "one_standard_deviation_rate_uncertainty"
SIGMA_MODEL = "diagonal_enu_rate_covariance_zero_cross_terms"
MODES = ("los", "vlm", "cross-validate")


def check_metadata(metadata: dict[str, Any], mode: str, sigmas: bool = False) -> dict[str, Any]:
    """The metadata, or a ValueError that says what is missing or not allowed.
    ``sigmas``: the stations have sigma columns."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    wanted = (*COMMON, *(LOS if mode == "los" else ()))
    missing = sorted(set(wanted) - set(metadata))
    if missing:
        raise ValueError(f"metadata lacks {', '.join(missing)}")
    for key in wanted:
        if key in ALLOWED and metadata[key] not in ALLOWED[key]:
            raise ValueError(f"{key} must be one of {', '.join(ALLOWED[key])}, not {metadata[key]!r}")
    if sigmas and metadata.get("uncertainty_semantics") != SIGMA_SEMANTICS:
        raise ValueError(f"uncertainty_semantics must be {SIGMA_SEMANTICS}")
    if sigmas and mode == "los" and metadata.get("los_uncertainty_model") != SIGMA_MODEL:
        raise ValueError(f"los_uncertainty_model must be {SIGMA_MODEL}")
    return metadata


def load_metadata(path: str | Path, mode: str, sigmas: bool = False) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if not isinstance(data, dict):
        raise ValueError("metadata must be a JSON object")
    return check_metadata(data, mode, sigmas)
