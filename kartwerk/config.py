"""Thresholds and weights in one frozen object."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    """Live settings; values are folded into plans as literals."""

    # canonical card
    width: int = 1000
    height: int = 630
    aspect: float = 1.587
    aspect_tolerance: float = 0.3
    min_area_fraction: float = 0.05
    min_corner_distance: float = 50.0
    # detection
    detection_max_dim: int = 1280
    canny_low: int = 50
    canny_high: int = 150
    min_contour_area: float = 10000.0
    min_rectangularity: float = 0.6
    min_convexity: float = 0.75
    area_weight: float = 0.25
    aspect_weight: float = 0.20
    rectangularity_weight: float = 0.25
    convexity_weight: float = 0.15
    edge_weight: float = 0.15
    # rectification
    area_coverage: float = 0.8
    rectified: float = 0.5
    rectification_floor: float = 0.3
    # localization: normalised regions, expansion and contraction of boxes
    regions: tuple = field(
        default=(
            ("nid", 0.02, 0.08, 0.98, 0.22, "digits", 4.0),
            ("name", 0.02, 0.24, 0.98, 0.42, "text_lines", 3.0),
            ("dob", 0.02, 0.44, 0.48, 0.56, "short_digits", 2.0),
            ("gender", 0.52, 0.44, 0.98, 0.56, "compact", 1.5),
            ("governorate", 0.02, 0.58, 0.48, 0.72, "text", 2.0),
            ("address", 0.02, 0.74, 0.98, 0.92, "large_block", 3.5),
        )
    )
    expansion: int = 5
    expansions: int = 4
    contraction: int = 3
    contractions: int = 3
    localized: float = 0.5
    alternatives_below: float = 0.6
    max_alternatives: int = 3
    # image quality
    sharpness: float = 50.0
    brightness_low: float = 30.0
    brightness_high: float = 220.0
    contrast: float = 20.0
    debug: bool = False
    log_level: str = "INFO"


_current: Config | None = None


def get_config() -> Config:
    """The current settings; KARTWERK_DEBUG and KARTWERK_LOG_LEVEL are read from the environment the first time."""
    global _current
    if _current is None:
        _current = Config(debug=os.environ.get("KARTWERK_DEBUG", "").lower() in ("true", "1", "yes"), log_level=os.environ.get("KARTWERK_LOG_LEVEL", "INFO"))
    return _current


def set_config(config: Config) -> None:
    global _current
    _current = config


def reset_config() -> None:
    global _current
    _current = None
