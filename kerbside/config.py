"""Defaults of the operators; every operator takes its own section and honours it."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace

CLASSES = ("CAR", "LGV", "HGV", "BUS", "TRUCK", "MOTORCYCLE", "PEDESTRIAN", "UNKNOWN")
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


@dataclass(frozen=True)
class Motion:
    max_speed_mps: float = 60.0
    max_accel_mps2: float = 15.0
    min_dt_s: float = 1e-4


@dataclass(frozen=True)
class Quality:
    min_length: int = 10
    max_speed_kmh: float = 200.0
    max_mean_jerk: float = 30.0
    short_length: int = 15
    dwell_speed_kmh: float = 3.0
    min_score: float = 0.40


@dataclass(frozen=True)
class Conflict:
    radius_m: float = 25.0
    collision_radius_m: float = 3.0
    horizon_s: float = 10.0
    near_m: float = 3.5
    near_speed_mps: float = 2.0
    ttc_critical_s: float = 1.5
    ttc_medium_s: float = 2.5
    pet_critical_s: float = 1.0
    pet_medium_s: float = 2.0
    drac_critical: float = 4.0
    drac_medium: float = 2.5


@dataclass(frozen=True)
class Events:
    brake_mps2: float = -4.5
    accel_mps2: float = 3.5
    dwell_s: float = 5.0
    wrong_way_deg: float = 120.0
    wrong_way_share: float = 0.4
    moving_kmh: float = 10.0
    cut_in_degps: float = 25.0
    cut_in_mps: float = 8.0
    vru_m: float = 6.0
    vru_critical_m: float = 2.5


@dataclass(frozen=True)
class Queue:
    speed_kmh: float = 5.0
    gap_m: float = 8.0
    min_vehicles: int = 2


@dataclass(frozen=True)
class Tracker:
    high: float = 0.50
    low: float = 0.15
    new: float = 0.60
    match: float = 0.80
    second: float = 0.50
    unconfirmed: float = 0.70
    buffer: int = 60
    proximity: float = 0.50
    ema: float = 0.90


@dataclass(frozen=True)
class Config:
    motion: Motion = field(default_factory=Motion)
    quality: Quality = field(default_factory=Quality)
    conflict: Conflict = field(default_factory=Conflict)
    events: Events = field(default_factory=Events)
    queue: Queue = field(default_factory=Queue)
    tracker: Tracker = field(default_factory=Tracker)
    flow_bin_s: float = 60.0
    min_track_length: int = 10
    smoothing: str = "kalman"
    metres_per_pixel: float = 0.05


def merge(base: dict, over: dict) -> dict:
    """A deep merge of nested mappings: the right side wins, lists are replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def from_dict(values: dict, base: Config | None = None) -> Config:
    """A configuration with the named values replaced; unknown names are errors."""

    def build(current, given: dict):
        known = {f.name for f in fields(current)}
        if unknown := set(given) - known:
            raise KeyError(f"unknown settings: {sorted(unknown)}")
        return replace(current, **{k: build(getattr(current, k), v) if is_dataclass(getattr(current, k)) else v for k, v in given.items()})

    return build(base or Config(), values)


def load(path: str, overrides: dict | None = None) -> Config:
    """Read a YAML file; ``include: {section: file}`` merges further files, found beside it."""
    import os

    import yaml

    with open(path, encoding="utf-8") as f:
        values = yaml.safe_load(f) or {}
    for section, name in (values.pop("include", None) or {}).items():
        with open(os.path.join(os.path.dirname(os.path.abspath(path)), name), encoding="utf-8") as f:
            own = yaml.safe_load(f) or {}
        values = merge(values, {section: own.get(section, own)})
    return from_dict(merge(values, overrides or {}))


def to_dict(config: Config) -> dict:
    return asdict(config)
