"""Constants of the training model: one frozen profile, every operator takes it as a parameter. Fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Profile:
    max_hr: int = 199
    resting_hr: int = 41
    zones: dict[str, tuple[int, int]] = field(default_factory=lambda: {"Z1": (100, 136), "Z2": (137, 155), "Z3": (156, 171), "Z4": (172, 183), "Z5": (184, 199)})
    ctl_days: int = 42
    atl_days: int = 7
    acute_days: int = 7
    chronic_days: int = 28
    trimp_k1: float = 0.64
    trimp_k2: float = 1.92
    dedup_window_s: int = 1800
    hr_density: float = 0.90
    integrity_diff: float = 0.25
    warmup_s: int = 600
    max_drop: float = 90
    min_start_hr: float = 110
    max_jump: float = 30
    drift_max_altitude: float = 30.0
    hrv_drop: float = 0.10
    high_rhr: float = 46
    low_sleep_score: float = 60
    short_sleep_min: float = 360
    illness_flags: int = 3
    ramp_warning: float = 8.0
    fat_share: dict[str, float] = field(default_factory=lambda: {"z1": 0.8, "z2": 0.6, "z3": 0.4, "z4": 0.1, "z5": 0.0})
    kcal_per_min: dict[str, float] = field(default_factory=lambda: {"z1": 6.0, "z2": 8.0, "z3": 10.0, "z4": 12.0, "z5": 14.0})
    durability_min: float = 120
    speed_general: float = 0.3
    speed_cycling: float = 0.833
    stop_kmh: float = 2.0
    moving_kmh: float = 3.5
    odometer_kmh: float = 6.0
    min_stop_s: int = 600
    gap_s: int = 300
    pause_gap_s: int = 900
    analysis_s: int = 900
    settle_s: int = 180
    min_confidence: float = 15.0
    cluster_m: float = 300.0
    match_m: float = 400.0


DEFAULT = Profile()
