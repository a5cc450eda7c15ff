"""Fixed values of the detection, rule and ranking operators."""

from __future__ import annotations

from dataclasses import dataclass, field

# Detector kinds in pipeline order, with the prior that scales a
# candidate's score when it enters the queue.
KINDS = ("fan_out", "fan_in", "pass_through", "velocity_burst", "cycle")
KIND_PRIOR = {
    "pass_through": 0.088,
    "fan_out": 0.028,
    "fan_in": 0.017,
    "cycle": 0.006,
    "velocity_burst": 0.003,
}
UNKNOWN_PRIOR = 0.003

# Labelled ring topologies.
PATTERN_TYPES = (
    "FAN-IN",
    "FAN-OUT",
    "GATHER-SCATTER",
    "SCATTER-GATHER",
    "CYCLE",
    "RANDOM",
    "BIPARTITE",
    "STACK",
)

# Queue depths reported by the evaluations.
PRECISION_DEPTHS = (10, 25, 50, 100, 250)
COMPARISON_DEPTHS = (10, 25, 100, 1000)


# Fixed values, as defaults.
@dataclass(frozen=True)
class DetectionParams:
    rails: tuple[str, ...] = ("ACH",)
    star_min: int = 3
    star_max: int = 30
    star_window_hours: float = 72.0
    amount_tolerance: float = 0.10
    max_lag_hours: float = 240.0
    burst_window_hours: float = 24.0
    cycle_length: int = 3
    max_ring_accounts: int = 60
    kind_prior: dict = field(default_factory=lambda: dict(KIND_PRIOR), hash=False)

    @property
    def volume_cap(self) -> int:
        return self.star_max * 2


# Fixed values, as defaults.
@dataclass(frozen=True)
class RuleLimits:
    single_amount: float = 1_000_000
    daily_volume: float = 5_000_000
    night_first_hour: int = 1
    night_last_hour: int = 4
    hourly_count: int = 10
    cross_border_amount: float = 500_000


# A true ring counts as found when one predicted ring holds this share of it.
# Fixed values of scoring and the case views.
RING_COVERAGE = 0.5
DETECTABLE_MIN_TRANSFERS = 3

# Case views.
TOP_RINGS = 25
CASE_TRANSFERS = 50
CARD_TRANSFERS = 20
CONTEXT_HOPS = 1
MAX_CONTEXT_DEGREE = 8
