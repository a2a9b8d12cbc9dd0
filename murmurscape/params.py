"""Parameters of the scene engine and their registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The numerical contract of the scene engine, by the operator that uses them.
# name | value | unit | class | owner | least | most
CONTRACT = """
events: same_event_debounce_ms | 20.0 | ms | DEFAULT | WorldState | |
frames: sample_rate | 48000 | Hz | LOCKED | AudioEngine | |
frames: fast_hop | 256 | samples | LOCKED | PhysicalAnalyzer | |
frames: short_fft_size | 1024 | samples | LOCKED | PhysicalAnalyzer | |
frames: long_fft_size | 4096 | samples | LOCKED | PhysicalAnalyzer | |
frames: long_hop | 1024 | samples | DERIVED | PhysicalAnalyzer | |
layers: merge_confirmation | 3 | updates | DEFAULT | ObjectTracker | |
layers: minimum_merge_duration_ms | 30.0 | ms | DEFAULT | ObjectTracker | |
layers: split_confirmation | 3 | updates | DEFAULT | ObjectTracker | |
layers: minimum_split_duration_ms | 30.0 | ms | DEFAULT | ObjectTracker | |
lifecycle: archive_delay_ms | 2000.0 | ms | LOCKED | ObjectTracker | |
lifecycle: candidate_confirmation_window_ms | 50.0 | ms | LOCKED | ObjectTracker | |
lifecycle: confirmation_confidence | 0.70 | score | DEFAULT | ObjectTracker | 0 | 1
lifecycle: prediction_failure_threshold | 0.50 | norm.err | DEFAULT | ObjectTracker | 0 | 1
lifecycle: prediction_horizon_ms | 100.0 | ms | LOCKED | ObjectTracker | |
lifecycle: prediction_warning_threshold | 0.25 | norm.err | DEFAULT | ObjectTracker | 0 | 1
lifecycle: recovery_window_ms | 250.0 | ms | LOCKED | ObjectTracker | |
limits: hard_object_limit | 1024 | count | DEFAULT | ObjectTracker | |
limits: soft_object_limit | 256 | count | DEFAULT | ObjectTracker | |
limits: working_observation_limit | 4096 | count | DEFAULT | WorldState | |
masking: mask_attack_ms | 20.0 | ms | DEFAULT | PerceptualModel | |
masking: mask_release_ms | 150.0 | ms | DEFAULT | PerceptualModel | |
matching: candidate_match | 0.55 | score | LOCKED | ObjectTracker | 0 | 1
matching: reject_match | 0.40 | score | LOCKED | ObjectTracker | 0 | 1
matching: strong_match | 0.80 | score | LOCKED | ObjectTracker | 0 | 1
matching: w_energy | 0.15 | weight | TUNABLE | ObjectTracker | 0 | 1
matching: w_envelope | 0.15 | weight | TUNABLE | ObjectTracker | 0 | 1
matching: w_frequency | 0.25 | weight | TUNABLE | ObjectTracker | 0 | 1
matching: w_harmonic | 0.20 | weight | TUNABLE | ObjectTracker | 0 | 1
matching: w_prediction | 0.10 | weight | TUNABLE | ObjectTracker | 0 | 1
matching: w_temporal | 0.15 | weight | TUNABLE | ObjectTracker | 0 | 1
relations: strong_temporal_group_tolerance_ms | 10.0 | ms | DEFAULT | RelationshipEngine | |
relations: temporal_group_tolerance_ms | 30.0 | ms | DEFAULT | RelationshipEngine | |
"""
# Constants of single operators outside the contract.
CONSTANTS = {
    "max_band_peaks": 6,
    "floor_fall": 0.10,
    "floor_rise_db_per_s": 0.15,
    "floor_margin_db": 4.0,
    "frequency_veto": 0.15,
    "mask_threshold": 0.35,
    "co_fire_gap_ms": 100.0,
    "co_fire_rate": 0.5,
    "onset_alpha": 0.02,
    "onset_k": 3.0,
    "onset_warmup_frames": 9,
    "onset_refractory_frames": 6,
}
#: Registered names that no operator reads.
UNREAD = ("strong_match", "strong_temporal_group_tolerance_ms", "minimum_split_duration_ms", "prediction_warning_threshold")


def contract_rows() -> list[tuple]:
    """(operator, name, value, unit, class, owner, least, most) of every registered parameter."""
    out = []
    for line in CONTRACT.strip().splitlines():
        operator, rest = line.split(": ", 1)
        name, value, unit, kind, owner, least, most = (x.strip() for x in rest.split("|"))
        out.append((operator, name, float(value), unit, kind, owner, float(least) if least else None, float(most) if most else None))
    return out


class Params:
    """All parameters as attributes; ``Params(mask_attack_ms=5)`` changes single ones, within their bounds."""

    def __init__(self, **changed: float):
        bounds = {}
        for _, name, value, unit, _, _, least, most in contract_rows():
            setattr(self, name, int(value) if unit in ("Hz", "samples", "updates", "count") else value)
            bounds[name] = (least, most)
        self.__dict__ |= CONSTANTS
        for name, value in changed.items():
            least, most = bounds.get(name, (None, None))
            if name not in self.__dict__ or (least is not None and not least <= value <= most):
                raise ValueError(f"{name}={value}")
            setattr(self, name, value)
        self.hop_s = self.fast_hop / self.sample_rate


DEFAULTS = Params()


def param_registry(spark: SparkSession, params: Params = DEFAULTS) -> DataFrame:
    """name, value, unit, class, owner, operator, minimum, maximum, is_read of the registered parameters."""
    rows = [(name, float(getattr(params, name)), unit, kind, owner, operator, least, most, name not in UNREAD) for operator, name, _, unit, kind, owner, least, most in contract_rows()]
    return spark.createDataFrame(rows, "name string, value double, unit string, class string, owner string, operator string, minimum double, maximum double, is_read boolean")
