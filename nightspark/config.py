"""Constants and parameter sets.

Every operator takes its thresholds as arguments; the defaults live here.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# --- fixed values: they must equal the published ones for results to match ---
SPO2_MIN_VALID = 55
HR_MIN_VALID = 30
HR_MAX_VALID = 200
COVERAGE_MIN = 0.90
MAX_GAP_S = 1800
DURATION_ABORTED_S = 3600
DURATION_MIN_S = 10800
RECOVERY_FRACTION = 0.90
MIN_DROP_PCT = 2.0
DROP_THRESHOLDS_PCT = (2, 3, 4, 5)
T_UNDER_THRESHOLDS = (90, 88, 85)
IRD_WEIGHTS = {"spo2": 0.5, "hr": 0.3, "mov": 0.2}
CURVE_POINTS = 30
DIFF_REL_FLAG = 0.20
STAGE_NAMES = {0: "wake", 1: "light_sleep", 2: "light_sleep", 3: "deep_sleep"}
SLEEP_CATEGORIES = ("wake", "light_sleep", "deep_sleep")
GREEK = ("α", "β", "γ", "δ", "ε", "ζ", "η", "θ", "ι", "κ")
GREEK_NAMES = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta"}
CURVE_LABELS = ("C1", "C2", "C3", "C4", "C5")
STATE_PREFIX = {"s": "S", "m": "M", "l": "L"}
STATE_K = {"s": 7, "m": 5, "l": 4}
GOLD_STATE_LABELS = {
    "s": tuple(f"S{i}" for i in range(6)),
    "m": tuple(f"M{i}" for i in range(8)),
    "l": tuple(f"L{i}" for i in range(6)),
}
EVENT_FEATURES = (
    "duration_s", "drop_pct", "nadir_spo2", "slope_desat_pct_s", "slope_recov_pct_s",
    "auc_spo2_pct_s", "ird_event", "ird_spo2_comp", "ird_hr_comp", "ird_mov_comp",
)
WINDOW_FEATURES = (
    "spo2_mean", "spo2_std", "spo2_min", "spo2_max", "spo2_p10", "spo2_p90",
    "hr_mean", "hr_std", "hr_min", "hr_max", "hr_p10", "hr_p90",
    "mov_mean", "mov_std", "mov_max",
    "n_edos_total", "n_alpha", "n_beta", "n_gamma", "n_delta", "ird_mean_local",
    "frac_wake", "frac_light_sleep", "frac_deep_sleep",
)
VALIDATED_INDICES = (
    "odi_3", "odi_4", "ahi_3", "ahi_4", "t90_frac", "hypoxic_burden_3",
    "hypoxic_burden_4", "tst_s", "sleep_efficiency", "waso_s",
)

@dataclass(frozen=True)
class Params:
    """Thresholds that depend on the length of a recording."""

    baseline_rows: int = 120
    baseline_min_rows: int = 30
    min_event_s: float = 10.0
    context_rows: int = 60
    window_rows: dict = field(default_factory=lambda: {"s": 30, "m": 300, "l": 1800})
    tail_coverage_min: float = 0.5
    gap_s: float = 30.0
    near_gap_s: int = 300
    sustained_rows: int = 10
    movement_rows: int = 2
    high_tst_s: float = 4 * 3600.0
    min_strict_nights: int = 10
    baseline_min_nights: int = 3
    horizons_s: tuple = (120, 300, 600, 900)
    duration_aborted_s: float = DURATION_ABORTED_S
    duration_min_s: float = DURATION_MIN_S
    max_gap_s: float = MAX_GAP_S
    coverage_min: float = COVERAGE_MIN
    curve_max_s: float = 180.0
    cycle_min_s: int = 300
    lookback_s: int = 120
    lookback_min_rows: int = 60
    lookback_tail_rows: int = 30
    match_s: int = 30
    negative_ratio: int = 4
    recent_s: int = 300
    recent_long_s: int = 600
    rolling_events: int = 30
# --- end of fixed values ---


@dataclass(frozen=True)
class Layout:
    """How a dense row number cuts a record into bounded pieces.

    ``chunk_rows`` is a multiple of the longest feature window (1800 rows), so
    windows never straddle chunks.  ``fanout`` chunks make one block; a scan
    carries chunk totals inside a block and block totals inside a record, so
    no task ever holds more than ``max(chunk_rows, fanout, blocks)`` rows of
    one record, however long the record is.
    """

    key: str = "night_record_id"
    seq: str = "seq"
    chunk_rows: int = 7200
    fanout: int = 4096
    max_seq: int | None = None  # largest row number, when it has been measured

    def over(self, key: str | None = None, seq: str | None = None) -> Layout:
        """The same cuts for another key or another row number of the record."""
        return replace(self, key=key or self.key, seq=seq or self.seq)

    def sized(self, df) -> Layout:
        """With the longest record measured (one aggregate), so that scans use
        only the levels it needs."""
        from pyspark.sql import functions as F

        return replace(self, max_seq=df.agg(F.max(self.seq)).first()[0] or 0)

    @property
    def levels(self) -> list[int]:
        """Cell sizes of a scan: none when every record fits in one chunk."""
        if self.max_seq is None or self.max_seq >= self.chunk_rows * self.fanout:
            return [self.chunk_rows, self.fanout]
        return [] if self.max_seq < self.chunk_rows else [self.chunk_rows]
