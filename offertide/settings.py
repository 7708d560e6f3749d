"""Every tunable of the package in one frozen, validated record."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

EARLIEST = "earliest_received"
LATEST = "latest_received"

PAID_TYPES = ("bogo", "discount")
INFORMATIONAL = "informational"

SENT = "offer received"
SEEN = "offer viewed"
DONE = "offer completed"
BOUGHT = "transaction"
EVENT_KINDS = (SENT, SEEN, DONE, BOUGHT)

GRAIN = ("account_id", "offer_id", "received_time")


@dataclass(frozen=True)
class Settings:
    # data preparation
    age_sentinel: int = 118
    test_start_date: str = "20180726"
    attribution_priority: str = EARLIEST
    n_campaign_waves: int = 6
    recurrence_window_days: float = 7.0

    # description
    smd_threshold: float = 0.1
    histogram_bins: int = 40
    quantile_rel_error: float = 0.001
    outlier_iqr_multiplier: float = 1.5
    correlation_threshold: float = 0.8

    # segmentation
    cluster_k_min: int = 2
    cluster_k_max: int = 8
    cluster_restarts: int = 10
    cluster_features: tuple[str, ...] = (
        "age", "credit_card_limit", "tenure_days",
        "spend_total", "txn_count", "avg_ticket", "view_rate",
    )

    # models
    seed: int = 42
    validation_wave_cutoff: int = 4
    conversion_trees: int = 200
    conversion_depth: int = 5
    conversion_step: float = 0.05
    logit_max_iter: int = 1000
    tree_min_rows: int = 20
    effect_trees: int = 200
    effect_depth: int = 5
    effect_step: float = 0.05
    blend_mode: str = "fixed"
    blend_lambda: float = 0.3
    blend_gamma: float = 1.0
    blend_temperature: float = 0.1

    # evaluation
    gain_curve_budgets: tuple[int, ...] = (1000, 5000, 10000, 15000)
    gain_curve_n_bootstrap: int = 200
    gain_curve_confidence_level: float = 0.95
    hybrid_lambda_grid: tuple[float, ...] = (0.0, 0.1, 0.3, 0.5)
    dynamic_gamma_grid: tuple[float, ...] = (0.5, 1.0, 2.0)
    blend_lambda_scan: tuple[float, ...] = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0)
    placebo_n_permutations: int = 20
    placebo_confidence_level: float = 0.95
    quadrant_tau_epsilon: float = 0.012
    quadrant_p_convert_threshold: float = 0.5

    # serving
    predict_budget: int = 1000
    serving_default_budget: int = 1000
    serving_score_gamma: float = 1.0
    serving_temperature_default: float = 0.0
    serving_temperature_max: float = 1.0

    # physical layout
    rows_per_task: int = 5_000_000
    tree_rows_per_task: int = 200_000
    grid_rows_per_task: int = 100_000
    fits_at_once: int = 8
    """An account with more log rows than this is cut into time segments."""
    small_table_rows: int = 10_000
    """A side table is read to the driver and broadcast only up to this size."""

    def __post_init__(self) -> None:
        broken = [rule for rule in RULES if not rule[1](self)]
        if broken:
            raise ValueError("settings: " + "; ".join(what for what, _ in broken))

    def but(self, **changes) -> "Settings":
        """A copy with some values replaced (and validated again)."""
        return dataclasses.replace(self, **changes)


_COUNTS = (
            "smd_threshold", "n_campaign_waves", "recurrence_window_days",
            "histogram_bins", "outlier_iqr_multiplier", "validation_wave_cutoff",
            "conversion_trees", "effect_trees", "predict_budget", "blend_gamma",
            "gain_curve_n_bootstrap", "placebo_n_permutations",
            "quadrant_tau_epsilon", "serving_score_gamma", "rows_per_task", "tree_rows_per_task", "grid_rows_per_task",
            "fits_at_once")
_SHARES = ("gain_curve_confidence_level", "placebo_confidence_level", "quadrant_p_convert_threshold")

RULES = (
    *[(f"{name} is positive", lambda s, name=name: getattr(s, name) > 0) for name in _COUNTS],
    *[(f"{name} is a share between 0 and 1", lambda s, name=name: 0 < getattr(s, name) < 1) for name in _SHARES],
    *[(f"{name} is one of {known}", lambda s, name=name, known=known: getattr(s, name) in known)
      for name, known in (("attribution_priority", (EARLIEST, LATEST)), ("blend_mode", ("fixed", "dynamic")))],
    ("more than one number of clusters is tried", lambda s: s.cluster_k_min < s.cluster_k_max),
    ("a wave is left for validation", lambda s: s.validation_wave_cutoff < s.n_campaign_waves),
    ("blending is not negative", lambda s: min(s.blend_temperature, s.blend_lambda) >= 0),
    ("the usual temperature is within its range", lambda s: s.serving_temperature_default <= s.serving_temperature_max),
)
"""What every Settings must keep, as (rule, test)."""
