"""Tunable thresholds. The defaults are the values results must reproduce."""

from dataclasses import dataclass, field


@dataclass(frozen=True)
class KineticsConfig:
    ewma_alpha: float = 0.30
    scale_edges: tuple[float, float] = (150.0, 1000.0)
    stage_edges: tuple[float, float] = (25.0, 75.0)
    min_peers: int = 5
    min_peer_std: float = 0.01
    # component -> weight of the heuristic risk score
    weights: dict[str, float] = field(default_factory=lambda: {
        "score_stalled_velocity": 0.25,
        "score_deceleration": 0.15,
        "score_burn_anomaly": 0.15,
        "score_cost_revision": 0.15,
        "score_schedule_deterioration": 0.15,
        "score_peer_underperformance": 0.15,
        "score_physical_decoupling": 0.10,
    })
    min_components: int = 2


# horizon in months -> (cost growth ratio, schedule slip in months)
HORIZONS: dict[int, tuple[float, float]] = {6: (0.05, 3.0), 12: (0.05, 6.0)}

COST_SENSITIVITY = (0.03, 0.05, 0.10)
ALERT_THRESHOLDS = (0.30, 0.40, 0.50, 0.60, 0.70)
ESCALATE, REVIEW, WATCH = 0.50, 0.45, 0.40
PERSISTENCE_CYCLES = 2
RESPONSE_DAYS = 15


@dataclass(frozen=True)
class GbdtConfig:
    """Boosted trees. Of ``trees`` trees the best prefix by validation loss is
    kept; after ``patience`` trees without a lower loss no more are looked at.

    max_categories: most values of a categorical feature that have a code of
    their own; rarer ones share the code of unseen values.
    """

    trees: int = 300
    learning_rate: float = 0.05
    max_depth: int = 6
    min_leaf: int = 50
    row_sample: float = 0.8
    column_sample: float = 0.8
    seed: int = 42
    patience: int = 30
    max_categories: int = 512


@dataclass(frozen=True)
class Fold:
    fold_id: int
    train_end: str
    val_start: str
    val_end: str
    test_start: str
    test_end: str
