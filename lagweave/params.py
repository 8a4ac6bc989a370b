"""Parameters of rule mining."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MiningParams:
    """Thresholds and sizes; the defaults are the reference behaviour's."""

    # Fixed values of the reference behaviour.
    max_delay: int = 5
    future_span: int = 2
    min_support: float = 0.003
    min_concentration: float = 0.30
    max_deviation: float = 0.50
    high_support_multiplier: float = 2.0
    low_variance_multiplier: float = 0.5
    max_sigma: float = 0.45
    trials: int = 10
    generations: int = 1001
    individuals: int = 120
    start_nodes: int = 10
    judgement_nodes: int = 100
    max_depth: int = 7
    elite: int = 40
    elite_copies: int = 3
    crossover_pairs: int = 20
    crossover_points: int = 20
    mutation_one_in: int = 6
    history: int = 5
    refresh_bonus: int = 2
    max_rules_per_trial: int = 2002
    dedupe_by_delay: bool = False  # within a trial; across trials delays always count
