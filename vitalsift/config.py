"""Job parameters and their defaults."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class JobConfig:
    # Defaults that results depend on.
    reference_date: date = date(2025, 1, 1)
    seed: int = 42
    row_budget: int = 100_000
    budget_tolerance: float = 1.5
    visits_per_person: int = 2
    fault_fraction: float = 0.015
    default_days_supply: int = 30
    min_days_supply: int = 1
    default_quantity: float = 1.0


DEFAULTS = JobConfig()
