"""Parameters of the queries."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    year_start: int = 2024
    year_end: int = 2025
    hour_start: int = 6
    hour_end: int = 23
    min_amount: float = 75.0
    top: int = 3
