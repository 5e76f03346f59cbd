"""Run configuration."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    rows: int = 200
    cols: int = 200
    cell_size_m: float = 5.0
    temperature_c: float = 38.0
    rh: float = 10.0
    wind_speed: float = 1.0
    wind_dir: float = 45.0
    burn_steps: int = 60
    max_steps: int = 5000
    dt: float = 0.1

    def __post_init__(self) -> None:
        if self.rows < 3 or self.cols < 3:
            raise ValueError("a grid has three rows and columns at least")
