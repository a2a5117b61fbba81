"""Parameters with the values that plans and published results were made with."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    min_depth_m: float = 0.15
    min_cells: int = 10
    top_n: int = 25
    rsi_weights: tuple[float, float, float, float] = (0.35, 0.30, 0.20, 0.15)
    amber: float = 0.5
    red: float = 1.0
    cell_m2: float = 900.0
    design_rain_mm: float = 100.0
    budget_m3: float = 150000.0
    n_sites: int = 8
    site_radius: int = 2
    max_dig_m: float = 3.0
    permanent_water: int = 50
    zone_deg: float = 0.01
    point_cap: int = 1500


DEFAULT = Params()

# Curve numbers of soil groups A to D, Manning's n and infiltration (mm/h), each by land cover class.
CURVE_NUMBERS = {
    10: (36, 60, 73, 79), 20: (45, 66, 77, 83), 30: (49, 69, 79, 84), 40: (67, 78, 85, 89),
    50: (89, 92, 94, 95), 60: (77, 86, 91, 94), 80: (98, 98, 98, 98), 90: (98, 98, 98, 98),
}
MANNING = {10: 0.060, 20: 0.050, 30: 0.040, 40: 0.040, 50: 0.015, 60: 0.030, 80: 0.030, 90: 0.045}
INFILTRATION = {10: 10.0, 20: 8.0, 30: 8.0, 40: 8.0, 50: 1.0, 60: 5.0, 80: 0.0, 90: 0.0}
UNIT_COSTS = {"excavation_per_m3": 300.0, "canal_per_m": 9000.0, "storage_per_m3": 6000.0}
