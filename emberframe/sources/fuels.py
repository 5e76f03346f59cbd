"""The fuel dimension and the neighbour offsets: small fixed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Surface fuel types and their attributes.
FUELS = [
    (0, "Aleppo_Pine", 8000.0, 1500.0, 0.5, 2.5, 0.25, 0.2),
    (1, "Phrygana_Low_Scrub", 8000.0, 2500.0, 0.15, 1.5, 0.15, 0.1),
    (2, "Maquis_Dense_Shrub", 8500.0, 1800.0, 0.45, 4.0, 0.25, 0.11),
    (3, "Dry_Grass", 8000.0, 3000.0, 0.08, 1.0, 0.12, 0.08),
    (4, "Oak_Forest", 8000.0, 1200.0, 0.35, 0.5, 0.30, 0.7),
    (5, "Olive_Grove", 8000.0, 1400.0, 0.25, 1.0, 0.20, 0.25),
]
FUEL_SCHEMA = ("fuel_idx int, fuel_name string, heat_content double, surface_ratio double, fuel_load double, "
               "fuel_depth double, moisture_ext double, bulk_density double")
# Neighbour d sends fire from (r - dr, c - dc) to (r, c); sums go in this order.
OFFSETS = [(-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1)]
# Display codes (fuel index, 6 burning, 7 ash) and their colours.
COLOURS = [(0, "#d9f0a3"), (1, "#238b45"), (2, "#a1d99b"), (3, "#74c476"), (4, "#00441b"), (5, "#addd8e"), (6, "#ff4500"), (7, "#2a2a2a")]

# States (unburned, burning, ash) and their colours on the flat display.
STATE_COLOURS = [(0, "#2ca02c"), (1, "#d62728"), (2, "#1f77b4")]


def fuels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FUELS, FUEL_SCHEMA)


def offsets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d, dr, dc) for d, (dr, dc) in enumerate(OFFSETS)], "d int, dr int, dc int")
