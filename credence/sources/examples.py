"""A small literal labelled relation (S5) for demos and unit tests.

The sentences are our own; ten sensational (label 1) and ten plain (label 0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SENSATIONAL = (
    "UNBELIEVABLE: local cat elected mayor by a landslide!",
    "WARNING: tap water turns people into frogs overnight!",
    "SECRET REVEALED: pyramids were built as giant phone chargers!",
    "SHOCK: chocolate found to cure every known disease!",
    "EXPOSED: clouds are government surveillance drones!",
    "AMAZING: teenager builds rocket from soda cans and reaches Mars!",
    "HIDDEN TRUTH: the ocean is only three metres deep!",
    "BOMBSHELL: dinosaurs still live under the city subway!",
    "MUST READ: sleeping upside down doubles your intelligence!",
    "LEAKED: scientists admit gravity is optional on weekends!",
)
PLAIN = (
    "City council publishes its annual budget report",
    "Regional train line adds two evening services",
    "University opens a new chemistry laboratory",
    "Farmers report an average harvest this autumn",
    "Museum extends opening hours during the holidays",
    "Hospital recruits additional nurses for its night shift",
    "Library starts a weekly reading club for children",
    "Road repairs planned on the northern bypass next month",
    "Local football club signs a new goalkeeper",
    "Weather service expects mild temperatures this week",
)


def example_articles(spark: SparkSession) -> DataFrame:
    """(doc_id, title, text, label_id, is_fake)."""
    rows = [(i, "", t, 1, True) for i, t in enumerate(SENSATIONAL)]
    rows += [(len(SENSATIONAL) + i, "", t, 0, False) for i, t in enumerate(PLAIN)]
    return spark.createDataFrame(rows, "doc_id bigint, title string, text string, "
                                       "label_id int, is_fake boolean")
