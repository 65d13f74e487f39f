"""Derived inputs several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.config import ENCODERS
from orrery.operators.categories import assign_bins, class_table
from orrery.operators.ratings import contrib
from orrery.sources import views


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Records with their average rating and rating count."""
    return views.recipes(spark, folder).join(contrib(views.interactions(spark, folder)), "id", "left")


def assignments(spark: SparkSession, folder: str) -> DataFrame:
    return assign_bins(records(spark, folder), ENCODERS)


def classes(spark: SparkSession) -> DataFrame:
    return class_table(spark, {encoder.field: encoder.classes for encoder in ENCODERS})
