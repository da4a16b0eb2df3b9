"""Data sources: ``survey``, ``survey_cells``, ``survey_catalog``, ``survey_grid``, ``survey_grid_headers``."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """Makes the sources known to a session, and this package to its local Python workers."""
    from surveyloom.sources import catalog, grid, survey

    share(spark)
    for source in (survey.SurveySource, survey.CellsSource, catalog.CatalogSource, grid.GridSource, grid.GridHeaderSource):
        spark.dataSource.register(source)


def share(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, if it isn't installed."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
