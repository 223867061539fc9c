"""Session defaults for local use; on a cluster the submitted configuration wins."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "tempoframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators rely on (UTC, AQE, Arrow)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master:
        settings["spark.master"] = master
        settings["spark.driver.memory"] = os.environ.get("TEMPOFRAME_DRIVER_MEMORY", "8g")
    settings.update(conf)
    session = SparkSession.builder.appName(app).config(map=settings).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
