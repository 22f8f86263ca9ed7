"""Session factory with the settings that the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Cost-based join order needs statistics (ANALYZE TABLE); adaptive execution re-plans from measured sizes.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cbo.enabled": "true",
    "spark.sql.cbo.joinReorder.enabled": "true",
    "spark.sql.statistics.histogram.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "tessera", master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; on a cluster leave master unset and let spark-submit give it."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()
