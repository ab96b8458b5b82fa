"""The Spark session that local runs and tests use; on a cluster, pass your own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(name: str = "tallysheet", master: str | None = None, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """UTC, adaptive execution on, few shuffle partitions, overwriting only the partitions that a write touches."""
    b = SparkSession.builder.appName(name).master(master or f"local[{os.cpu_count() or 4}]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once for each application; where they have it already, this one comes first."""
    import pathlib
    import tempfile
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = pathlib.Path(__file__).parent
    to = pathlib.Path(tempfile.mkdtemp()) / f"{here.name}.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(to))
    _SHIPPED.add(sc.applicationId)


_SHIPPED: set[str] = set()
