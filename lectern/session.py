"""Sessions for local work, and shipping the package to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def session(cores: str = "8", **conf: str) -> SparkSession:
    """A local session with the settings that the engine expects: UTC, adaptive execution, Arrow."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lectern")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where a local master left it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = f"file://{tempfile.gettempdir()}/lectern-stage"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def dealt(df: DataFrame) -> DataFrame:
    """df over all cores where its table has fewer files than there are cores: a file of one row group is else one task's, however long its rows take."""
    files, cores = len(df.inputFiles()), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < files < cores else df


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application; Spark's file server sends it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / "lectern.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"lectern/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
