"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` overrides any setting (dots written as `__`)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: spark.checkpoint.dir of the session.

    Where the setting is absent and the master is local, a temporary folder is used; on a cluster its
    absence is an error, since a machine-local folder would not survive the loss of an executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder (replicated storage there, not executor disks)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete the checkpoint of a frame made by `cut` that nothing will read again, such as the last round's state."""
    jvm = spark._jvm
    file = df._jdf.queryExecution().analyzed()
    if not file.getClass().getSimpleName() == "LogicalRDD":
        return
    place = file.rdd().getCheckpointFile()
    if place.isDefined():
        path = jvm.org.apache.hadoop.fs.Path(place.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
