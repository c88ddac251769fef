"""Session set-up and the one way intermediate results are cut off from their lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}


def get_spark(app: str = "tidemark", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every job assumes: UTC, AQE, Arrow."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.enabled": "false",
    }
    base.update(conf)
    for k, v in base.items():
        b = b.config(k, v)
    return b.getOrCreate()


def lean_columns() -> None:
    """Switch off call-site capture for Column calls in this Python process.

    Sessions of ``get_spark`` set the public option for it; it is static, so for a session that
    somebody else started only its cached Python-side value can be changed. A catalogue plan is
    built from thousands of Column calls, each of which would otherwise make several extra round
    trips to the JVM just to remember a line number.
    """
    from pyspark.errors import utils
    if hasattr(utils, "_enable_debugging_cache"):
        utils._enable_debugging_cache = False


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for written intermediates.

    On a cluster it is ``spark.checkpoint.dir``. Only where nothing is configured (local tests)
    a private temporary folder is used.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder: executors cannot "
                               "read a folder of the driver machine")
        _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="tidemark-", dir=os.environ.get("TMPDIR"))
    return _LOCAL_FALLBACK[app]


def path_exists(spark: SparkSession, path: str) -> bool:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    A written table survives executor loss, is columnar (later stages prune columns and push
    filters into it), and gives the planner a real size to choose join strategies from.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
