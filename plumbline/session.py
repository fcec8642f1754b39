"""Session settings and written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[tuple[str, str], str] = {}
_SHIPPED: set[str] = set()


def build(name: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library expects; cluster settings win where they exist."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true",
                 "spark.sql.adaptive.skewJoin.enabled": "true",
                 "spark.python.sql.dataFrameDebugging.enabled": "false", **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; Spark serves the archive from the driver."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="plumbline-")), "plumbline.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(root, "plumbline")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(archive)


def shared_dir(spark: SparkSession) -> str:
    """Folder for written tables and checkpoints: ``spark.checkpoint.dir`` where it is set.

    Only a local session without that setting gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="plumbline-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back: lineage ends, pruning stays."""
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_once(spark: SparkSession, key: str, make) -> DataFrame:
    """Like :func:`written`, but one table per application and key."""
    slot = (spark.sparkContext.applicationId, key)
    if slot not in _WRITTEN:
        path = new_dir(spark, "table")
        make().write.parquet(path)
        _WRITTEN[slot] = path
    return spark.read.parquet(_WRITTEN[slot])
