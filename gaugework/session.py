"""Session set-up and lineage cutting."""

from __future__ import annotations

import contextvars
import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", app: str = "gaugework", memory: str = "16g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    session = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only a local master without that setting gets a fresh temporary folder.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _local_folder(context.applicationId)


@functools.lru_cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"gaugework-{application}-")


_on_the_way: contextvars.ContextVar[list | None] = contextvars.ContextVar("on_the_way", default=None)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage, survives the loss of executors, and gives loops true
    table sizes to plan with; sizes estimated through many joins only grow.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = _on_the_way.get()
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored result of ``build``; tables that it stored on the way are then deleted.

    Nothing reads them any more once the result is written whole. After a failure they stay. The
    result itself belongs to the ``settled`` call around this one, if there is one.
    """
    outer = _on_the_way.set([])
    try:
        result = build()
        made = _on_the_way.get()
    finally:
        _on_the_way.reset(outer)
    result = stored(result)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for path in made:
        folder = hadoop(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return result
