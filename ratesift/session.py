"""Session settings and durable intermediate results."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution picks partition counts, broadcast sides (by measured size) and splits skewed joins.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_LOCAL_FALLBACK: dict[str, str] = {}
# Removes a query's shuffle files when it ends, not when the driver happens to collect its plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITING: dict[str, int] = {"now": 0}
_LOCK = threading.Lock()


def get_session(app: str = "ratesift", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session; keyword names use ``__`` for dots (``spark__sql__shuffle__partitions="8"``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _LOCAL_FALLBACK.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="ratesift-"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/ratesift/{name}-{uuid.uuid4().hex}"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that start inside are removed at their end; queries may run side by side."""
    with _LOCK:
        if not _WRITING["now"]:
            _WRITING["before"] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _WRITING["now"] += 1
    try:
        yield
    finally:
        with _LOCK:
            _WRITING["now"] -= 1
            if not _WRITING["now"]:
                before = _WRITING.pop("before")
                spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files that outlive executors.

    The write's shuffle files go with it, so a chain of steps holds those of one step at a time.
    """
    path = scratch_path(df.sparkSession, name)
    with cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """Ask that joins sort and shuffle ``df`` instead of collecting it for a broadcast.

    A written table of many similar rows has small files; by their size Spark may take millions of rows for a small side.
    """
    return df.hint("merge")
