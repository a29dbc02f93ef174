"""Session settings and the shared scratch folder."""
from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Classification is CPU bound (two dozen patterns per ticket), so scan splits are kept small
    # enough that one task holds minutes of work, not hours.
    "spark.sql.files.maxPartitionBytes": "64m",
}


# Used only on one machine that names no shared folder, as in tests.
_fallback: dict[str, tempfile.TemporaryDirectory] = {}


def build_session(master: str | None = None, app: str = "triagegrid", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or the one given to ``setCheckpointDir``.

    A session on one machine that names neither gets a temporary folder, which goes when the driver ends.  On a cluster
    that would be a folder the executors cannot see, so it is an error there.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        held = _fallback.get(context.applicationId)
        if held is None:
            held = _fallback[context.applicationId] = tempfile.TemporaryDirectory(prefix="triagegrid-", ignore_cleanup_errors=True)
        folder = held.name
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def inline_rows(spark: SparkSession, names: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """A small table of constants, planned inside the JVM."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))
