"""Session settings and lineage cutting shared by the iterative operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Shuffles of many small keys: so many partitions, joined again up to this size, bound what a task holds in memory.
FINE = {"spark.sql.shuffle.partitions": "1024", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m"}
#: Files of this size in all are broadcast as they are; what is larger by what was shuffled of it.
BROADCAST, SHUFFLED_BROADCAST = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
SMALL = "256k"


def local_session(app: str = "aerolattice", cores: str = "8") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediates: `spark.checkpoint.dir`, or a temporary one on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster is a cluster, too
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="aerolattice-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def pinned(df: DataFrame, fine: bool = False) -> DataFrame:
    """Write `df` to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs a re-read of files and not a replay of the rounds before them. A written table also
    carries its size, so joins can choose to broadcast it; and unlike a checkpointed frame it does not carry the
    constraints of the plan behind it, which multiply from round to round until planning no longer ends. What was
    shuffled for it goes once it is written, not when the driver happens to collect its garbage. A `fine` one is shuffled
    to partitions of a few megabytes, so that more rows make more tasks and not larger ones.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    settings = {SHUFFLE_CLEANUP: "true"}
    if fine:
        settings |= FINE
        settings["spark.sql.shuffle.partitions"] = str(max(shuffle_width(spark), int(FINE["spark.sql.shuffle.partitions"])))
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        df.write.parquet(path)
    finally:
        _restore(spark, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._pinned_at = path
    return back


def _restore(spark: SparkSession, before: dict[str, str | None]) -> None:
    for name, value in before.items():
        if value is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, value)


def measured(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """`fn(df, ...)` with its joins broadcasting by measured sizes: what `fn` runs, not what its result still has to.

    Spark takes a written table for as large as its compressed files and leaves out that an explode multiplies rows, so a
    table under its limit may take hundreds of megabytes of the driver as rows. Here only very small files are trusted;
    what else is broadcast was shuffled before, and its rows stay under the limit that holds for the session.
    """

    @wraps(fn)
    def run(df: DataFrame, *args, **named) -> DataFrame:
        spark = df.sparkSession
        before = {name: spark.conf.get(name, None) for name in (BROADCAST, SHUFFLED_BROADCAST)}
        if not (before[BROADCAST] or "").startswith("-"):
            spark.conf.set(SHUFFLED_BROADCAST, before[SHUFFLED_BROADCAST] or before[BROADCAST] or "10m")
            spark.conf.set(BROADCAST, SMALL)
        try:
            return fn(df, *args, **named)
        finally:
            _restore(spark, before)

    return run


def release(*tables: DataFrame) -> None:
    """Delete tables made by `pinned` that nothing will read again; frames made otherwise are left alone."""
    for df in tables:
        path = getattr(df, "_pinned_at", None)
        if path:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
