"""Tables written to the cluster's shared folder, to cut lineage or share an evaluation."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting (since 4.1) that shuffle files go when the query that wrote them has ended.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dir: str | None = None
#: Tables that stand, by path, with the sessions that wrote them.
_tables: dict[str, SparkSession] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one of our own (local mode only)."""
    global _own_dir
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="meldspark-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def new_folder(spark: SparkSession, name: str) -> str:
    """The place of a folder of files in the shared folder; like a table, it stands until it is
    discarded, or the process ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _tables[path] = spark
    return path


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; survives lost executors. What was
    shuffled for it goes at once, not when the driver happens to collect its garbage.

    The table stands until it is discarded, or the process ends."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(SHUFFLES_GO, None)
    if before is not None:
        spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        if before is not None:
            spark.conf.set(SHUFFLES_GO, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _remove(path: str) -> None:
    spark = _tables.pop(path, None)
    if spark is not None:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for table in tables:
        _remove(table._scratch_path)


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """Collects the tables that are materialized in the block, for ``discard_paths``."""
    before, made = set(_tables), []
    yield made
    made += [p for p in _tables if p not in before]


def discard_paths(paths: list[str]) -> None:
    for path in paths:
        _remove(path)


@atexit.register
def _clean_up() -> None:
    """What still stands in a shared folder when the process ends."""
    for path in list(_tables):
        with contextlib.suppress(Exception):  # the session may be gone already
            _remove(path)
