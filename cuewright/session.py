"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Without it the shuffle files of a write stay until the driver happens to collect its garbage.
FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName("cuewright")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CUEWRIGHT_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


_TEST_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir`` of the session.

    Only where the setting is missing on a local master (tests) is a temporary folder taken;
    on a cluster a missing setting is an error, because a machine-local folder would be wrong.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        if app not in _TEST_FOLDERS:
            _TEST_FOLDERS[app] = tempfile.mkdtemp(prefix="cuewright-")
        configured = _TEST_FOLDERS[app]
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/cuewright/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes that begin within delete their shuffle files as they end. A write has a plan of its own, so nothing reads them again."""
    before = spark.conf.get(FREES_SHUFFLES, None)
    spark.conf.set(FREES_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREES_SHUFFLES)
        else:
            spark.conf.set(FREES_SHUFFLES, before)


def _delete(spark: SparkSession, folder: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _folders(table: DataFrame) -> set[str]:
    return {f.rsplit("/", 1)[0] for f in table.inputFiles()}


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written_once`` that nothing will read again; everything made from them must be written itself."""
    for table in tables:
        spark = table.sparkSession
        home = shared_folder(spark).rstrip("/").removeprefix("file://") + "/cuewright/"
        for folder in _folders(table):
            if home in folder:  # scratch alone
                _delete(spark, folder)


_SCOPES = threading.local()


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables of ``written_once`` that are made within go at the end, but for those that a DataFrame given to ``keep`` reads.

    ``with passing_tables(spark) as keep``: whatever is used afterwards must be kept. Kept tables pass to the scope around this one.
    """
    outer, made, kept = getattr(_SCOPES, "made", None), [], set()
    _SCOPES.made = made

    def keep(table: DataFrame) -> DataFrame:
        kept.update(folder.rsplit("/", 1)[1] for folder in _folders(table))
        return table

    try:
        yield keep
    finally:
        _SCOPES.made = outer
        for path in made:
            if path.rsplit("/", 1)[1] not in kept:
                _delete(spark, path)
            elif outer is not None:
                outer.append(path)


def written_once(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: later steps read the table instead of computing it again, and a lost executor
    costs a read. Columnar, so readers still prune columns.
    """
    path = scratch_path(df.sparkSession, name)
    if getattr(_SCOPES, "made", None) is not None:
        _SCOPES.made.append(path)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
