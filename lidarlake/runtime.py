"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Names of tables that operators registered in the session's catalogue, in a database of their own, and the paths that
#: were written for this application; `release` drops them.
TABLES: list[str] = []
PATHS: list[str] = []


def ship(spark: SparkSession) -> None:
    """Give the executors this package once per application, so that Python stages import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, os.path.join(root.name, p.relative_to(root)))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. Only a local session may go without one: executors of a cluster
    would write to their own disks, and a later read would miss those files."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


#: While a table is written that cuts the lineage: its shuffle files go when it is done, and Arrow batches stay small.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}

#: Where rows of some megabytes each are read: a reader's batch holds all values of its rows, for every table of a join.
_LARGE = {"spark.sql.parquet.columnarReaderBatchSize": "2"}


@contextmanager
def writing(spark: SparkSession, large: bool = False) -> Iterator[None]:
    own = _WRITING | (_LARGE if large else {})
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, large: bool = False) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again from there. large: the rows that are read are."""
    spark = df.sparkSession
    path = scratch(spark)
    with writing(spark, large):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete cut frames that nothing will read again."""
    for df in frames:
        _delete(df.sparkSession, df.cut_path)
        if df.cut_path in PATHS:
            PATHS.remove(df.cut_path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def tidy(spark: SparkSession) -> None:
    """Have the driver collect its garbage: plans of finished jobs let its heap grow to the limit long before it collects
    them, and Spark drops shuffles and broadcasts of frames that are gone no sooner than they are collected."""
    spark._jvm.System.gc()


def scratch(spark: SparkSession) -> str:
    """A new path in this application's part of the shared folder."""
    PATHS.append(f"{shared_dir(spark).rstrip('/')}/cut-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}")
    return PATHS[-1]


def scratch_table(spark: SparkSession) -> str:
    """A new name in this application's own database, which lasts as long as it has tables."""
    database = f"scratch_{re.sub(r'[^a-z0-9]', '_', spark.sparkContext.applicationId.lower())}"
    if not spark.catalog.databaseExists(database):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{scratch(spark)}'")
    TABLES.append(f"{database}.t_{uuid.uuid4().hex}")
    return TABLES[-1]


@dataclass
class Made:
    """Paths and tables that were cut meanwhile."""

    paths: list[str] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)

    def drop(self, spark: SparkSession) -> None:
        """Delete them; frames that read them can no longer be read."""
        for t in self.tables:
            if spark.catalog.databaseExists(t.split(".")[0]):
                spark.sql(f"DROP TABLE IF EXISTS {t}")
            if t in TABLES:
                TABLES.remove(t)
        if self.tables and not TABLES:
            spark.sql(f"DROP DATABASE IF EXISTS {self.tables[0].split('.')[0]} CASCADE")
        for p in self.paths:
            _delete(spark, p)
            if p in PATHS:
                PATHS.remove(p)
        self.paths, self.tables = [], []


@contextmanager
def recorded() -> Iterator[Made]:
    """What is cut inside."""
    made, paths, tables = Made(), len(PATHS), len(TABLES)
    try:
        yield made
    finally:
        made.paths, made.tables = PATHS[paths:], TABLES[tables:]


def release(spark: SparkSession) -> None:
    """Delete all that this application has cut; frames that were not written before can no longer be read."""
    Made(list(PATHS), list(TABLES)).drop(spark)
    _delete(spark, f"{shared_dir(spark).rstrip('/')}/cut-{spark.sparkContext.applicationId}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
