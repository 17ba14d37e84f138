"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What is fetched, or broadcast in one piece, is measured against these bounds.
SMALL_ROWS = 100_000
SMALL_BYTES = 32 << 20

RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strandwork")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(session: SparkSession) -> str:
    """The folder for intermediate tables that every executor reaches.

    It is the session's checkpoint folder, from ``spark.checkpoint.dir``. Only a
    local master without that setting gets a temporary folder; on a cluster its
    absence is an error, because a machine-local folder would be lost with its
    executor.
    """
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        folder = session.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="strandwork-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


@contextmanager
def shuffles_freed(session: SparkSession) -> Iterator[None]:
    """What runs inside removes its shuffle files at its end, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = session.conf.get(name, None)
    session.conf.set(name, "true")
    try:
        yield
    finally:
        session.conf.unset(name) if before is None else session.conf.set(name, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.checkpoint(eager=True)


def _saved(df: DataFrame, folder: str) -> DataFrame:
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a committed table in the shared folder: what reads it can read single columns, and survives losses."""
    return _saved(df, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


class Scratch:
    """Tables of one job in the shared folder: one that is put in the place of another replaces it on disk, too."""

    def __init__(self, session: SparkSession, name: str):
        self.session = session
        self.folder = f"{shared_folder(session)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` as a committed table; what was put under ``name`` before must not be read any more."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        table = _saved(df, path)
        self.drop(name)
        self.paths[name] = path
        return table

    def drop(self, *names: str) -> None:
        """Remove tables that are not read any more."""
        for name in names:
            if name in self.paths:
                path = self.session._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
                path.getFileSystem(self.session._jsc.hadoopConfiguration()).delete(path, True)


def held(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` computed once, and about how many bytes it has.

    Up to ``SMALL_ROWS`` and ``SMALL_BYTES`` it becomes a local relation, beyond that a table in the shared
    folder. It is not marked for broadcast: see ``attach.join_small``, which broadcasts any such table in
    pieces of bounded size.
    """
    head = df.limit(SMALL_ROWS + 1).toArrow()
    if head.num_rows <= SMALL_ROWS and head.nbytes <= SMALL_BYTES:
        return df.sparkSession.createDataFrame(head, df.schema), head.nbytes
    table = written(df, "held")
    return table, table.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0]
