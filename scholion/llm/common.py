"""Helpers shared by the operators of this subpackage.

Executors and driver share no local folder: whatever has to outlive a stage goes through
``cut`` (``DataFrame.checkpoint``), a table under ``shared_path``, or a ``Scratch``, whose tables
are deleted as soon as no later step reads them, and at last by ``release``; all live in the folder that the cluster names in
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Rows in an Arrow batch; texts are long, so far fewer than Spark's 10,000.
ARROW_ROWS = 1000
ARROW_BYTES = 16 << 20


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and all runs in one process, as in tests."""
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="scholion-")
        spark.conf.set(CHECKPOINT_CONF, root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table or a set of files in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget how it was made."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders of the runs of this process, in order, until they are released.
_ROOTS: list[str] = []


class Scratch:
    """Tables of one run in the shared folder, by name. ``keep`` writes and rereads one; ``drop`` deletes those no longer read.

    What a result still reads when its operator returns stays until ``release``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.names = spark, shared_path(spark, name), set()
        _ROOTS.append(self.root)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.root}/{name}")
            self.names.discard(name)

    def drop_all_but(self, *names: str) -> None:
        self.drop(*(self.names - set(names)))


def runs_so_far() -> int:
    """A mark for ``release``."""
    return len(_ROOTS)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables of the runs after a mark: once their results have been read or written."""
    for root in _ROOTS[since:]:
        remove(spark, root)
    del _ROOTS[since:]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Long texts: keep Arrow batches small whatever the session's default is.

    Spark reads both settings when a plan is run, after the operator has returned; so they stay set.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null ids count as the text ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def encode(texts: Iterable) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [t.encode("utf-8") if isinstance(t, str) else b"" for t in texts]


def grouped(batches: Iterator, size_of, limit: int) -> Iterator[list]:
    """Gather rows of pandas batches into lists whose ``size_of`` sums to about ``limit``."""
    held, total = [], 0
    for batch in batches:
        for row in batch.itertuples(index=False, name=None):
            held.append(row)
            total += size_of(row)
            if total >= limit:
                yield held
                held, total = [], 0
    if held:
        yield held


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, elementwise and modulo 2**64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as doubles in [0, 1)."""
    return (x >> np.uint64(11)).astype(np.float64) * (1.0 / (1 << 53))
