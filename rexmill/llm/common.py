"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII blanks (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch that a Python worker is sent, where the session sets no bound of its own.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or of setCheckpointDir.

    Where neither is set, a temporary folder is, in local mode only (tests): the
    executors of a cluster couldn't see it, so there it is an error.
    """
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='rexmill-')}")
    return sc._jsc.sc().getCheckpointDir().get()


def bounded(df: DataFrame) -> DataFrame:
    """df, whose session sends Python workers batches of bounded bytes (a longer row comes alone), unless it has a bound of its own."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_BYTES))
    return df


#: Tables stashed in each open scope, and whether its result reads them.
_SCOPES: list[list[tuple[DataFrame, bool]]] = []


@contextlib.contextmanager
def scratch():
    """A scope that deletes the tables stashed in it when it ends, but for kept ones, which the scope around it takes over."""
    _SCOPES.append(made := [])
    try:
        yield
    finally:
        _SCOPES.pop()
        for df, kept in made:
            if not kept:
                unstash(df)
            elif _SCOPES:
                _SCOPES[-1].append((df, False))


def scratched(fn):
    """fn in a scope of its own; what its lazy result reads is stashed with ``keep``."""

    @functools.wraps(fn)
    def run(*args, **kwargs):
        with scratch():
            return fn(*args, **kwargs)

    return run


#: Share of the driver's heap limit that its JVM may hold when a step is written.
HEAP_SHARE = 0.5


def settle(spark: SparkSession) -> None:
    """Where the driver's JVM holds more than HEAP_SHARE of its limit: a full collection, which gives back what finished steps no longer use.

    An operator runs hundreds of jobs, whose plans and task metrics the JVM would
    else pile up to its limit, however few of them are alive.
    """
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > HEAP_SHARE * heap.maxMemory():
        gc.collect()  # plans that Python objects hold
        spark._jvm.java.lang.System.gc()


def stash(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    settle(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    if _SCOPES:
        _SCOPES[-1].append((out, keep))
    return out


def unstash(df: DataFrame) -> None:
    """Delete what ``stash`` wrote; only for tables no lazy result still reads. A table that is gone already is left so."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stash_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``max_bytes``; a longer row comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        arr = batch.column(column)
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(arr), 0), dtype=np.int64)
        part = np.cumsum(sizes) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def as_bytes(arr: pa.Array) -> list[bytes | None]:
    return arr.cast(pa.binary()).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (public domain constants, fixed values)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Stable 64-bit hashes of all words, and the offset of each document's first word."""
    offsets = np.zeros(len(docs) + 1, dtype=np.int64)
    np.cumsum([len(d) for d in docs], out=offsets[1:])
    flat = np.empty(int(offsets[-1]), dtype=object)
    flat[:] = [w for d in docs for w in d]
    return (pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)), offsets


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of one word sequence; a shorter one counts as one window."""
    if not len(words):
        return words
    k = min(k, len(words))
    acc = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - k + 1 + j])
    return acc


def to_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """About ``most`` labelled documents at most, by the hash of doc_id, so the same on every run.

    labels: one row per ``doc_id``. Returns the labels of the sample (doc_id as
    ``lab_id``) and the documents that may be in it; the filter on the hash runs
    in the scan, so only the sample's texts are moved.
    """
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 20))
    limit = int(min(1.0, 0.95 * most / max(1, labels.count())) * (1 << 20))
    lab = stash(labels.filter(part < limit).withColumnRenamed("doc_id", "lab_id"), "labels")
    # the sample's ids are few by construction; their number is checked before they are broadcast
    side = F.broadcast(lab) if lab.count() <= 2 * most else lab
    return side, docs.filter(part < limit).join(side.select("lab_id"), docs["doc_id"] == F.col("lab_id"), "left_semi")
