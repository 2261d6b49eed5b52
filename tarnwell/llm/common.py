"""What the operators share: hold-out folds, bounded samples, workers' memory and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = 1 << 20  # of texts handed to Python together; larger buffers stay with the allocator


def fold(id_column: str = "doc_id", folds: int = 5) -> Column:
    """``crc32`` of the id as text, modulo ``folds``; a null id counts as empty text."""
    as_text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.crc32(as_text.cast("binary")) % folds


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session, or the context's checkpoint folder. Where
    neither is set a local session, as in tests, gets a new temporary folder; on a
    cluster that would be another one on every machine, so it is an error there.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not shared and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tarnwell-"))
    return shared or context.getCheckpointDir()


def in_small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, after the session was told to hand texts to Python a megabyte at a time.

    Spark's own limit is a number of rows, which says nothing about texts. A limit that
    the session has already stays.
    """
    conf = docs.sparkSession.conf
    if conf.get(BATCH_BYTES, None) is None:
        conf.set(BATCH_BYTES, str(BATCH))
    return docs


KEPT: dict[tuple, Any] = {}  # by this worker process, from task to task


def kept(make: Callable[[str], Any], path: str) -> Any:
    """``make(path)``, which a worker process keeps for its next task; one such thing at a time."""
    if (make, path) not in KEPT:
        let_go()
        KEPT[make, path] = make(path)
    return KEPT[make, path]


def let_go() -> None:
    """Forget what tasks before have kept in this worker process, and give the memory back.

    For tasks that need none of it. Spark hands a worker on from stage to stage, and a
    tokenizer with the words it remembers would take room beside all that follow.
    """
    if KEPT:
        KEPT.clear()
        pa.default_memory_pool().release_unused()


def in_turns(texts: Sequence[str | None], most: int) -> Iterator[slice]:
    """Slices of ``texts`` of about ``most`` characters, one text at least."""
    begin, held = 0, 0
    for end, text in enumerate(texts, 1):
        held += len(text or "") + 1
        if held >= most:
            yield slice(begin, end)
            begin, held = end, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage and gives the optimiser true sizes; losing an executor loses
    nothing of it.
    """
    return written(df, name)[0]


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` read back from a new table in the shared folder, and that table's path."""
    path = f"{scratch(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


class Tables:
    """Settled tables of a job that go as soon as nothing is read from them any more.

    Without that the disk holds every step of a job at its end, though a step reads
    one or two others. Files of shuffles go as well when their table is written; else
    they stay until the driver happens to collect its garbage.
    """

    def __init__(self):
        self.paths: dict[str, tuple[SparkSession, str]] = {}

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        """See the function; ``name`` stands for one table at a time."""
        if name in self.paths:
            raise ValueError(f"there is a table {name!r} already")
        conf = df.sparkSession.conf
        before = conf.get(CLEAN_SHUFFLES, None)
        conf.set(CLEAN_SHUFFLES, "true")
        try:
            table, path = written(df, name)
        finally:
            if before is None:
                conf.unset(CLEAN_SHUFFLES)
            else:
                conf.set(CLEAN_SHUFFLES, before)
        self.paths[name] = df.sparkSession, path
        return table

    def drop(self, *names: str) -> None:
        """Put an empty table in the place of each; what is still read from them must be settled."""
        for name in names:
            spark, path = self.paths.pop(name)
            spark.range(0, 0, 1, 1).write.mode("overwrite").parquet(path)

    def drop_others(self, *names: str) -> None:
        self.drop(*(name for name in list(self.paths) if name not in names))


def hash_sample(df: DataFrame, id_column: str, most: int, seed: int) -> DataFrame:
    """About ``most`` rows at the most, chosen by a hash of the id alike on every run."""
    total = df.count()
    if total <= most:
        return df
    buckets = 1 << 30
    cut = int(most / total * buckets)
    return df.filter(F.pmod(F.xxhash64(F.col(id_column), F.lit(seed)), F.lit(buckets)) < cut)


def bitmap(df: DataFrame, column: str, bits: int) -> DataFrame:
    """One row with one array of ``bits`` bits, those set that values of ``column`` map to.

    For use as ``bitmap(...).scalar()``: a sieve of fixed size that lets through every
    value of the column and few others, ahead of a join on the whole value.
    """
    bit = F.pmod(F.col(column), F.lit(bits))
    words = (
        df.select(F.floor(bit / 64).alias("word"), (bit % 64).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    )
    every = df.sparkSession.range(bits // 64).withColumnRenamed("id", "word")
    pairs = F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits"))))
    return every.join(words, "word", "left").agg(F.transform(pairs, lambda p: p["bits"]).alias("bitmap"))


def is_set(bitmap: Column, value: Column, bits: int) -> Column:
    bit = F.pmod(value, F.lit(bits))
    return F.getbit(F.get(bitmap, F.floor(bit / 64).cast("int")), (bit % 64).cast("int")) == 1
