"""What the training-data operators share: reading, shipping code, scratch tables, Arrow maps."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: An Arrow batch ends at so many rows or bytes, whichever comes first: texts can be long.
BATCH_ROWS, BATCH_BYTES = 5000, "16m"
#: A key with over 1/HEAVY of all rows is joined by broadcast: there are fewer than HEAVY of those.
HEAVY = 1024
#: A key of so few rows is no burden to any task.
HEAVY_ROWS = 1000
#: Tasks a core that write a narrow table.
GATHERED = 4
DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and keep Arrow batches small.

    It changes the session it is given: spark.sql.execution.arrow.maxRecordsPerBatch and maxBytesPerBatch
    take this module's values and keep them, since results are read lazily.
    """
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, path) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Only where that is unset, on a single machine, a temporary
    folder, which the setting then names for the rest of the session and which goes at the process's end."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="fieldloom-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, name: str, gather: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    gather: the last stage's partitions are read by GATHERED tasks a core, if there are more of them: for
    narrow tables, whose files would be many and small. Not for maps that number rows by task.
    """
    if gather:
        df = df.coalesce(GATHERED * df.sparkSession.sparkContext.defaultParallelism)
    path = f"{scratch_root(df.sparkSession)}/fieldloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._fieldloom_path = path
    return out


def settled(df: DataFrame, name: str) -> DataFrame:
    """df, for maps that number its rows by partition and place: a table of it, if it comes out of a shuffle.

    What a shuffle hands on comes in another order when a lost task is run again, and rows numbered anew
    would not fit those that other tasks have read before. What is scanned comes in one order always; a
    source that does not repeat its rows without a shuffle (JDBC, rand()) must be written by the caller.
    """
    shuffled = re.search(r"\bExchange\b", df._jdf.queryExecution().executedPlan().toString())
    return written(df, name) if shuffled else df


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more; other DataFrames are left alone."""
    for t in tables:
        if path := getattr(t, "_fieldloom_path", None):
            spark = t.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def joined(many: DataFrame, few: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """many joined with few, one row a key, whose `weight` says how many rows of many have that key.

    Keys that hold over 1/HEAVY of all rows, fewer than HEAVY of them, are broadcast; the rest meets in
    a shuffle, in which no key is hot then. `few` must be cheap to read again. how: inner or left.
    """
    total = few.agg(F.sum(weight)).first()[0] or 0
    limit = max(HEAVY_ROWS, total // HEAVY)
    heavy = few.where(F.col(weight) > limit).drop(weight)  # weights add up to total: fewer than HEAVY rows
    light = few.where(F.col(weight) <= limit).drop(weight)
    if heavy.isEmpty():
        return many.join(light, keys, how)
    top = many.join(F.broadcast(heavy), keys)
    rest = many.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, how)
    return top.unionByName(rest)


def tiles(make_rows: Callable[[pa.Table], Iterable], schema: pa.Schema) -> Callable:
    """For arrow_map over rows sorted by their key columns k*: make_rows on all rows of each key."""

    class Tiles:
        def __init__(self):
            self.held: list[pa.RecordBatch] = []

        def __call__(self, batch: pa.RecordBatch):
            keys = [c for c in batch.schema.names if re.fullmatch(r"k\d*", c)]
            values = list(zip(*(batch.column(c).to_pylist() for c in keys)))
            cut = [i for i in range(1, len(values)) if values[i] != values[i - 1]]
            if self.held:
                last = self.held[-1]
                if tuple(last.column(c)[last.num_rows - 1].as_py() for c in keys) != values[0]:
                    cut = [0, *cut]
            rows: list = []
            at = 0
            for c in cut:
                self.held.append(batch.slice(at, c - at))
                rows += self.flush()
                at = c
                if len(rows) >= BATCH_ROWS:
                    yield self.batch(rows)
                    rows = []
            self.held.append(batch.slice(at))
            if rows:
                yield self.batch(rows)

        def flush(self) -> list:
            table = pa.Table.from_batches([b for b in self.held if b.num_rows])
            self.held = []
            return list(make_rows(table)) if table.num_rows else []

        def batch(self, rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        def finish(self):
            if self.held and (rows := self.flush()):
                yield self.batch(rows)

    return Tiles


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], object]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow of a function of one batch that `make` builds once for each task.

    The function returns None, a RecordBatch or an iterable of them. If it has an attribute
    `finish`, that is called at the task's end and may yield more batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            if batch.num_rows:
                out = one(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out
        if hasattr(one, "finish"):
            yield from one.finish()
        out = batch = one = None
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns what this worker's allocators hold free to the machine: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def fold(doc_id: str, modulus: int) -> "F.Column":
    """crc32 of the id as text, modulo."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def by_characters(texts: list[str | None], most: int) -> Iterator[list[str | None]]:
    """The texts in turn, in lists of about so many characters; a longer text is alone."""
    part, size = [], 0
    for t in texts:
        n = len(t or "") + 16
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += n
    if part:
        yield part


def sample_rows(rows: DataFrame, limit: int, characters: int, salt: int = 7, among: DataFrame | None = None) -> list:
    """The first `limit` of rows (doc_id, text, ...) in hash order of id and text, but for those that would
    exceed so many characters together, so that long texts are rarer in it: a bounded sample of whole rows
    that any run repeats. Equal rows count once.

    among: only rows whose doc_id it has. The driver first sees `limit` lengths, then the texts of those rows.
    """
    narrow = rows.select(F.xxhash64("doc_id", "text", F.lit(salt)).alias("h"), "doc_id", F.char_length("text").alias("n"))
    if among is not None:
        narrow = narrow.join(among.select("doc_id"), "doc_id", "left_semi").select("h", "doc_id", "n")
    first = narrow.distinct().orderBy("h", "doc_id").limit(limit).collect()
    total, keep = 0, []
    for r in first:
        if total + r["n"] <= characters:
            total += r["n"]
            keep.append((r["h"], r["doc_id"]))
    if not keep:
        return []
    spark = rows.sparkSession
    chosen = spark.createDataFrame(keep, f"__h bigint, __id {rows.schema['doc_id'].dataType.simpleString()}")  # `limit` rows at most: may be broadcast
    found = rows.join(F.broadcast(chosen), (F.col("doc_id") == F.col("__id")) & (F.xxhash64("doc_id", "text", F.lit(salt)) == F.col("__h"))).drop("__h", "__id")
    return sorted(found.dropDuplicates().limit(limit).collect(), key=lambda r: (str(r["doc_id"]), r["text"], repr(r)))
