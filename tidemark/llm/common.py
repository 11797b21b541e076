"""Shared helpers: scratch tables, Arrow batch limits, folds and word codes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path, PurePosixPath

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch sent to Python; a batch is all that a task holds in Python at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def freeing(run: Callable) -> Callable:
    """``run`` over Arrow batches; when its task ends, the worker gives memory back, for it is kept for later tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application: a zip in the scratch folder, sent by Spark."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    top = Path(__file__).resolve().parents[2]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted((top / "tidemark").rglob("*.py")):
            z.write(f, f.relative_to(top))
    uri = scratch(spark, "code") + ".zip"
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(str(PurePosixPath(path).parent))
    with store.open_output_stream(path) as out:
        out.write(packed.getvalue())
    sc.addPyFile(uri)
    sc._tidemark_shipped = True


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session; plans read the setting when they run. Workers get this package."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; only a local master without the setting gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    _made.append(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


#: Scratch folders of this process, in the order of their making.
_made: list[str] = []


def scratch_mark() -> int:
    """How many scratch folders there are now."""
    return len(_made)


def last_scratch() -> str:
    return _made[-1]


def drop_scratch_since(spark: SparkSession, mark: int, *kept: str) -> None:
    """Delete the scratch folders made after ``mark``, but for ``kept`` and the package's code."""
    for path in [p for p in _made[mark:] if p not in kept and "/code-" not in p]:
        drop_scratch(spark, path)
        _made.remove(path)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet (with the writer's ``options``) in the shared scratch folder and read back: a lineage cut that survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that no later plan reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from; rows without an id belong to it."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(True))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def translate(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """``texts`` with every byte replaced through a table of 256 bytes, as one binary array."""
    texts = pa.concat_arrays([texts]) if texts.offset == 0 else pa.array(texts.to_pylist(), texts.type)
    texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return texts
    _, offsets, data = texts.buffers()
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.string(), len(texts), [None, offsets, pa.py_buffer(table[raw].tobytes())], offset=texts.offset)


def space_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words between runs of [\\x20\\x09-\\x0D]: (distinct words, code of each word, word offsets of the texts)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    words, ends = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    ends = ends - ends[0] if len(ends) else np.zeros(1, np.int64)
    full = np.asarray(pc.greater(pc.binary_length(words), 0)).astype(bool)
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        words, ends = words.filter(pa.array(full)), before[ends]
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.dictionary, np.asarray(coded.indices).astype(np.int64), ends.astype(np.int64)


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hash of every word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def doc_of(ends: np.ndarray) -> np.ndarray:
    """For word offsets of n texts, the text of each word."""
    return np.repeat(np.arange(len(ends) - 1), np.diff(ends))
