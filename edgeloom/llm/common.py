"""What the operators of this subpackage share: registration, scratch tables, Arrow helpers."""

from __future__ import annotations

import sys
import types as pytypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.session import checkpoint_folder, tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A word of the corpus contracts: anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

# Workers need not have this package on their path: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules["edgeloom.llm"])


def settle(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on.

    Shuffle files go as soon as the query that wrote them has ended (every step
    kept for later is a written table), and Arrow batches stay small whatever
    the length of a text.
    """
    tune(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(12 << 20))
    return spark


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn`` under ``name``, with the SQL that gives the same rows."""

    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(settle(spark), sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables of one run under ``spark.checkpoint.dir``: shared, so lost executors cost nothing."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{checkpoint_folder(spark)}/llm-{uuid.uuid4().hex}"
        self.kept = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back: no lineage, true sizes, column pruning."""
        path = f"{self.root}/{self.kept}"
        self.kept += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def clean_columns(df: DataFrame, taken: list[str]) -> DataFrame:
    """Drop columns of ``df`` whose names an operator is about to use."""
    low = {c.lower() for c in taken}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, across tasks."""
    name = "_edgeloom_llm_worker"
    return sys.modules.setdefault(name, pytypes.ModuleType(name)).__dict__


def fresh_worker() -> None:
    """A worker of this operator drops what earlier ones kept in it (tokenizers, words): idle, it would add to the peak."""
    worker_cache().clear()
    pa.default_memory_pool().release_unused()


def parts_of(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """First row and number of rows of consecutive parts of about ``size`` bytes, a longer text alone."""
    length = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(length), 0
    while at < len(length):
        before = int(ends[at - 1]) if at else 0
        n = max(1, int(np.searchsorted(ends, before + size, "right")) - at)
        yield at, n
        at += n


def small_batches(batches: Iterator[pa.RecordBatch], column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` by about ``size`` bytes of text, of which words and hashes take many times that."""
    for batch in batches:
        for at, n in parts_of(column_array(batch, column), size):
            yield batch.slice(at, n)


def split_words(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Per word its number among the distinct words, those words, and per text its first word.

    Words are what ASCII white space separates; text i owns the words
    ``codes[first[i]:first[i + 1]]``.
    """
    lists = pc.ascii_split_whitespace(texts)
    first = lists.offsets.to_numpy()
    encoded = lists.flatten().dictionary_encode()
    words = encoded.dictionary.cast(pa.binary()).to_pylist()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    return codes, words, first - first[0]


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Row sums of ``values`` (words × k) for each text of ``split_words``."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def take_ragged(starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Concatenate ``flat[starts[i]:starts[i] + lengths[i]]`` over all i."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    at = np.arange(ends[-1], dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
    return flat[at]


def batches_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from table.to_batches()


def column_array(batch: pa.RecordBatch, name: str) -> pa.Array:
    out = batch.column(batch.schema.get_field_index(name))
    return out.cast(pa.string()) if pa.types.is_large_string(out.type) else out
