"""Small helpers for Arrow-batched operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of text handled together inside a Python worker, in bytes; a single longer text stands alone.
CHUNK_BYTES = 4 << 20

#: Bytes of a batch on its way to a Python worker, unless the session has a value of its own. Each task
#: holds a few such batches, in the JVM and in every worker it is chained through.
_BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` in batches of bounded bytes; a worker gives its free memory back when a task ends.

    Plans read the bound when they run, so it stays set in the session, unless that has one of its own.
    """
    conf = df.sparkSession.conf
    if _BATCH_CONF not in conf.getAll:
        conf.set(_BATCH_CONF, BATCH_BYTES)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(tidy, schema)


def release() -> None:
    """Give freed memory back: a process lives on after its task or fit, and glibc alone would keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def raw(col: str | Column = "text") -> Column:
    """A text column as UTF-8 bytes; null reads as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the incoming batches whose texts sum to about ``limit`` bytes."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that clashing extra columns never reach an operator."""
    return df.select(*names)
