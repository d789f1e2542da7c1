"""Helpers shared by operators that work on Arrow batches inside Spark tasks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import shutil
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import SparkSession

_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Text handled at once inside a task. Bounds a worker's memory whatever the size of Arrow's batches.
SLICE_BYTES = 1_000_000
#: Rows of a batch between Spark and its Python workers. Texts are long: the default of 10,000 would hold tens of MB.
BATCH_ROWS = 2_000
#: Bytes of such a batch: Spark's process and the worker hold it at once, and again on its way back.
BATCH_BYTES = 2_000_000

_shipped: set[str] = set()


def ready(spark: SparkSession) -> None:
    """Make a session ready for this package's Python tasks.

    Executors get the package's code once per application, so that they need no copy of it, and batches are cut to
    ``BATCH_ROWS`` and ``BATCH_BYTES`` where the session leaves Spark's defaults. What an earlier operator left in the driver's Python, such as
    a model that was shared, is given back first.
    """
    gc.collect()
    release()
    if spark.conf.get(_ROWS_KEY) == "10000":
        spark.conf.set(_ROWS_KEY, str(BATCH_ROWS))
    if spark.conf.get(_BYTES_KEY) == "67108864b":
        spark.conf.set(_BYTES_KEY, str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(tempfile.mkdtemp() + "/" + root.name, "zip", root.parent, root.name)
        sc.addPyFile(archive)
        _shipped.add(sc.applicationId)


def release() -> None:
    """Give memory that a task is done with back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the strings of ``column`` hold about ``most`` bytes; a longer string stands alone.

    What a slice took is given back after it: freed memory that a worker keeps adds up with that of the others.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        offsets = pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.binary_length(values), 0).cast(pa.int64())).to_numpy()
        begin, base = 0, 0
        while begin < n:
            end = max(begin + 1, int(offsets.searchsorted(base + most, "right")))
            yield batch.slice(begin, end - begin)
            if offsets[end - 1] - base >= most // 2:
                release()
            begin, base = end, int(offsets[end - 1])
    release()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Strings of a column; null as the empty string."""
    return [x if x is not None else "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


class Memo(dict):
    """What was computed for distinct pieces; emptied when it holds ``most`` bytes, pieces and values of any length."""

    def __init__(self, many, most: int = 80_000_000):
        super().__init__()
        self._many, self._most, self.held = many, most, 0

    def learn(self, pieces: Iterable) -> None:
        """Compute what is missing for these distinct pieces, in one call."""
        if self.held > self._most:
            self.clear()
            self.held = 0
        new = [p for p in pieces if p not in self]
        if not new:
            return
        values = self._many(new)
        self.update(zip(new, values, strict=True))
        self.held += 200 * len(new) + sum(map(len, new)) + sum(len(v) for v in values if isinstance(v, bytes))
