"""Arrow batches of whole texts: their size, and the memory they leave behind."""

from __future__ import annotations

import ctypes
from typing import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_ROWS = 256
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, in a session whose Arrow batches hold at most BATCH_ROWS rows.

    Spark cuts batches by rows (10,000 by default); with whole texts that is tens of MB a batch on
    average and without bound for long ones, held several times over by the JVM and the Python worker.
    The setting is read when a plan runs, so it stays lowered; a smaller one is left alone."""
    conf = docs.sparkSession.conf
    now = int(conf.get(_SETTING))
    if now <= 0 or now > BATCH_ROWS:
        conf.set(_SETTING, str(BATCH_ROWS))
    return docs


def give_back() -> None:
    """Hand freed memory back to the system. Spark keeps Python workers alive between tasks, and the
    C allocator keeps what large arrays leave behind; without this, every worker stays at its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc: nothing to hand back
        pass


_clear: list[Callable[[], None]] = []


def cached_for_tasks(clear: Callable[[], None]) -> None:
    """Register what empties a cache that a worker keeps between tasks of one operator."""
    _clear.append(clear)


def tidy(batches_in: Callable[[Iterator], Iterator], caches: bool = False) -> Callable[[Iterator], Iterator]:
    """An Arrow batch function that ends by giving its memory back; one that does not use the caches
    of earlier operators in its worker drops them first."""

    def run(batches: Iterator) -> Iterator:
        if not caches:
            for clear in _clear:
                clear()
            give_back()
        try:
            yield from batches_in(batches)
        finally:
            give_back()

    return run
