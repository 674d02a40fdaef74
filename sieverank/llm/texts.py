"""Words of texts in Arrow batches, and the row conventions the operators share.

Words are runs of bytes other than space and the controls 0x09-0x0D, after A-Z became a-z. A null
text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieverank import plans

BLOCK_BYTES = 4 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def prepare(spark: SparkSession) -> None:
    """Makes the package importable in the tasks and keeps Arrow batches of texts small.

    To be called before a job with Python code. A batch ends after 1,000 rows or 4 MB, so a worker's
    memory does not depend on the length of the texts around it.
    """
    plans.ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BLOCK_BYTES))


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key's text, modulo; -1 where the key is null."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus, F.lit(-1)).cast("int")


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold up to ``limit`` bytes (or one row, if that holds more)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def mapped(texts: pa.Array, lower: bool = True) -> pa.Array:
    """The texts with controls 0x09-0x0D as spaces and, if asked, A-Z as a-z; nulls as empty."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if len(texts) == 0 or data is None:
        return texts
    raw = memoryview(data)[places[0] : places[-1]].tobytes().translate(_LOWER if lower else _SPACES)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((places - places[0]).astype(np.int32)), pa.py_buffer(raw))


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words in one array, and where each text's words start in it (one more entry than texts)."""
    if len(texts) == 0:
        return pa.array([], pa.string()), np.zeros(1, np.int64)
    lists = pc.split_pattern(mapped(texts, lower), " ")
    words = lists.flatten()
    starts = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        before = np.concatenate([[0], np.cumsum(full)])
        words, starts = words.filter(pa.array(full)), before[starts]
    return words, starts


def with_text(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text only: whatever else the table holds, under whatever name, takes no part."""
    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
