"""Texts as units a tokenizer treats one by one, so that each distinct unit of a block is encoded once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that may follow the space a unit starts with: no white space, alone or as the first byte of a character
#: that may be one.
_PLAIN_START = np.zeros(256, bool)
_PLAIN_START[0x21:0x7F] = True
_PLAIN_START[0xC3:0xE1] = True
_PLAIN_START[0xE4:0xF5] = True
#: ASCII letters are 1, other signs 2, and what no cut goes by 0.
_SIDE = np.zeros(256, np.uint8)
_SIDE[0x21:0x7F] = 2
_SIDE[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = 1


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """The batches put together until their texts hold ``limit`` bytes; rows stay in order."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each starts in them (one more entry than texts); nulls are empty."""
    texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) else b"")
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[places[0] : places[-1]], places - places[0]


def split_units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All units in one array, and where each text's units start in it (one more entry than texts).

    The units of a text, end to end, are a space and the text; a null or empty text has none. It is cut before a space
    that follows something other than a space and precedes something that is no white space, and
    between an ASCII letter and another ASCII sign, but not behind an apostrophe.
    """
    texts = pc.fill_null(texts, "")
    full = pc.greater(pc.binary_length(texts), 0)
    data, places = raw(pc.binary_join_element_wise("", texts.filter(full), " "))
    if not len(data):
        return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
    cut = np.zeros(len(data) + 1, bool)
    space = data == 0x20
    cut[1:-2] = space[1:-1] & ~space[:-2] & _PLAIN_START[data[2:]]
    side = _SIDE[data]
    cut[1:-1] |= (side[1:] != side[:-1]) & (side[1:] > 0) & (side[:-1] > 0) & (data[:-1] != ord("'"))
    cut[places[1:] - 1] &= ~space[places[1:] - 1]  # a last space follows no text
    cut[places] = True
    starts = np.flatnonzero(cut)
    units = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data))
    at = np.searchsorted(starts, places)
    number = np.zeros(len(texts), np.int64)
    number[full.to_numpy(zero_copy_only=False)] = np.diff(at)
    return units, np.concatenate([[0], np.cumsum(number)])


def coded(units: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct units, and for every unit which of them it is."""
    found = units.dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False)


def spread(sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists laid end to end, of these sizes: the places of the coded lists' entries, and where each list starts."""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    taken = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(taken)])
    return np.repeat(starts[codes] - ends[:-1], taken) + np.arange(ends[-1]), ends
