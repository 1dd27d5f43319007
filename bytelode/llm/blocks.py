"""Words of a block of texts as Arrow arrays, cut at the level of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A-Z as a-z, every other byte as it is.
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of ``texts`` (strings without nulls) in a row, and where each text starts, their end included."""
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def words_of(texts: pa.Array, in_word) -> tuple[pa.BinaryArray, np.ndarray]:
    """All maximal runs of bytes that ``in_word`` marks, A-Z lower-cased, and their number in each text; no run crosses texts."""
    data, at = text_bytes(texts)
    inside = in_word(data)
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    places = np.zeros(len(starts) + 1, np.int32)
    total = np.cumsum(inside)
    places[:-1] = total[starts] - 1
    places[-1] = total[-1] if len(total) else 0
    kept = LOWER_BYTES[data[inside]]
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(kept)])
    return words, np.diff(np.searchsorted(starts, at))


def byte_lists(words: pa.Array) -> list[bytes]:
    return words.to_numpy(zero_copy_only=False).tolist()
