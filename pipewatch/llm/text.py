"""Words of whole Arrow batches of texts, found and hashed with numpy.

A batch's texts lie in one buffer of UTF-8 bytes. All functions work on that
buffer, so no Python string is made per word. A null text is an empty text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Executors get these functions with the task, without this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The words of every contract: runs of anything but these.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Text handed to numpy at once; bounds a task's memory, not what it works on.
SLICE_BYTES = 1 << 20

M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xC2B2AE3D27D4EB4F)
M3 = np.uint64(0xFF51AFD7ED558CCD)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins (one more entry than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, name: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``size`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(column(batch, name)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(lengths.astype(np.int64) + 64) // size
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def segments(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of ``inside`` bytes; a text's border ends a run."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    before = np.empty(len(inside), dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    border = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[border] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(inside), dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    after[border[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * M3
    h = (h ^ (h >> np.uint64(29))) * M2
    return h ^ (h >> np.uint64(32))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each segment's bytes, the same in every task and run."""
    lengths = ends - starts
    h = mix(lengths.astype(np.uint64) * M1 + np.uint64(seed))
    if not len(starts):
        return h
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    live, at = np.arange(len(starts)), 0
    while len(live):
        left = lengths[live] - at
        live, left = live[left > 0], left[left > 0]
        if not len(live):
            break
        value = eight[starts[live] + at]
        short = left < 8
        keep = (np.uint64(1) << (np.minimum(left, 7) * 8).astype(np.uint64)) - np.uint64(1)
        value = np.where(short, value & keep, value)
        h[live] = mix((h[live] ^ value) * M1)
        at += 8
    return h


def words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word, its row, and each row's number of words."""
    data, offsets = buffers(texts)
    if lower:
        data = LOWER[data]
    starts, ends, rows = segments(~SPACE[data], offsets)
    return hashes(data, starts, ends), rows, np.bincount(rows, minlength=len(offsets) - 1)


def hash_strings(values: list[str], seed: int = 0) -> np.ndarray:
    data, offsets = buffers(pa.array(values, pa.large_string()))
    return hashes(data, offsets[:-1], offsets[1:], seed)


def per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of 0/1 or whole numbers per row, as int64."""
    return np.bincount(rows, weights=values, minlength=n).astype(np.int64)
