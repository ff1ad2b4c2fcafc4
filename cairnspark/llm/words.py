"""64-bit values of the words of whole Arrow columns, without an object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_RANDOM = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
#: A byte's value, A-Z as a-z.
_BYTE = _RANDOM[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes that are hashed at once; bounds the arrays, whatever the length of a text or word.
CHUNK = 1 << 20
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> list[np.ndarray]:
    if not _powers:
        for x in (_STEP, _BACK):
            row = np.full(CHUNK + 1, x, np.uint64)
            row[0] = 1
            _powers.append(np.cumprod(row))
    return [p[:n] for p in _powers]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _raw(part: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and unmixed values of the words of at most CHUNK bytes; a word ends at each of ``edges`` (ascending)."""
    word = ~_SPACE[part]
    edge = np.zeros(len(part) + 1, bool)
    edge[edges] = True
    before = np.concatenate([[False], word])
    after = np.concatenate([word, [False]])
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    forward, back = _powers_to(len(part) + 1)
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_BYTE[part] * forward[: len(part)], out=sums[1:])
    return starts, ends, (sums[ends] - sums[starts]) * back[starts]


def _long(data: np.ndarray) -> np.ndarray:
    """Values of the words of one text of any length, chunk by chunk; a word may span chunks."""
    found, held, length = [], np.zeros(1, np.uint64), 0
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        starts, ends, raw = _raw(part, np.zeros(0, np.int64))
        sizes = (ends - starts).astype(np.uint64)
        if length:  # the word before goes on, or ended with its chunk
            if len(starts) and starts[0] == 0:
                raw[:1] = held + raw[:1] * np.uint64(pow(int(_STEP), length, 1 << 64))
                sizes[0] += np.uint64(length)
            else:
                found.append(mixed(held + np.uint64(length)))
            length = 0
        if len(ends) and ends[-1] == len(part):
            held, length = raw[-1:], int(sizes[-1])
            raw, sizes = raw[:-1], sizes[:-1]
        found.append(mixed(raw + sizes))
    if length:
        found.append(mixed(held + np.uint64(length)))
    return np.concatenate(found)


def hashed_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, values of the words of some rows, where each row's words start and end) for all rows, in order.

    Words are what bytes between 0x20 and 0x09-0x0D leave; A-Z are lower-cased; null has no words. What is given
    at once are whole texts of up to CHUNK bytes, or one longer text.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        part = data[offsets[row] : offsets[end]]
        if len(part) > CHUNK:
            values = _long(part)
            yield row, values, np.array([0, len(values)])
        else:
            edges = offsets[row : end + 1] - offsets[row]
            starts, ends, raw = _raw(part, edges)
            yield row, mixed(raw + (ends - starts).astype(np.uint64)), np.searchsorted(starts, edges)
        row = end
