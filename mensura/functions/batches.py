"""Helpers for Arrow and pandas batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from mensura.functions.fingerprint import N_BITS, SHIFT


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal keys out of batches that are sorted by them."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[keys].to_numpy()
        starts = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1, [len(pdf)]])
        for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
            part = pdf.iloc[a:b]
            if held and (i or (held[-1][keys].iloc[-1].to_numpy() != k[0]).any()):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def unpack(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(flat positions, offsets) of a list of codes (see functions.fingerprint.code)."""
    flat = np.frombuffer(b"".join(codes), dtype=">u2").astype(np.int32) - SHIFT
    offsets = np.zeros(len(codes) + 1, dtype=np.int64)
    np.cumsum([len(c) // 2 for c in codes], out=offsets[1:])
    return flat, offsets


def packed(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of 64-bit words, number of positions on); the positions of a row are sorted and distinct.

    Read as bytes, a row has its lowest position first (as numpy's packbits has it).
    """
    n = np.diff(offsets)
    words = np.zeros(len(n) * (N_BITS // 64), dtype=np.uint64)
    if len(flat):
        at = np.repeat(np.arange(len(n), dtype=np.int64), n) * (N_BITS // 64) + (flat >> 6)
        bit = np.uint64(1) << ((flat & 56) + 7 - (flat & 7)).astype(np.uint64)
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        words[at[first]] = np.bitwise_or.reduceat(bit, first)
    return words.reshape(len(n), N_BITS // 64), n


def whole(batches: Iterator[pd.DataFrame], keys: list[str], least: int = 10_000) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of ``least`` rows or more that hold whole runs of equal keys, each with the runs' bounds, out of batches sorted by the keys."""
    held: list[pd.DataFrame] = []
    size = 0
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        size += len(pdf)
        if size < least:
            continue
        rows = pd.concat(held) if len(held) > 1 else held[0]
        k = rows[keys].to_numpy()
        starts = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        if not len(starts):  # one run so far
            held = [rows]
            continue
        yield rows.iloc[: starts[-1]], np.concatenate([[0], starts])
        held, size = [rows.iloc[starts[-1] :]], len(rows) - int(starts[-1])
    if held:
        rows = pd.concat(held) if len(held) > 1 else held[0]
        k = rows[keys].to_numpy()
        yield rows, np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1, [len(rows)]])


def pairs_within(bounds: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left, right), left < right: all pairs of rows of one run, in pieces of about ``most`` pairs."""
    size = np.diff(bounds)
    end = np.repeat(bounds[1:], size)
    n = end - np.arange(bounds[0], bounds[-1]) - 1  # partners behind a row
    total = np.cumsum(n)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        own = n[at:to]
        left = np.repeat(np.arange(at, to), own)
        begin = np.cumsum(own) - own
        yield left + bounds[0], left + 1 + np.arange(len(left)) - np.repeat(begin, own) + bounds[0]
        at = to


def pair_similarities(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, left: np.ndarray, right: np.ndarray, block: int = 4096) -> np.ndarray:
    """Tanimoto of the row pairs (left of a, right of b); no row may be empty."""
    out = np.empty(len(left))
    for i in range(0, len(left), block):
        x, y = left[i : i + block], right[i : i + block]
        both = np.bitwise_count(a[x] & b[y]).sum(1, dtype=np.int64)
        out[i : i + block] = both / (na[x] + nb[y] - both)
    return out


def dense(bits: np.ndarray) -> np.ndarray:
    """Rows of words as rows of 0 and 1, for products of whole blocks."""
    return np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1).astype(np.float32)


def similarities(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, block: int = 256) -> np.ndarray:
    """Tanimoto of every row of a with every row of b (0 where the union is empty)."""
    out = np.zeros((len(a), len(b)))
    for i in range(0, len(a), block):
        both = np.bitwise_count(a[i : i + block, None, :] & b[None]).sum(2, dtype=np.int64)
        either = na[i : i + block, None] + nb[None] - both
        np.divide(both, either, out=out[i : i + block], where=either > 0)
    return out


def gaps(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of sorted distinct positions as the steps between them: 255 is added for every byte 255, any other byte ends a step. No row may be empty."""
    if not len(flat):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    step = np.diff(flat, prepend=0)
    step[offsets[:-1]] = flat[offsets[:-1]]
    end = np.cumsum(step // 255 + 1)
    out = np.full(end[-1], 255, dtype=np.uint8)
    out[end - 1] = step % 255
    return out, np.concatenate([[0], end[offsets[1:] - 1]])


def ungaps(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flat positions, offsets) of what ``gaps`` wrote."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)
    ends = data != 255
    total = np.cumsum(data, dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(ends)[at[1:] - 1]])
    before = np.concatenate([[0], total[at[1:-1] - 1]])
    return total[ends] - np.repeat(before, np.diff(offsets)), offsets


def taken(data: np.ndarray, at: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes in another order."""
    if not len(order):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    _, new_at, new = rows.take(pa.array(order)).buffers()
    new_at = np.frombuffer(new_at, dtype=np.int64)[: len(order) + 1]
    return np.frombuffer(new, dtype=np.uint8)[: new_at[-1]], new_at


def between(data: np.ndarray, at: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows i to j of rows of bytes."""
    at = at[i : j + 1]
    return data[at[0] : at[-1]], at - at[0]


def sheet(columns: list[np.ndarray], texts: tuple[np.ndarray, np.ndarray] | None, i: int, j: int) -> bytes:
    """Rows i to j of the columns, and of rows of fewer than 65,536 bytes, as one value. Of int64, the lower halves come first: the upper ones are alike and compress well."""
    halves = lambda c: c.view(np.uint32).reshape(-1, 2).T if c.dtype == np.int64 else c
    out = [np.int64(j - i).tobytes(), *(halves(c[i:j]).tobytes() for c in columns)]
    if texts is not None:
        data, at = texts
        out += [np.diff(at[i : j + 1]).astype(np.uint16).tobytes(), data[at[i] : at[j]].tobytes()]
    return b"".join(out)


def opened(found: bytes, kinds: list[type], texts: bool, at: int = 0) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray] | None, int]:
    """(columns, rows of bytes, end) of the sheet that begins at ``at``."""
    n = int(np.frombuffer(found, dtype=np.int64, count=1, offset=at)[0])
    at += 8
    columns = []
    for kind in [*kinds, np.uint16][: len(kinds) + texts]:
        columns.append(np.frombuffer(found, dtype=kind, count=n, offset=at))
        at += columns[-1].nbytes
        if kind is np.int64:
            columns[-1] = np.ascontiguousarray(columns[-1].view(np.uint32).reshape(2, n).T).view(np.int64).ravel()
    if not texts:
        return columns, None, at
    ends = np.concatenate([[0], np.cumsum(columns.pop(), dtype=np.int64)])
    return columns, (np.frombuffer(found, dtype=np.uint8, count=ends[-1], offset=at), ends), at + int(ends[-1])


def sheets(found: list[bytes], kinds: list[type], texts: bool) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray] | None]:
    """(columns, rows of bytes) of all the sheets."""
    each = [opened(x, kinds, texts) for x in found]
    columns = [np.concatenate([np.zeros(0, dtype=kind), *(e[0][i] for e in each)]) for i, kind in enumerate(kinds)]
    if not texts:
        return columns, None
    size = np.concatenate([np.zeros(0, dtype=np.int64), *(np.diff(e[1][1]) for e in each)])
    return columns, (np.concatenate([np.zeros(0, dtype=np.uint8), *(e[1][0] for e in each)]), np.concatenate([[0], np.cumsum(size)]))
