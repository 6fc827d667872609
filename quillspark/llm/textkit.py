"""Vectorised text kernels over the byte buffers of Arrow string columns."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(20240229)
#: A random odd-free value for each byte, and the base of the polynomial hash.
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_TABLES: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if "p" not in _TABLES or len(_TABLES["p"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("p", _BASE), ("i", _BASE_INV)):
            out = np.ones(size, dtype=U64)
            done, step = 1, base
            while done < size:
                out[done : 2 * done] = out[:done] * U64(step)
                done, step = 2 * done, step * step % 2**64
            _TABLES[key] = out
    return _TABLES["p"], _TABLES["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; modular arithmetic, so overflow is meant."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, size: int = 1 << 19):
    """Row ranges whose bytes come to about ``size``; one longer row stands alone."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, side="right")) - 1)
        yield at, to
        at = to


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` that don't cross the rows' bounds."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    heads = offs[:-1][offs[:-1] < offs[1:]]
    first[heads] = inside[heads]
    tails = heads[1:] - 1
    last[tails] = inside[tails]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] equal to base**i times the hash of bytes i..j-1."""
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(BYTE_VALUE[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span's bytes, wherever it stands."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts])


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = 1 << 19) -> np.ndarray:
    """``span_hash`` of short spans in order of their starts, with bounded memory."""
    out, i = np.zeros(len(starts), U64), 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, low + size)))
        prefix = prefix_hash(data[low : int(ends[i:j].max())])
        out[i:j] = span_hash(prefix, starts[i:j] - low, ends[i:j] - low)
        i = j
    return out


def word_hashes(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows (A-Z lower-cased) and the offset of each row's first word."""
    low = LOWER[data]
    starts, ends = spans(~space[low], offs)
    return span_hash(prefix_hash(low), starts, ends), np.searchsorted(starts, offs)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct hashes of one row's k-word shingles; fewer words make one shingle."""
    if not len(words):
        return words
    if len(words) < k:
        parts, count = [words[i : i + 1] for i in range(len(words))], len(words)
    else:
        parts, count = [words[i : len(words) - k + 1 + i] for i in range(k)], k
    acc = np.zeros(len(parts[0]), dtype=U64)
    for part in parts:
        acc = acc * U64(0xD6E8FEB86659FD93) + part
    acc = np.sort(mix(acc + U64(count)))
    return acc[np.concatenate(([True], acc[1:] != acc[:-1]))]


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and, for each, the smallest node it is joined with by the edges u-v."""
    nodes, inv = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = inv[: len(u)], inv[len(u) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        if np.array_equal(low, high):
            return nodes, nodes[label]
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def short(keys: np.ndarray) -> np.ndarray:
    """The upper 48 bits of each hash, as 6 bytes."""
    return np.ascontiguousarray((keys >> U64(16)).view(np.uint8).reshape(-1, 8)[:, :6])


def unshort(parts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(parts) // 6, 8), np.uint8)
    out[:, :6] = parts.reshape(-1, 6)
    return out.view(U64).reshape(-1)


def release() -> None:
    """Give freed memory back: workers stay, and other stages share their executors' limit."""
    _TABLES.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        return
