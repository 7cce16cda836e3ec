"""Array helpers that the text operators run inside Spark tasks.

Texts arrive as Arrow batches. A batch is looked at as one byte buffer plus document offsets, so
that splitting into words, hashing and counting are array operations over a few MB at a time and
no Python loop runs per word. Hashes are 64 bits over randomised byte values.
"""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text looked at together; a longer document is looked at alone.
PART_BYTES = 1 << 20
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=U)
_P = U(0x9E3779B97F4A7C15 | 1)
_PINV = U(pow(int(_P), -1, 2**64))
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = [np.ones(1, U), np.ones(1, U)]


def _power(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0 .. n - 1 of the hash base, or of its inverse."""
    k = int(inverse)
    if len(_powers[k]) < n:
        step = np.full(max(n, PART_BYTES + (PART_BYTES >> 2)), _PINV if inverse else _P, U)
        step[0] = 1
        _powers[k] = np.multiply.accumulate(step)
    return _powers[k][:n]


def release() -> None:
    """Gives memory that was freed back to the system, for Spark keeps Python workers for later stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def released(f):
    """A function for mapInArrow or applyInArrow that releases memory after its task's or group's work."""
    if inspect.isgeneratorfunction(f):

        def run(batches):
            yield from f(batches)
            release()

    else:

        def run(table):
            out = f(table)
            release()
            return out

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every bit of a 64-bit value over all others."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data else np.zeros(0, np.uint8)
    return buf, off - off[0]


def parts(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = PART_BYTES) -> Iterator[tuple]:
    """Slices of the batches with about `limit` bytes of text: (batch, bytes, offsets)."""
    for batch in batches:
        column = batch.column(batch.schema.names.index(text))
        if not len(column):
            continue
        _, off = flat(column)
        lo = 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
            piece = batch.slice(lo, hi - lo)
            yield piece, *flat(column.slice(lo, hi - lo))
            lo = hi


def runs(flag: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of set bytes that don't cross a document's edge."""
    n = len(flag)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0], before[1:] = False, flag[:-1]
    before[off[:-1][off[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, flag[1:]
    ends = off[1:][off[1:] > 0] - 1
    after[ends] = False
    return np.flatnonzero(flag & ~before), np.flatnonzero(flag & ~after) + 1


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words `[^\\x20\\x09-\\x0D]+`."""
    s, e = runs(IS_WORD[buf], off)
    return s, e, np.searchsorted(off, s, "right") - 1


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """h where h[e] - h[s] is the hash of bytes s .. e, times the base to the power s."""
    h = np.zeros(len(buf) + 1, U)
    np.cumsum(_BYTE[buf] * _power(len(buf)), out=h[1:])
    return h


def hash_spans(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the spans; equal bytes have equal hashes wherever they stand."""
    if not len(s):
        return np.zeros(0, U)
    return mix((h[e] - h[s]) * _power(len(h), True)[s] + (e - s).astype(U))


def word_hashes(buf: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple:
    """(hashes, document numbers, starts, ends) of all words."""
    s, e, d = words(buf, off)
    return hash_spans(prefix_hash(LOWER[buf] if lower else buf), s, e), d, s, e


def windows(h: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row and the index of the first; none crosses a document."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(d[:n] == d[k - 1 :])
    out = np.zeros(len(at), U)
    for j in range(k):
        out = out * _P + h[at + j]
    return mix(out), at


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document numbers, hashes), sorted: each document's distinct k-word shingles.

    A document with 1 to k - 1 words has its whole sequence as the one shingle.
    """
    h, d, _, _ = word_hashes(buf, off)
    w, at = windows(h, d, k)
    doc = d[at]
    count = np.bincount(d, minlength=len(off) - 1)
    for x in np.flatnonzero((count > 0) & (count < k)):
        lo, hi = np.searchsorted(d, [x, x + 1])
        one = np.zeros(1, U)
        for v in h[lo:hi]:
            one = one * _P + v
        w, doc = np.append(w, mix(one + U(count[x]))), np.append(doc, x)
    order = np.lexsort((w, doc))
    w, doc = w[order], doc[order]
    first = np.ones(len(w), bool)
    first[1:] = (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])
    return doc[first], w[first]


def to_binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary cell per row: `counts` consecutive values each."""
    values = np.ascontiguousarray(values)
    off = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * values.itemsize
    big = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(off), pa.py_buffer(values)])
    return big.cast(pa.binary())


def own_ids(ids: np.ndarray, doc: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids of the documents that occur in `doc`, and `doc` as places among these; so a cell holds no ids but its own."""
    own, at = np.unique(doc, return_inverse=True)
    return ids[own].astype("<i8").tobytes(), at


def repeated(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Flags of the entries whose key occurs again in their document."""
    if not len(key):
        return np.zeros(0, bool)
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
