"""Vectorised helpers over UTF-8 text held in Arrow buffers.

Used inside ``mapInArrow`` tasks: a batch's text column already is one byte
buffer with offsets, so words, shingles and rolling hashes of many documents
are computed with a few numpy passes and no Python string.  Work is cut into
slices of about ``SLICE_BYTES`` so memory does not grow with the batch; it
grows with the longest single document only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.default_rng(20240607)
#: a random 64-bit value for each byte (fixed seed: hashes are the same on every executor)
BYTE_CODES = _rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * _U(2) + _U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_spaces = np.zeros(256, bool)
_spaces[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: words are runs of anything but the six ASCII white-space characters
WORD_BY_SPACE = ~_spaces
#: words are runs of ASCII letters and digits and of all non-ASCII characters
WORD_ALNUM = np.ones(256, bool)
WORD_ALNUM[0x00:0x30] = WORD_ALNUM[0x3A:0x61] = WORD_ALNUM[0x7B:0x80] = False

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        for i, base in enumerate((_BASE, _BASE_INV)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection whose output bits all depend on all input bits)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def text_column(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    arr = batch.column(batch.schema.get_field_index(name))
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    big = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    if not len(arr) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if big else np.int32)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Consecutive row ranges [i, j) of at most ``limit`` bytes (one row at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Running polynomial sums: the hash of [a, b) is (P[b] - P[a]) * inverse power of a."""
    power, _ = _power_tables(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * power[:len(codes)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the codes in each [start, end), independent of where it stands."""
    _, inverse = _power_tables(len(prefix) + 1)
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


class Words:
    """Words of consecutive documents: start, end (byte positions), document index, hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = WORD_BY_SPACE):
        n = len(data)
        inside = word_bytes[LOWER[data]]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = False, False
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            cut = offsets[(offsets > 0) & (offsets < n)]
            before[cut] = False
            after[cut - 1] = False
        self.data, self.offsets = data, offsets
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)        # word range of each document
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)
        prefix = prefix_hash(BYTE_CODES[LOWER[data]])
        self.hash = range_hash(prefix, self.start, self.end)

    def shingles(self, k: int, hashes: np.ndarray | None = None, whole_if_short: bool = True):
        """(document index, 64-bit hash) of every run of ``k`` words; a document with
        fewer words (but at least one) gives its whole sequence as one shingle."""
        h = self.hash if hashes is None else hashes
        n = len(h)
        if n >= k:
            acc = h[:n - k + 1].copy()
            for i in range(1, k):
                acc = mix(acc * _U(3) + h[i:n - k + 1 + i])
            ok = self.doc[:n - k + 1] == self.doc[k - 1:]
            doc, value = self.doc[:n - k + 1][ok], acc[ok]
        else:
            doc, value = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if whole_if_short:
            short = np.flatnonzero((self.counts > 0) & (self.counts < k))
            extra = np.empty(len(short), np.uint64)
            for j, d in enumerate(short):
                acc = _U(self.counts[d])
                with np.errstate(over="ignore"):
                    for x in h[self.first[d]:self.first[d + 1]]:
                        acc = mix(np.array([acc * _U(5) + x], np.uint64))[0]
                extra[j] = acc
            doc, value = np.concatenate([doc, short]), np.concatenate([value, extra])
        return doc, value


def distinct_per_doc(doc: np.ndarray, value: np.ndarray, n_docs: int):
    """Distinct values of each document, sorted by (document, value): (doc, value, offsets)."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[keep], value[keep]
    return doc, value, np.searchsorted(doc, np.arange(n_docs + 1))


def slice_text(data: np.ndarray, offsets: np.ndarray, i: int, j: int):
    return data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
