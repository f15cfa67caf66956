"""Vectorised work on UTF-8 bytes: documents stay in Arrow buffers and are handled in blocks of about a megabyte."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256).astype(U) * U(2) + U(1)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_pow: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** (0..n-1) modulo 2 ** 64."""
    have = _pow.get(base)
    if have is None or len(have) < n:
        m = max(n, BLOCK + 4096)
        out = np.full(m, base % (1 << 64), U)
        out[0] = 1
        have = _pow[base] = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(buf: np.ndarray, off: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents of about limit bytes; a longer document comes alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def lowered(buf: np.ndarray) -> np.ndarray:
    return np.frombuffer(buf.tobytes().translate(LOWER), np.uint8)


def lut(word) -> np.ndarray:
    return np.array([bool(word(b)) for b in range(256)])


NOT_SPACE = lut(lambda b: b != 32 and not 9 <= b <= 13)
ALNUM = lut(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


def spans(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of set bytes, cut at document bounds, and the first run of each document (one more at the end)."""
    if not len(mask):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    st, en = mask.copy(), mask.copy()
    st[1:] &= ~mask[:-1]
    en[:-1] &= ~mask[1:]
    b = off[:-1][np.diff(off) > 0]
    st[b] = mask[b]
    last = off[1:][np.diff(off) > 0] - 1
    en[last] = mask[last]
    s = np.flatnonzero(st)
    return s, np.flatnonzero(en) + 1, np.searchsorted(s, off)


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash modulo 2 ** 64."""
    out = np.empty(len(buf) + 1, U)
    out[0] = 0
    np.cumsum(BYTE[buf] * powers(_P, len(buf)), out=out[1:])
    return out


def span_hash(pre: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix((pre[e] - pre[s]) * powers(_PINV, len(pre))[s])


def hash_spans(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """span_hash() of disjoint spans in order, with prefix sums of about BLOCK bytes at a time, however long buf is."""
    if len(buf) <= 2 * BLOCK:
        return span_hash(prefix(buf), s, e)
    out, i = np.empty(len(s), U), 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + BLOCK, "right")))
        a, z = int(s[i]), int(e[j - 1])
        if z - a <= 2 * BLOCK:
            out[i:j] = span_hash(prefix(buf[a:z]), s[i:j] - a, e[i:j] - a)
        else:  # one span longer than that
            total = 0
            for k in range(a, z, BLOCK):
                total += int(prefix(buf[k : min(k + BLOCK, z)])[-1]) * pow(_P, k - a, 1 << 64)
            out[i : i + 1] = mix(np.array([total % (1 << 64)], U))
        i = j
    return out


def cuts(buf: np.ndarray, limit: int = BLOCK) -> list[int]:
    """0, the places of separators near each multiple of limit, and the end of buf: pieces that cut no word. A longer word stays whole."""
    gap = np.flatnonzero(~NOT_SPACE[buf])
    out = [0]
    while len(buf) - out[-1] > limit:
        at = np.searchsorted(gap, out[-1] + limit, "right") - 1
        at = at if at >= 0 and gap[at] > out[-1] else at + 1
        if at >= len(gap):
            break
        out.append(int(gap[at]))
    return [*out, len(buf)]


def word_hashes(buf: np.ndarray, off: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, starts and ends of words, and each document's first word."""
    s, e, first = spans(mask[buf], off)
    return hash_spans(buf, s, e), s, e, first


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each word; the last n - 1 lack some."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = h[:m].copy()
    for k in range(1, n):
        out *= U(0xD6E8FEB86659FD93)
        out += h[k : k + m]
    return mix(out)
