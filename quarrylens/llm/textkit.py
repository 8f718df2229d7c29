"""Vectorised word spans and word hashes over UTF-8 buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; those bytes never occur inside a
multi-byte UTF-8 character, so byte spans and character spans agree.  Word hashes are polynomial
prefix hashes modulo 2**64 over per-byte random values, finished with a 64-bit mixer; they only ever
depend on the bytes of the word, never on the worker, the batch or the Python hash seed.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS = {"fwd": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to n; kept between calls and doubled when too short."""
    if len(_POWERS["fwd"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for key, base in (("fwd", _BASE), ("inv", _INV)):
            out = np.ones(size, np.uint64)
            done = 1
            while done < size:  # out[done:2*done] = out[:done] * base**done
                step = np.uint64(pow(int(base), done, 1 << 64))
                out[done : 2 * done] = out[:done] * step
                done *= 2
            _POWERS[key] = out
    return _POWERS["fwd"], _POWERS["inv"]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift, multiply) so that every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def encode(text: str | None, lower: bool = False) -> bytes:
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    return raw.translate(_LOWER) if lower else raw


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of raw."""
    if not raw:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = np.ones(len(raw) + 2, dtype=bool)
    gap[1:-1] = _SPACE[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    return edges[0::2], edges[1::2]


def span_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each span raw[start:end]; equal bytes give equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    step, lo = 1 << 20, 0  # bounded scratch memory for very long texts
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + step, "right")))
        part = np.frombuffer(raw, np.uint8)[base : int(ends[hi - 1])]
        fwd, inv = _powers(len(part) + 1)
        acc = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * fwd[: len(part)], out=acc[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = mix((acc[e] - acc[s]) * inv[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    raw = encode(text, lower)
    return span_hashes(raw, *word_spans(raw))


def window_hashes(words: np.ndarray, k: int, factor: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of every run of k consecutive word hashes (ordered); empty if there are fewer than k.

    Another odd factor gives another hash of the same runs."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for i in range(k):
        acc = acc * np.uint64(factor) + words[i : i + n]
    return mix(acc + np.uint64(k))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; fewer words than k count as one shingle, none as the empty set."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(words, min(k, len(words))))
