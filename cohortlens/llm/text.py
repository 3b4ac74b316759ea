"""Word shingles of whole texts as sorted 64-bit hashes, with numpy over the bytes of one text."""

from __future__ import annotations

import hashlib

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SEED, _ODD = np.uint64(0x8E9D5AA3C4B1F267), np.uint64(0x9E3779B97F4A7C15)
#: What a chunk of 0 to 8 bytes keeps of eight bytes read, and the bytes from which a word is hashed by itself.
_KEPT = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], np.uint64)
LONG_WORD = 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _step(x: np.ndarray) -> np.ndarray:
    x = x * _ODD
    return x ^ (x >> np.uint64(29))


def _words(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each word, eight bytes a step; every step multiplies, shifts and so is not linear in the bytes."""
    padded = np.append(raw, np.zeros(8, np.uint8))
    eights = np.ndarray((len(raw) + 1,), np.dtype("<u8"), padded, 0, (1,))  # the eight bytes from each place on
    out = length.astype(np.uint64) * _SEED
    at, left, live = start, np.where(length > LONG_WORD, 0, length), slice(None)
    while len(at):
        out[live] = _step(out[live] ^ (eights[at] & _KEPT[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        live = more if isinstance(live, slice) else live[more]
        at, left = at[more] + 8, left[more] - 8
    out = _mix(out)
    for k in np.flatnonzero(length > LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(raw[start[k] : start[k] + length[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes (uint64) of the windows of ``width`` words, A-Z lower-cased.

    Words are maximal runs without ``[\\x20\\x09-\\x0D]``.  A text with fewer words than ``width``
    has its whole word sequence as one shingle; one without words, or null, has none.
    A window's hash is that of its words' hashes, taken in one after the other.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    word = _words(raw, start, end - start)
    span = min(width, len(word))
    n = len(word) - span + 1
    total = np.full(n, span, np.uint64)
    for k in range(span):
        total = _step(total ^ word[k : k + n])
    total = np.sort(_mix(total))
    return total[np.append(True, total[1:] != total[:-1])]


def fingerprint(tokens: np.ndarray) -> bytes:
    """128 bits that name a set of shingles; equal sets have equal ones."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def bitmap(tokens: np.ndarray) -> bytes:
    """Token bitmap of a power-of-two width near twice the set's size (64 to 65,536 bits), little-endian."""
    width = 1 << min(16, max(6, int(2 * len(tokens)).bit_length()))
    bits = np.zeros(width, dtype=np.uint8)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()
