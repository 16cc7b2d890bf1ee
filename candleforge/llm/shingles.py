"""Vectorised word and shingle hashing over whole texts.

A word is a maximal run of bytes outside space and ``\\x09-\\x0D``, with A-Z
lower-cased. Hashes have 64 bits and depend on the words only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_STEP = 0x9E3779B97F4A7C55
_INVERSE = pow(_STEP, -1, 2**64)
_PIECE = 1 << 20

_BYTE = np.random.default_rng(20240917).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + np.random.default_rng(5).integers(0, 2, 256, dtype=np.uint64)
_EXACT = _BYTE.copy()
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, _PIECE + 4096)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * _PIECE:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def pieces(data: bytes) -> Iterator[bytes]:
    """``data`` cut behind white space into pieces of bounded length (a longer word stays whole)."""
    view = np.frombuffer(data, np.uint8)
    at = 0
    while len(view) - at > _PIECE:
        end = at + _PIECE
        while end < len(view):
            gap = np.flatnonzero(_SPACE[view[end : end + 65536]])
            if len(gap):
                end += int(gap[0]) + 1
                break
            end = min(len(view), end + 65536)
        yield data[at:end]
        at = end
    yield data[at:]


def word_spans(data: bytes, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start offsets, end offsets and hashes of the words of ``data``; without ``fold``, A-Z differ from a-z."""
    starts, ends, hashes, base = [], [], [], 0
    table = _BYTE if fold else _EXACT
    for piece in pieces(data):
        buf = np.frombuffer(piece, np.uint8)
        if len(buf):
            space = _SPACE[buf]
            turn = np.flatnonzero(space[1:] != space[:-1]) + 1
            turn = np.concatenate(([0] if not space[0] else [], turn, [len(buf)] if not space[-1] else [])).astype(np.int64)
            s, e = turn[0::2], turn[1::2]
            total = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum(table[buf] * _power(_STEP, len(buf)), out=total[1:])
            starts.append(s + base)
            ends.append(e + base)
            hashes.append(mix((total[e] - total[s]) * _power(_INVERSE, len(buf))[s]))
        base += len(piece)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(starts or none), np.concatenate(ends or none), np.concatenate(hashes or [np.zeros(0, np.uint64)])


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of ``data``."""
    starts, _, hashes = word_spans(data)
    return starts, hashes


def text_groups(texts: list[bytes | None], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts have about ``most`` bytes together; a longer text stands alone."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if total and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(texts):
        yield at, len(texts)


def shingle_sets(texts: list[bytes | None], width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    With fewer words the whole sequence is one shingle; without words (or text)
    the set is empty.
    """
    for lo, hi in text_groups(texts):
        part = [t or b"" for t in texts[lo:hi]]
        ends = np.cumsum([len(t) + 1 for t in part])
        start, h = word_hashes(b"\n".join(part) + b"\n")
        first = np.searchsorted(start, np.concatenate(([0], ends[:-1])))
        last = np.concatenate((first[1:], [len(h)]))
        n = max(0, len(h) - width + 1)
        sh = h[:n].copy()
        for k in range(1, width):
            sh = sh * _U(0x9FB21C651E98DF25) + h[k : n + k]
        sh = mix(sh + _U(width))
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if b - a >= width:
                one = np.sort(sh[a : b - width + 1])
                keep = np.ones(len(one), bool)
                np.not_equal(one[1:], one[:-1], out=keep[1:])
                yield one[keep]
            elif b > a:
                whole = _U(b - a)
                for w in h[a:b]:
                    whole = mix(np.array([whole], np.uint64) * _U(0x9FB21C651E98DF25) + w)[0]
                yield np.array([whole], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
