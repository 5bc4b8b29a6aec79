"""Sets of word shingles as sorted 64-bit hashes, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Odd 64-bit constants of multiplicative hashes (fixed values).
MIX = np.uint64(0x94D049BB133111EB)
_MIX_A, _STEP = np.uint64(0xBF58476D1CE4E5B9), 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX
    return x ^ (x >> np.uint64(31))


# A number for each byte; A-Z have those of a-z.
_BYTE = mix(np.array([(b + 32 if 65 <= b <= 90 else b) * _STEP % 2**64 for b in range(256)], np.uint64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse (mod 2 to 64) up to ``n``; those up to 4 million stay for the next call."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = 1 << max(16, (n - 1).bit_length())
    both = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)]), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    if size <= 1 << 22:
        _powers[:] = both
    return both[0], both[1]


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins, ends and 64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of UTF-8 bytes, with A-Z lower-cased."""
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = edges[::2], edges[1::2]
    power, inverse = _grow(len(data) + 1)
    # The polynomial of a word's bytes, from the running sum over all bytes.
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    return begins, ends, mix((total[ends] - total[begins]) * inverse[begins] + (ends - begins).astype(np.uint64) * MIX)


def shingle_sets(texts: pa.Array | list, n_words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a shorter text is one shingle, one without words, or a null, has none."""
    texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
    if not len(texts):
        return []
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):  # about a megabyte at once
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 20), side="right")) - 1)
        out += _sets(raw[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at], n_words)
        at = stop
    return out


def _sets(data: np.ndarray, offsets: np.ndarray, n_words: int) -> list[np.ndarray]:
    # A space between two texts, so that no word runs across.
    shifted = offsets + np.arange(len(offsets))
    spaced = np.full(len(data) + len(offsets) - 1, 32, np.uint8)
    spaced[np.arange(len(data)) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))] = data
    begins, _, words = words_of(spaced)
    first = np.searchsorted(begins, shifted)
    whole = _joined(words, n_words)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        out.append(np.unique(whole[a : b - n_words + 1]) if b - a >= n_words else _joined(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _joined(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0 or not width:
        return np.zeros(0, np.uint64)
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total += mix(words[i : n + i] * np.uint64((_STEP * (2 * i + 3) + 2 * width) % 2**64 | 1))
    return mix(total)


def shingle_set(text: str | None, n_words: int) -> np.ndarray:
    return shingle_sets([text], n_words)[0]
