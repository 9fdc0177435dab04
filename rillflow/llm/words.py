"""Words of many texts at a time, as 64-bit hashes in numpy arrays.

A word's hash is a polynomial of its bytes modulo 2**64, taken from prefix sums over the buffer and
mixed at the end; words of different lengths differ as every byte counts at least one. Memory is bounded:
texts go through in chunks of about ``CHUNK`` bytes, and a longer text is cut between words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)
_BASE = 0xD6E8FEB86659FD93


class _Cache(dict):
    """Travels to executors empty."""

    def __reduce__(self):
        return _Cache, ()


_powers = _Cache()


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        row = np.full(max(n, 2 * CHUNK), base, np.uint64)
        row[0] = 1
        have = _powers[base] = np.cumprod(row, dtype=np.uint64)
    return have[:n]


class Alphabet:
    """Which bytes belong to words, and whether A-Z count as a-z."""

    def __init__(self, word: list[int], fold: bool):
        self.word = bytes(int(b in set(word)) for b in range(256))
        self.fold = fold


#: Runs of anything but ASCII white space; A-Z lower-cased, or as they are.
_SPACE = {0x20, *range(0x09, 0x0E)}
PLAIN_FOLDED = Alphabet([b for b in range(256) if b not in _SPACE], True)
PLAIN = Alphabet([b for b in range(256) if b not in _SPACE], False)
#: Runs of letters and digits (any byte beyond ASCII counts as a letter), A-Z lower-cased.
ALNUM_FOLDED = Alphabet([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)], True)


def _hashes(raw: bytes, alphabet: Alphabet, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last) of each word in a buffer.

    With stems, the hashes have a row for whole words and one for the first so many bytes of each.
    """
    n = len(raw)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = np.frombuffer(raw.translate(alphabet.word), np.int8)
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(n + 1, np.uint64)
    value = np.frombuffer(raw.lower() if alphabet.fold else raw, np.uint8).astype(np.uint64)
    value += np.uint64(1)
    value *= _power(_BASE, n)
    np.cumsum(value, out=sums[1:])
    back = _power(pow(_BASE, -1, 1 << 64), n + 1)[starts]
    h = (sums[ends] - sums[starts]) * back
    if stems:
        h = np.stack([h, *[(sums[np.minimum(ends, starts + k)] - sums[starts]) * back + np.uint64(k) for k in stems]])
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29)), starts, ends


def _pieces(text: bytes, alphabet: Alphabet) -> Iterator[bytes]:
    """A long text in pieces that end between words."""
    at = 0
    while at < len(text):
        end = min(len(text), at + CHUNK)
        while end < len(text) and alphabet.word[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def _groups(texts: list[bytes], alphabet: Alphabet, stems: tuple[int, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of the words of some texts, where each text's words begin and the last one's end); see ``_hashes``."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > CHUNK:
            h = np.concatenate([_hashes(p, alphabet, stems)[0] for p in _pieces(texts[at], alphabet)], axis=-1)
            yield h, np.array([0, h.shape[-1]])
            at += 1
            continue
        end, total = at, 0
        while end < len(texts) and total + len(texts[end]) <= CHUNK:
            total += len(texts[end]) + 1
            end += 1
        group = texts[at:end]
        h, starts, _ = _hashes(b"\n".join(group), alphabet, stems)
        begin = np.cumsum([0] + [len(t) + 1 for t in group])
        yield h, np.searchsorted(starts, begin)
        at = end


def word_hashes(texts: list[bytes], alphabet: Alphabet) -> Iterator[np.ndarray]:
    """For each text in turn, the hashes of its words in order."""
    for h, cut in _groups(texts, alphabet):
        for i in range(len(cut) - 1):
            yield h[cut[i] : cut[i + 1]]


def shingles(texts: list[bytes], alphabet: Alphabet, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text in turn, the hashes of its words and of its runs of ``size`` words (see ``windows``)."""
    for h, cut in _groups(texts, alphabet):
        s = windows(h, size)
        for i in range(len(cut) - 1):
            own = h[cut[i] : cut[i + 1]]
            yield own, s[cut[i] : cut[i + 1] - size + 1] if len(own) >= size else windows(own, size)


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; of the whole sequence if it is shorter; empty if empty."""
    if not len(h):
        return h
    size = min(size, len(h))
    n = len(h) - size + 1
    s = h[:n] + np.uint64(size)
    for j in range(1, size):
        s = s * _MIX + h[j : n + j]
        s ^= s >> np.uint64(31)
    s *= _MIX2
    return s ^ (s >> np.uint64(32))


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    if len(h) < 2:
        return h
    s = np.sort(h)
    return s[np.concatenate(([True], s[1:] != s[:-1]))]
