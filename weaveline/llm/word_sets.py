"""Sets of word shingles as sorted 64-bit hashes, computed for whole batches of texts at once."""

from __future__ import annotations

import re

import numpy as np

from .shared import FOLD

WORDS = 5
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_SPACE = re.compile(rb"[\t-\r ]")
_FOLD = np.frombuffer(FOLD, np.uint8)
_RNG = np.random.default_rng(20240117)
_VALUE = _RNG.integers(1, 2**63, 256, np.uint64) * 2 + 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_WEIGHT = _RNG.integers(1, 2**63, WORDS + 1, np.uint64) * 2 + 1
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16, 2 * len(have) if have is not None else 0)
        out = np.ones(size, np.uint64)
        done = 1
        while done < size:  # double what is there
            step = min(done, size - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 2**64))
            done += step
        _powers[base] = have = out
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] (bytes), equal for equal ranges wherever they lie."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * powers(_BASE, len(data))[: len(data)], out=total[1:])
    h = (total[end] - total[start]) * powers(_INVERSE, len(data) + 1)[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: Bytes of texts that are cut into words at a time.
PIECE = 4 << 20


def _pieces(texts: list[bytes]):
    """(text number, offset, bytes) with long texts cut at white space; a longer run without any stays whole."""
    for i, text in enumerate(texts):
        lo = 0
        while len(text) - lo > PIECE:
            cut = _SPACE.search(text, lo + PIECE)
            hi = cut.start() if cut else len(text)
            yield i, lo, text[lo:hi]
            lo = hi
        yield i, lo, text[lo:] if lo else text


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, word hash, start byte in its text, end byte) of every word, A-Z lower-cased."""
    if sum(map(len, texts)) <= PIECE:
        return _words_of(texts)
    out, held, size = [], [], 0

    def drain():
        owner, word, start, end = _words_of([t for _, _, t in held])
        number, offset = (np.array([h[k] for h in held], np.int64) for k in (0, 1))
        out.append((number[owner], word, start + offset[owner], end + offset[owner]))

    for piece in _pieces(texts):
        if held and size + len(piece[2]) > PIECE:
            drain()
            held, size = [], 0
        held.append(piece)
        size += len(piece[2])
    drain()
    return tuple(np.concatenate(x) for x in zip(*out))


def _words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = _FOLD[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
    gap = _GAP[data]
    start = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    first = np.cumsum([1, *[len(t) + 1 for t in texts]])
    owner = np.searchsorted(first, start, "right") - 1
    return owner, range_hashes(data, start, end), start - first[owner], end - first[owner]


def shingles(owner: np.ndarray, words: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, index of its first word); a shorter text is one shingle."""
    who, h, at = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) >= n:
        at = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
        who = owner[at]
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h += words[at + k] * _WEIGHT[k]
    counts = np.bincount(owner, minlength=1) if len(owner) else np.zeros(0, np.int64)
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):
        first = np.searchsorted(owner, few)
        short = np.zeros(len(few), np.uint64)
        for k in range(n - 1):
            has = counts[few] > k
            short[has] += words[first[has] + k] * _WEIGHT[k]
        short += counts[few].astype(np.uint64) * _WEIGHT[n]
        who, h, at = np.concatenate([who, few]), np.concatenate([h, short]), np.concatenate([at, first])
    return who, mix(h), at


def hash_windows(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each of the places on."""
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words) * powers(_BASE, len(words))[: len(words)], out=total[1:])
    return mix((total[at + n] - total[at]) * powers(_INVERSE, len(words) + 1)[at])


def _sets_of(part: list[bytes]) -> list[np.ndarray]:
    owner, words, _, _ = words_of(part)
    who, h, _ = shingles(owner, words)
    h = h >> np.uint64(1)
    order = np.lexsort((h, who))
    who, h = who[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    who, h = who[new], h[new]
    cut = np.searchsorted(who, np.arange(len(part) + 1))
    return [h[a:b] for a, b in zip(cut[:-1], cut[1:])]


def sets_of(texts: list[bytes], most_texts: int = 64, most_bytes: int = 1 << 20) -> list[np.ndarray]:
    """For each text its distinct shingles, ascending (63-bit hashes); so many texts or bytes are worked on at a time, or one longer text."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    size = 0
    for text in texts:
        if part and (len(part) == most_texts or size + len(text) > most_bytes):
            out.extend(_sets_of(part))
            part, size = [], 0
        part.append(text)
        size += len(text)
    return out + (_sets_of(part) if part else [])
