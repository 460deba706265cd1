"""Splitting many texts into pre-tokens at once, as numpy arrays.

The pattern is that of byte-level vocabularies (public_tokenizers.PATTERN): contractions, runs of letters, of
numbers or of other characters with at most one space before them, and white space. Its matches depend on the
class of each character and its neighbours alone, so the starts of all matches follow from comparing arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

LETTER, NUMBER, OTHER, SPACE, END = range(5)
#: Unicode's White_Space, as ranges.
WHITE = ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
#: What may follow an apostrophe that begins a match.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
BASE = np.uint64(0x9E3779B97F4A7C15)


@cache
def classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            chars = np.frombuffer(m[0].encode("utf-32-le"), np.uint32)
            table[chars] = kind
    for a, b in WHITE:
        table[a : b + 1] = SPACE
    return table


@cache
def _powers(n: int) -> np.ndarray:
    x = np.full(n, BASE, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


def powers(n: int) -> np.ndarray:
    """The first n powers of BASE modulo 2**64; sizes are rounded up so that few arrays are kept."""
    return _powers(1 << max(16, (n - 1).bit_length()))[:n]


@dataclass
class Split:
    """Pre-tokens of a list of texts: text[start:end] of joined, in order, and which text each is of."""

    joined: str
    codes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray


def split(texts: list[str]) -> Split:
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    kind = classes()[codes]
    kind[ends] = END
    n = len(codes)
    first = np.empty(n + 1, bool)
    first[0] = first[n] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:n])
    first[ends] = True
    first[ends + 1] = True
    # the last white space before a word is a match of its own, or belongs to the word if it is a space
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE))
    first[last] = True
    first[last[codes[last] == 32] + 1] = False
    # contractions: the apostrophe begins its match and a letter follows
    quote = np.flatnonzero(codes[:-1] == 39)
    quote = quote[first[quote] & (kind[quote + 1] == LETTER)]
    if len(quote):
        a = codes[quote + 1]
        b = codes[np.minimum(quote + 2, n - 1)]
        for tail in ENDINGS:
            hit = a == ord(tail[0])
            if len(tail) == 2:
                hit &= b == ord(tail[1])
            at = quote[hit]
            first[at + 1] = False
            first[at + 1 + len(tail)] = True
    bounds = np.flatnonzero(first)
    start, end = bounds[:-1], bounds[1:]
    real = kind[start] != END
    start, end = start[real], end[real]
    return Split(joined, codes, start, end, np.searchsorted(ends, start))


def distinct(s: Split) -> tuple[np.ndarray, np.ndarray]:
    """(index of one occurrence of each distinct pre-token, for each pre-token the number of its distinct one)."""
    if not len(s.start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(s.codes)
    for salt in range(1, 9):
        pw = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((s.codes.astype(np.uint64) + np.uint64(salt * 0x1F123BB5)) * pw[:n], out=total[1:])
        h = (total[s.end] - total[s.start]) * pw[n - s.start]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (s.end - s.start).astype(np.uint64)
        _, rep, number = np.unique(h, return_index=True, return_inverse=True)
        other = rep[number]
        length = s.end - s.start
        if not np.array_equal(length, length[other]):
            continue
        shift = s.start[other] - s.start
        moved = np.repeat(shift, length)
        at = np.repeat(s.start - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(int(length.sum()))
        if np.array_equal(s.codes[at], s.codes[at + moved]):
            return rep, number
    raise ArithmeticError("equal hashes of different pre-tokens under eight seeds")


def cuts(text: str, most: int) -> Iterator[str]:
    """text in pieces of about `most` characters whose pre-tokens are those of the whole.

    A cut goes before white space that follows another character: a match always ends there.
    """
    if len(text) <= most:
        yield text
        return
    kind = classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    safe = np.flatnonzero((kind[1:] == SPACE) & (kind[:-1] != SPACE)) + 1
    at = 0
    while len(text) - at > most:
        i = np.searchsorted(safe, at + most)
        if i == len(safe):
            break
        yield text[at : safe[i]]
        at = int(safe[i])
    yield text[at:]


def slices(texts: list[str], most: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Groups of (numbers of the texts, pieces) of about `most` characters each, in order."""
    number, group, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in cuts(text, most):
            number.append(i)
            group.append(piece)
            size += len(piece) + 1
            if size >= most:
                yield np.array(number), group
                number, group, size = [], [], 0
    if group:
        yield np.array(number), group


def gather(values: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[begin[i]:begin[i]+length[i]] for all i, one after the other."""
    total = int(length.sum())
    before = np.cumsum(length) - length
    return values[np.repeat(begin - before, length) + np.arange(total)]
