"""Words and signs of texts as hashes, by numpy over code points: no string is made for any of them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np

_SYMBOLS, _WORDS = re.compile(r"\w+|[^\w\s]"), re.compile(r"\w+")
#: Characters that are turned into symbols at once.
_CHUNK = 1 << 20
#: An odd number whose multiples spread.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def symbols(text: str | None) -> list[str]:
    """Words and single signs of a text, lower case."""
    return _SYMBOLS.findall(text.lower()) if text else []


def words(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number turned into a random-looking one, reversibly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """(class, random number) by code point: class 0 for white space, 1 within words, 2 for a sign."""
    kinds = bytes(0 if c.isspace() else 1 if c.isalnum() or c == "_" else 2 for c in map(chr, range(0x110000)))
    return np.frombuffer(kinds, np.uint8), mixed((np.arange(0x110000, dtype=np.uint64) + np.uint64(1)) * GOLDEN)


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of about _CHUNK characters, parted at blanks only."""
    at = 0
    while len(text) - at > 2 * _CHUNK:
        end = max(text.find(" ", at + _CHUNK), text.find("\n", at + _CHUNK, at + 2 * _CHUNK))
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def _hashed(texts: list[str], signs: bool) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(t) + 1 for t in texts])
    codes = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, numbers = _alphabet()
    kind = kinds[codes]
    inside = kind == 1
    begins = kind == 2 if signs else np.zeros(len(kind), bool)
    begins[0] |= inside[0]
    begins[1:] |= inside[1:] & ~inside[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    held = np.flatnonzero(kind if signs else inside)
    place = held - starts[np.cumsum(begins)[held] - 1]
    turns = mixed((np.arange(int(place.max()) + 1, dtype=np.uint64) + np.uint64(77)) * GOLDEN) | np.uint64(1)
    values = np.zeros(len(codes), np.uint64)
    values[held] = numbers[codes[held]] * turns[place]
    return mixed(np.add.reduceat(values, starts)), np.bincount(np.searchsorted(ends, starts, "right"), minlength=len(texts))


def symbol_hashes(texts: list[str], signs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each symbol of the texts one after the other, number of symbols of each text); of words only without signs."""
    pieces = [(k, p) for k, t in enumerate(texts) for p in _pieces(t.lower())]
    hashes, counts, at = [np.empty(0, np.uint64)], np.zeros(len(texts), np.int64), 0
    while at < len(pieces):
        end, size = at, 0
        while end < len(pieces) and (end == at or size + len(pieces[end][1]) <= _CHUNK):
            size += len(pieces[end][1])
            end += 1
        h, n = _hashed([p for _, p in pieces[at:end]], signs)
        hashes.append(h)
        np.add.at(counts, [k for k, _ in pieces[at:end]], n)
        at = end
    return np.concatenate(hashes), counts
