"""Vectorised tokenisation and hashing of text batches.

Texts are joined into one array of code points and scanned with numpy, a few nanoseconds a
character, so that a worker handles whole Arrow batches without a Python loop over words.

* words: maximal runs of letters and numbers (``[\\p{L}\\p{N}]+``) of the lower-cased text;
* pre-tokens: the pieces of the byte-level BPE splitting pattern of the public 50k vocabularies;
* hashes: the sum of a random number for each code point times a random odd number for its place, finalised
  (multilinear hashing over tables). Unlike a polynomial it has no algebra that structured strings, such as those of
  Thue and Morse, could cancel: two strings meet with a probability of about 2**-63. Where a hash would decide on what is
  written (words of BPE, classes of equal texts), bytes or a second hash are compared as well.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Characters handled at a time; bounds the scratch arrays to a few dozen MB.
CHUNK_CHARS = 1 << 20
_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point, as the splitting pattern has them."""
    out = np.full(0x110000, OTHER, np.uint8)
    kinds = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
    first = np.array(kinds)
    out[first == "L"], out[first == "N"] = LETTER, NUMBER
    out[_WHITE] = SPACE
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@functools.cache
def _random() -> tuple[np.ndarray, np.ndarray]:
    """A number for each code point, an odd one for each place."""
    letter = mix((np.arange(0x110000, dtype=np.uint64) + np.uint64(1)) * np.uint64(_P))
    place = mix((np.arange(CHUNK_CHARS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    return letter, place


def _finish(total: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    return mix(total + np.asarray(size).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of all elements of spans, one span after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def hash_spans(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each cp[start:end]. Any length."""
    letter, place = _random()
    sizes = np.asarray(ends, np.int64) - starts
    out = np.full(len(sizes), mix(np.zeros(1, np.uint64))[0])
    acc, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = int(np.searchsorted(acc, (acc[at - 1] if at else 0) + CHUNK_CHARS, "right"))
        if stop <= at:  # one span longer than a chunk
            out[at] = _hash_long(cp[starts[at] : ends[at]])
            at += 1
            continue
        own = np.flatnonzero(sizes[at:stop] > 0) + at
        if len(own):
            n = sizes[own]
            first = np.cumsum(n) - n
            rel = np.arange(int(n.sum())) - np.repeat(first, n)
            term = letter[cp[rel + np.repeat(starts[own], n)]]
            term *= place[rel]
            out[own] = _finish(np.add.reduceat(term, first), n)
        at = stop
    return out


def _hash_long(cp: np.ndarray) -> np.uint64:
    letter, place = _random()
    total = np.zeros(1, np.uint64)
    for i in range(0, len(cp), CHUNK_CHARS):
        part = letter[cp[i : i + CHUNK_CHARS]]
        total = mix(total * np.uint64(_P) + (part * place[: len(part)]).sum(dtype=np.uint64))
    return _finish(total, len(cp))[0]


def hash_fixed(cp: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """The same hash of spans of one short length."""
    letter, place = _random()
    total = np.zeros(len(begin), np.uint64)
    for k in range(n):
        total += letter[cp[begin + k]] * place[k]
    return _finish(total, n)


def string_hash(text: str) -> int:
    """The hash that the span functions give this string."""
    cp = codes(text)
    return int(hash_spans(cp, np.array([0]), np.array([len(cp)]))[0])


def batches(texts: list[str | None], chars: int = CHUNK_CHARS):
    """(first, stop) of runs of texts that hold about so many characters; a longer text is alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > chars:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


class Words:
    """Words of several texts: doc (index of the text), start, end (in cp), hash; offset of each text's first word in ``first``."""

    __slots__ = ("cp", "start", "end", "doc", "hash", "first")

    def __init__(self, texts: list[str | None], lower: bool = True):
        parts = [(t.lower() if lower else t) if t else "" for t in texts]
        joined = "\n".join(parts)
        self.cp = codes(joined)
        word = classes()[self.cp] <= NUMBER
        edge = np.diff(word.astype(np.int8), prepend=0, append=0)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.hash = hash_spans(self.cp, self.start, self.end)
        begins = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]]) if parts else np.zeros(0, np.int64)
        self.first = np.append(np.searchsorted(self.start, begins), len(self.start))
        self.doc = np.repeat(np.arange(len(parts)), np.diff(self.first))

    def text(self, i: int) -> str:
        return self.cp[self.start[i] : self.end[i]].tobytes().decode("utf-32-le", "surrogatepass")


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of the word n-grams of each text; a text of 1 to n-1 words has one gram of all its words. Repeats stay."""
    h, doc = words.hash, words.doc
    count = np.diff(words.first)
    total = len(h) - n + 1
    out = np.zeros(max(total, 0), np.uint64)
    for k in range(n if total > 0 else 0):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + h[k : k + total]
    whole = doc[:total] == doc[n - 1 :] if total > 0 else np.zeros(0, bool)
    docs, out = (doc[:total][whole], mix(out[whole] + np.uint64(n))) if total > 0 else (np.zeros(0, np.int64), out)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        own = []
        for d in short:
            acc = 0
            for x in h[words.first[d] : words.first[d + 1]]:
                acc = (acc * 0xC2B2AE3D27D4EB4F + int(x)) & _MASK
            own.append((acc + int(count[d])) & _MASK)
        docs, out = np.concatenate([docs, short]), np.concatenate([out, mix(np.array(own, np.uint64))])
    return docs, out


def pretokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cp, start, end, first): the pieces of ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

    The pieces of a text cover it; ``first[i]`` is the number of pieces before text i.
    """
    cp = codes("".join(texts))
    lens = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(lens)])
    n = len(cp)
    if not n:
        return cp, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    kind = classes()[cp]
    head = np.zeros(n + 1, bool)  # where a text begins
    head[begins] = True
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = (kind[1:] != kind[:-1]) | head[1:n]
    # a run of white space before something else of the same text gives its last character away
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~head[1:n]
    tail = np.flatnonzero(last)
    start[tail] = True  # alone, or joined to what follows if it is a blank
    start[tail[cp[tail] == 32] + 1] = False
    # contractions begin where an apostrophe begins a piece
    quote = np.flatnonzero(start & (cp == 39))
    if len(quote):
        room = begins[np.searchsorted(begins, quote, "right")] - quote
        pad = np.append(cp, [0, 0, 0]).astype(np.int64)
        one, two = pad[quote + 1], pad[quote + 2]
        size = np.where((room > 1) & np.isin(one, [115, 116, 109, 100]), 2, 0)
        long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        size = np.where((room > 2) & long, 3, size)
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        after = quote + size
        start[after[after < n]] = True
    s = np.flatnonzero(start)
    return cp, s, np.append(s[1:], n), np.searchsorted(s, begins)


def piece(cp: np.ndarray, start: int, end: int) -> bytes:
    return cp[start:end].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")


def spelled(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    """UTF-8 of each span."""
    size = end - start
    text, out, at = cp[flat(start, size)].tobytes().decode("utf-32-le", "surrogatepass"), [], 0
    for n in size.tolist():
        out.append(text[at : at + n].encode("utf-8", "replace"))
        at += n
    return out


def distinct(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each span by first appearance, first span of each code, its hash). Hashes propose; characters are compared, so spans of one code are equal."""
    hashes, size = hash_spans(cp, start, end), end - start
    codes = pd.factorize(hashes)[0]
    first = _first(codes)
    again = np.flatnonzero(first[codes] != np.arange(len(codes)))
    rep = first[codes[again]]
    if (size[again] != size[rep]).any() or (cp[flat(start[again], size[again])] != cp[flat(start[rep], size[again])]).any():
        codes = pd.factorize(np.array(spelled(cp, start, end), object))[0]
        first = _first(codes)
    return codes, first, hashes[first]


def _first(codes: np.ndarray) -> np.ndarray:
    out = np.empty(int(codes.max(initial=-1)) + 1, np.int64)
    out[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return out
