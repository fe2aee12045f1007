"""Texts a batch at a time: what there is to say about a text follows from its words, each of which is looked at once.

A word's facts are kept for the words that follow (``Memo``, bounded), so that a text costs a few lookups for each of its words. The
functions take and give Arrow arrays and are wrapped as UDFs where they are used; they are named here, so that a worker keeps what it knows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a memo holds, characters of the longest one it keeps, bytes of text that are looked at together.
MOST, LONGEST, SLICE = 100_000, 48, 1 << 20


class Memo(dict):
    """What ``make`` says of a word; emptied when it is full."""

    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, word: str):
        value = self.make(word)
        if len(word) <= LONGEST:
            if len(self) >= MOST:
                self.clear()
            self[word] = value
        return value


def slices(array: pa.Array) -> Iterator[list[str | None]]:
    """The texts of an array, about ``SLICE`` bytes of them at a time; a longer text is alone."""
    if not len(array):
        return
    acc = np.cumsum(pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(array):
        end = max(at + 1, int(np.searchsorted(acc, (acc[at - 1] if at else 0) + SLICE, "right")))
        yield array.slice(at, end - at).to_pylist()
        at = end


def strings(array: pa.Array, f: Callable[[str], str]) -> pa.Array:
    """``f`` of each text; null is an empty text."""
    parts = [pa.array([f(t or "") for t in texts], pa.string()) for texts in slices(array)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def numbers(array: pa.Array, f: Callable[[str], list[int]], width: int) -> pa.Array:
    """array<int> of ``width`` numbers for each text; null is an empty text."""
    rows = [np.array([f(t or "") for t in texts], np.int32).reshape(-1) for texts in slices(array)]
    values = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(np.arange(len(array) + 1, dtype=np.int32) * width, values)


# ---- normal forms
TATWEEL = 0x640
MARKS = [*range(0x64B, 0x660), 0x670, *range(0x6D6, 0x6EE)]
LIGHT = dict.fromkeys([TATWEEL, *MARKS]) | {a + i: 48 + i for a in (0x660, 0x6F0) for i in range(10)}
LETTERS = dict(zip(map(ord, "أإآٱىةؤئ"), "اااايهوي"))
STANDARD, VERSE = LIGHT | LETTERS, dict.fromkeys([TATWEEL, *MARKS]) | LETTERS


def _any_of(codes) -> re.Pattern:
    return re.compile("[" + "".join(map(chr, sorted(codes))) + "]")


_GONE, _TOUCHED = _any_of([TATWEEL, *MARKS]), _any_of(STANDARD)
_FOREIGN = re.compile("[^ء-يپچڤڥڨگ0-9]+")
_FOREIGN_VERSE = re.compile("[^ء-ي0-9]+")
_LONG = re.compile("([^\\n])\\1{2,}")


def _composed(text: str) -> str:
    return text if text.isascii() or unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)


def _mapped(text: str, table: dict) -> str:
    return text if text.isascii() or not _TOUCHED.search(text) else text.translate(table)


def _light(text: str) -> str:
    return " ".join(_mapped(_composed(text), LIGHT).split())


def standard_of(text: str) -> str:
    return " ".join(_mapped(_composed(text), STANDARD).split())


def aggressive_of(text: str) -> str:
    """The aggressive form of text in NFKC."""
    return _FOREIGN.sub(" ", _LONG.sub(r"\1\1", _mapped(text, STANDARD))).strip()


def _aggressive(text: str) -> str:
    return aggressive_of(_composed(text))


def verse_of(text: str) -> str:
    return _FOREIGN_VERSE.sub(" ", _mapped(_composed(text), VERSE)).strip()


def light(texts: pa.Array) -> pa.Array:
    return strings(texts, _light)


def standard(texts: pa.Array) -> pa.Array:
    return strings(texts, standard_of)


def aggressive(texts: pa.Array) -> pa.Array:
    return strings(texts, _aggressive)


def verse(texts: pa.Array) -> pa.Array:
    return strings(texts, verse_of)


def _verse_facts(text: str) -> list[int]:
    """(words, lines that aren't blank)."""
    return [len(verse_of(text).split()), sum(1 for x in text.splitlines() if "\x1f" in x or x.strip())]


def verse_facts(texts: pa.Array) -> pa.Array:
    return numbers(texts, _verse_facts, 2)


# ---- scripts, Arabizi, languages
_ARABIC, _LATIN = "[؀-ۿݐ-ݿ]", "[A-Za-zÀ-ÿ0-9']"
_W = re.compile("[a-z0-9']+")
_DIGIT = re.compile("[a-z][2-9]|[2-9]'?[a-z]")
_PIECE = re.compile(f"({_ARABIC}+)|({_LATIN}+)|.+", re.S)
_LETTER_DIGIT, _ACCENT = re.compile("[a-zà-ÿ][2-9]|[2-9]'?[a-zà-ÿ]"), re.compile("[àâäçéèêëîïôöùûüÿœæ]")
_BREAK, _ISLE, _RUN = re.compile("[\n\x0b\x0c\r]"), re.compile("[afu]+"), re.compile("[af]u*")


_KINDS: list[np.ndarray] = []
_LAST_LETTER = 0x32400  # behind it there are none


def _kinds() -> np.ndarray:
    """Of each code point: 1 Arabic, 2 Latin, 4 a letter or digit."""
    if not _KINDS:
        own = np.zeros(0x110000, np.uint8)
        own[:_LAST_LETTER] = np.fromiter(map(str.isalnum, map(chr, range(_LAST_LETTER))), np.uint8, _LAST_LETTER) * 4
        for first, last, bit in ((0x600, 0x6FF, 1), (0x750, 0x77F, 1), (0x41, 0x5A, 2), (0x61, 0x7A, 2)):
            own[first : last + 1] |= bit
        _KINDS.append(own)
    return _KINDS[0]


def _letter_facts(text: str) -> list[int]:
    from .translit import STOPWORDS_SET

    kinds = np.bincount(_kinds()[np.frombuffer(text.encode("utf-32-le"), np.uint32)], minlength=8)
    own = _W.findall(text.lower())
    digits = sum(1 for w in own if not w.isalpha() and _DIGIT.search(w))
    return [int(kinds[1::2].sum()), int(kinds[[2, 3, 6, 7]].sum()), int(kinds[4:].sum()), len(own), digits, sum(map(STOPWORDS_SET.__contains__, own))]


def letter_facts(texts: pa.Array) -> pa.Array:
    """(Arabic, Latin, all letters and digits, Latin words, those with a digit between letters, known function words)."""
    return numbers(texts, _letter_facts, 6)


def _label(word: str) -> str:
    from .translit import FRENCH_SET, STOPWORDS_SET

    w = word.lower().strip("'")
    if w in STOPWORDS_SET:
        return "a"
    if w.isascii() and w.isalpha():
        return "f" if w in FRENCH_SET else "u"
    if _LETTER_DIGIT.search(w):
        return "a"
    return "f" if w in FRENCH_SET or _ACCENT.search(w) else "u"


def _code(token: str) -> str:
    """A letter for each piece between blanks: A of an Arabic one, a, f or u of a Latin one; O of another, which goes on to the next blank, or a dot where it is punctuation."""
    if token.isascii():  # most tokens are a word, and perhaps a sign after it
        if token.isalpha():
            return _label(token)
        if token[:-1].isalpha() and token[-1] in ".,;:!?":
            return _label(token[:-1]) + "."
    out = []
    for m in _PIECE.finditer(token):
        if m[1]:
            out.append("A")
        elif m[2]:
            out.append(_label(m[2]))
        else:
            out.append("." if all(unicodedata.category(c)[0] in "PSZ" for c in m[0]) else "O")
    return "".join(out)


_CODES = Memo(_code)


def _language_facts(text: str) -> list[int]:
    code = "|".join("".join(map(_CODES.__getitem__, line.split(" "))) for line in _BREAK.split(text.replace("\t", " ")))
    n = {"f": 0, "a": 0, "u": code.count("O")}
    for run in _ISLE.findall(code):
        kinds = set(run) - {"u"}
        if len(kinds) < 2:
            n[kinds.pop() if kinds else "u"] += len(run)
            continue
        rest = run.lstrip("u")
        n[rest[0]] += len(run) - len(rest)
        for piece in _RUN.findall(rest):
            n[piece[0]] += len(piece)
    return [code.count("A"), n["f"], n["a"], n["u"]]


def language_facts(texts: pa.Array) -> pa.Array:
    """Words by language: Arabic, French, Arabizi, unknown."""
    return numbers(texts, _language_facts, 4)


# ---- markers of text in standard normal form
_SPACE = " \\t\\n\\x0b\\x0c\\r"  # what \\s means to Java


def _python(pattern: str) -> str:
    return pattern.replace("\\S", f"[^{_SPACE}]").replace("\\s", f"[{_SPACE}]")


class Markers:
    """Hits of each marker in words between blanks; ``ACROSS`` is the one that may reach over a blank."""

    ACROSS = "negation_ma_sh"

    def __init__(self, table: dict[str, tuple[str, str, str]]):
        self.width, self.across = len(table), list(table).index(self.ACROSS)
        self.rx = [None if k == self.ACROSS else re.compile(f"(?<!\\w){_python(v[0])}(?!\\w)") for k, v in table.items()]
        self.any = re.compile("(?<!\\w)(?:" + "|".join(_python(v[0]) for k, v in table.items() if k != self.ACROSS) + ")(?!\\w)")
        self.head = table[self.ACROSS][0][:2]
        self.rest = re.compile(_python(table[self.ACROSS][0]) + "(?!\\w)")
        self.memo = Memo(self._hits)

    def _hits(self, word: str) -> tuple[int, ...]:
        if not (self.any.match(word) if word.isalnum() else self.any.search(word)):  # without an inner boundary a hit begins with the word
            return ()
        return tuple(i for i, rx in enumerate(self.rx) if rx is not None for _ in rx.findall(word))

    def _negations(self, text: str) -> int:
        at, n = text.find(self.head), 0
        while at >= 0:
            m = None if at and (text[at - 1].isalnum() or text[at - 1] == "_") else self.rest.match(text, at)
            n += m is not None
            at = text.find(self.head, m.end() if m else at + 1)
        return n

    def counts(self, normal: str) -> list[int]:
        out = [0] * self.width
        for hits in filter(None, map(self.memo.__getitem__, normal.split(" "))):
            for i in hits:
                out[i] += 1
        out[self.across] = self._negations(normal)
        return out


def _markers() -> Markers:
    global _MARKERS
    if _MARKERS is None:
        from .markers import MARKERS

        _MARKERS = Markers(MARKERS)
    return _MARKERS


_MARKERS: Markers | None = None


def marker_counts(normal: str) -> list[int]:
    return _markers().counts(normal)


def marker_facts(normal: pa.Array) -> pa.Array:
    """Hits of each marker, in the order of the table, and the number of words."""
    own = _markers()
    return numbers(normal, lambda t: [*own.counts(t), sum(map(bool, t.split(" ")))], own.width + 1)


# ---- entities
class Entities:
    def __init__(self):
        from ..sources.entities import ENTITIES, PREFIXES, SUFFIXES

        self.names = frozenset(ENTITIES)
        self.head = re.compile("^(?:" + "|".join(f"{p}(?=.{{3}})" for p in PREFIXES) + ")")
        self.tail = re.compile("(?:" + "|".join(f"(?<=.{{3}}){s}" for s in SUFFIXES) + ")$")
        self.memo = Memo(self._kept)

    def entity(self, token: str) -> str | None:
        own = aggressive_of(token)
        if own in self.names:
            return own
        root = self.tail.sub("", self.head.sub("", own))
        return root if root in self.names else None

    def _kept(self, word: str) -> str:
        if word.isascii():
            return word
        return " ".join(w for w in _composed(word).split() if self.entity(w) is None)


def _entities() -> Entities:
    global _ENTITIES
    if _ENTITIES is None:
        _ENTITIES = Entities()
    return _ENTITIES


_ENTITIES: Entities | None = None


def without_entities(texts: pa.Array) -> pa.Array:
    memo = _entities().memo
    return strings(texts, lambda t: " ".join(filter(None, map(memo.__getitem__, t.split()))))


# ---- blocks of a document
def _n_plain(words: list[str]) -> int:
    """Words that aren't of tatweel and marks alone."""
    return sum(1 for w in words if w.isascii() or w.translate(LIGHT))


def block_words(text: str, target: int) -> Iterator[tuple[list[str], list[list[str]]]]:
    """Of each block: its lines as written, and their words. A line of more than ``target`` words is cut; lines without words are left out."""
    count = len if text.isascii() or not _GONE.search(text) else _n_plain
    lines, words, held = [], [], 0
    for line in text.splitlines():
        own = line.split()
        pieces = [(line, own)] if len(own) <= target else [(" ".join(own[k : k + target]), own[k : k + target]) for k in range(0, len(own), target)]
        for t, w in pieces:
            n = count(w)
            if not n:
                continue
            lines.append(t)
            words.append(w)
            held += n
            if held >= target:
                yield lines, words
                lines, words, held = [], [], 0
    if lines and held >= target // 2:
        yield lines, words


def normal_blocks(text: str, target: int) -> list[str]:
    """The blocks in standard normal form."""
    plain = text.isascii() or not (_GONE.search(text) or not unicodedata.is_normalized("NFKC", text))
    if plain:  # characters change one by one, if at all: words stay where they are
        text = _mapped(text, STANDARD)
    found = (" ".join([w for line in own for w in line]) for _, own in block_words(text, target))
    return list(found) if plain else [standard_of(t) for t in found]
