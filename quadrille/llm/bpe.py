"""Pre-tokens counted or encoded through a table of proven strings.

A byte-pair tokenizer first cuts a text into pre-tokens and merges within each
of them, so the tokens of a text are those of its pre-tokens one after
another.  Cutting is done here with a pattern of the standard library; it
equals the tokenizer's own for texts made of the characters in ``PLAIN_RANGES``.
Other texts are first cut before blanks that follow a visible ASCII character,
where a pre-token ends in any case; the pieces with other characters go to the
tokenizer, as does the whole of a text that holds the string of an added token.
"""

from __future__ import annotations

import functools
import itertools
import re
import struct
import unicodedata
from collections.abc import Iterator

from tokenizers import Tokenizer

#: Latin letters, the Cyrillic base block and common punctuation: long-settled characters.
PLAIN_RANGES = ((0x0000, 0x024F), (0x0400, 0x045F), (0x2010, 0x2027), (0x2030, 0x203A), (0x20AC, 0x20AC))
#: Where lower-casing and composition work on single characters as well.
PLAIN_LOWER_RANGES = ((0x0000, 0x017F), (0x0400, 0x045F), (0x2010, 0x2027), (0x2030, 0x203A), (0x20AC, 0x20AC))
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0  "


def _members(ranges, wanted: str) -> str:
    return "".join(re.escape(chr(c)) for a, b in ranges for c in range(a, b + 1) if unicodedata.category(chr(c))[0] == wanted)


def _outside(ranges) -> re.Pattern:
    return re.compile("[^" + "".join(f"{chr(a)}-{chr(b)}" if a else f"\\x00-{chr(b)}" for a, b in ranges) + "]")


def byte_level_cutter() -> re.Pattern:
    """Contractions, letters, digits and other runs with a leading blank, and runs of blanks."""
    letter, digit, blank = _members(PLAIN_RANGES, "L"), _members(PLAIN_RANGES, "N"), re.escape(_BLANKS)
    return re.compile(rf" ?[{letter}]+| ?[{digit}]+|'(?:[stmd]|re|ve|ll)| ?[^{blank}{letter}{digit}]+|[{blank}]+(?![^{blank}])|[{blank}]+")


def word_cutter() -> re.Pattern:
    """Contractions, runs of letters, single digits and other runs; blanks vanish."""
    letter, digit, blank = _members(PLAIN_LOWER_RANGES, "L"), _members(PLAIN_LOWER_RANGES, "N"), re.escape(_BLANKS)
    return re.compile(rf"[{letter}]+|[{digit}]|'(?:[stmd]|re|ve|ll)|[^{blank}{letter}{digit}]+")


#: Before blanks that follow a visible ASCII character.
_CUT = re.compile(r"(?<=[!-~])(?=[ \n])")


def byte_characters() -> dict[int, str]:
    """The visible character that stands for each byte in the vocabulary of a byte-level tokenizer."""
    visible = [b for r in ((33, 126), (161, 172), (174, 255)) for b in range(r[0], r[1] + 1)]
    spare = (b for b in range(256) if b not in set(visible))
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(spare)}


class _Library:
    def __init__(self, source: str, ranges):
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = _outside(ranges)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None

    def is_special(self, text: str) -> bool:
        return self.special is not None and self.special.search(text) is not None

    def is_odd(self, text: str) -> bool:
        return not text.isascii() and self.odd.search(text) is not None

    def plain(self, text: str) -> bool:
        return not self.is_odd(text) and not self.is_special(text)

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """Whether each piece is for the tokenizer, and the piece; one after the other they are the text."""
        if self.is_special(text):
            yield True, text
        elif not self.is_odd(text):
            yield False, text
        else:
            for odd, units in itertools.groupby(_CUT.split(text), self.is_odd):
                yield odd, "".join(units)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


def pack_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers; for the few ids of a pre-token ``struct`` takes less time than an array."""
    return struct.pack(f"<{len(ids)}I", *ids)


class _Table(dict):
    """Values by pre-token; the rest is merged when it comes up.

    When LIMIT of them have come up they become the older generation, of which
    those that come up again are kept, and the one before is forgotten.  Long
    pre-tokens are not kept.
    """

    LIMIT, LONG = 200_000, 64

    def __init__(self, proven, merge):
        super().__init__(proven)
        self.proven, self.merge, self.older = dict(proven), merge, {}

    def __missing__(self, token):
        if len(token) > self.LONG:
            return self.merge(token)
        value = self.older.get(token)
        if value is None:
            value = self.merge(token)
        if len(self) >= len(self.proven) + self.LIMIT:
            self.older = dict(self)
            self.clear()
            self.update(self.proven)
        self[token] = value
        return value


def whole_tokens(source: str) -> list[str]:
    """The vocabulary's strings that are one pre-token and encode alone as one token."""
    library, cutter = _Library(source, PLAIN_RANGES), byte_level_cutter()
    byte_of = {c: b for b, c in byte_characters().items()}
    strings = []
    for token in library.tokenizer.get_vocab(with_added_tokens=False):
        try:
            text = bytes(byte_of[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if library.plain(text) and cutter.findall(text) == [text]:
            strings.append(text)
    found = library.tokenizer.encode_batch(strings, add_special_tokens=False)
    return sorted(s for s, e in zip(strings, found, strict=True) if len(e.ids) == 1)


class Counter:
    """Numbers of tokens of texts."""

    def __init__(self, source: str, whole: list[str]):
        self.library, self.cutter = _Library(source, PLAIN_RANGES), byte_level_cutter()
        self.table = _Table(dict.fromkeys(whole, 1), lambda token: len(self.library.ids(token)))

    def __call__(self, text: str) -> int:
        if self.library.plain(text):
            return sum(map(self.table.__getitem__, self.cutter.findall(text)))
        return sum(len(self.library.ids(piece)) if odd else self(piece) for odd, piece in self.library.pieces(text))


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit integers.

    A pre-token is in the form that the tokenizer's normalizer and cutter leave
    of it, so it goes straight to the tokenizer's model, in the characters
    that stand for its bytes; a whole encoding takes more than twice the time.
    """

    def __init__(self, source: str):
        self.library, self.cutter = _Library(source, PLAIN_LOWER_RANGES), word_cutter()
        self.model, self.characters = self.library.tokenizer.model, byte_characters()
        self.table = _Table({}, self._merge)

    def _merge(self, token: str) -> bytes:
        if not (token.isascii() and token.isprintable()):
            token = token.encode().decode("latin-1").translate(self.characters)
        return pack_ids([t.id for t in self.model.tokenize(token)])

    def _pack(self, text: str) -> bytes:
        return pack_ids(self.library.ids(text))

    def __call__(self, text: str) -> bytes:
        if self.library.plain(text):
            return b"".join(map(self.table.__getitem__, self.cutter.findall(text.lower())))
        return b"".join(self._pack(piece) if odd else self(piece) for odd, piece in self.library.pieces(text))


@functools.lru_cache(maxsize=2)
def encoder(source: str) -> Encoder:
    """The encoder of a worker process, with its table, for all tasks that it runs."""
    return Encoder(source)


@functools.lru_cache(maxsize=2)
def counter(source: str, whole: tuple[str, ...]) -> Counter:
    """As ``encoder``, for counting."""
    return Counter(source, whole)
