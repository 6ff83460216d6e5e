"""Token ids of whole texts, from a cache of pre-tokens, exactly as the library gives them.

A byte-pair tokenizer cuts a text into pre-tokens and encodes each alone. Texts whose
characters are all such that Python's `re` and the library agree (of any script; a test
compares every one of them) are cut here, and only pre-tokens not met before are encoded by
the library. All other texts (with combining marks, or letters of young scripts), and those
with a special token's string, the library encodes whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import Any

import tokenizers

#: Code points of the ranges that are cut here: all scripts but for joined Korean letters
#: (Jamo), which make up others, and what lies beyond the emoji.
RANGES = ((0x0000, 0x1100), (0x1200, 0xD800), (0xF900, 0x20000))
#: A worker forgets the older half of its cache beyond so many pre-tokens (about 200 bytes each).
CACHED = 300_000


def _plain(code: int) -> bool:
    """A character that stands alone: its own normal form, one character in lower case, no mark, no sigma.

    A letter, number or space has to be as old as Unicode 3.2, so that every library knows
    it; a younger symbol is the same to a tokenizer as a character it doesn't know. The same
    holds for what it is in lower case.
    """
    c = chr(code)
    kind = unicodedata.category(c)
    if kind[0] in "LNZ" and unicodedata.ucd_3_2_0.category(c)[0] != kind[0]:
        return False
    if len(c.lower()) != 1 or not any(low <= ord(c.lower()) < high for low, high in RANGES):
        return False
    if c.lower() != c and not _plain(ord(c.lower())):
        return False
    return unicodedata.normalize("NFC", c) == c and c != "Σ" and kind != "Cn" and kind[0] != "M"


def _ranges(codes: Iterable[int]) -> str:
    found: list[list[int]] = []
    for code in codes:
        if found and found[-1][1] == code - 1:
            found[-1][1] = code
        else:
            found.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found)


SAFE = [c for low, high in RANGES for c in range(low, high) if _plain(c)]
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"


def _patterns(codes: list[int]) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """What no text of the given characters has, and pre-tokens of a byte-level tokenizer and of
    one with word ends (fixed patterns of these formats) in texts of them."""
    letters = _ranges(c for c in codes if unicodedata.category(chr(c))[0] == "L")
    digits = _ranges(c for c in codes if unicodedata.category(chr(c))[0] == "N")
    byte_level = re.compile(
        rf" ?[{letters}]+|{_ENDINGS}| ?[{digits}]+| ?[^{_SPACE}{letters}{digits}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    )
    word_ends = re.compile(rf"[{letters}]+|{_ENDINGS}|[{digits}]|[^{_SPACE}{letters}{digits}]+")
    return re.compile(f"[^{_ranges(codes)}]"), byte_level, word_ends


_UNSAFE, BYTE_LEVEL, WORD_ENDS = _patterns(SAFE)
#: For texts without characters of other planes: a character outside of a class of `re` is
#: compared with each of its ranges there, so that each word's end takes as long as a word.
_FAR, BYTE_LEVEL_NEAR, WORD_ENDS_NEAR = _patterns([c for c in SAFE if c < 0x10000 and ord(chr(c).lower()) < 0x10000])


def _cutter(settings: dict, near: bool = False) -> Callable[[str], list[str]] | None:
    """How texts are cut for a tokenizer's settings, or only ``near`` ones (without characters
    of other planes); None if that isn't known here."""
    cut, normal = settings["pre_tokenizer"] or {}, settings["normalizer"] or {}
    if settings["model"]["type"] != "BPE" or settings["post_processor"] or settings["truncation"] or settings["padding"]:
        return None
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in settings["added_tokens"]):
        return None
    if cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and not normal:
        return (BYTE_LEVEL_NEAR if near else BYTE_LEVEL).findall
    steps = [s["type"] for s in cut.get("pretokenizers", ())], [s["type"] for s in normal.get("normalizers", ())]
    if steps == (["Split", "ByteLevel"], ["NFC", "Replace", "Lowercase"]):
        split, last = cut["pretokenizers"]
        known = rf"{_ENDINGS}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+"
        if split["pattern"] == {"Regex": known} and split["invert"] and not last["use_regex"]:
            found = (WORD_ENDS_NEAR if near else WORD_ENDS).findall
            return lambda text: found(text.lower())
    return None


def _byte_names() -> dict[int, str]:
    """How byte-level tokenizers write bytes: printable ones as they are, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


_NAMES = _byte_names()


def packed(ids: list[int]) -> bytes:
    """Ids as four bytes each, little-endian."""
    return struct.pack(f"<{len(ids)}I", *ids)


class _Values(dict):
    """Values of pre-tokens; one that is missing is made when it is asked for."""

    def __init__(self, make: Callable[[str], Any], held: Iterable[tuple[str, Any]] = ()):
        super().__init__(held)
        self.make = make

    def __missing__(self, piece: str) -> Any:
        value = self[piece] = self.make(piece)
        return value


class Encoder:
    """Encodes texts with the tokenizer of the given file's content; one for each worker.

    A text's result is ``join`` over what ``value`` makes of the ids of its pre-tokens: by
    default their ids as bytes. ``known`` has such values, which are never forgotten.
    """

    def __init__(
        self, content: str, known: dict[str, Any] | None = None, value: Callable[[list[int]], Any] = packed,
        join: Callable[[Iterable[Any]], Any] = b"".join, cached: int = CACHED,
    ):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        settings = json.loads(content)
        self.library = tokenizers.Tokenizer.from_str(content)
        self.cut, self.cut_near = _cutter(settings), _cutter(settings, near=True)
        self.suffix = settings["model"].get("end_of_word_suffix") or ""
        self.special = [t["content"] for t in settings["added_tokens"]]
        self.known, self.value, self.join, self.cached = known or {}, value, join, cached
        self.cache = _Values(self._of_piece)

    def vocabulary(self) -> Iterator[str]:
        """Texts of the vocabulary's entries that are texts, by id."""
        byte_of = {ord(name): byte for byte, name in _NAMES.items()}
        for name in sorted(self.library.get_vocab(), key=self.library.token_to_id):
            try:
                yield bytes(byte_of[ord(c)] for c in name.removesuffix(self.suffix)).decode()
            except (KeyError, UnicodeDecodeError):
                continue

    def pieces(self, text: str) -> list[str] | None:
        """The pre-tokens of a text; None if the library has to encode it whole."""
        if self.cut is None or any(s in text for s in self.special):
            return None
        if not _FAR.search(text):
            return self.cut_near(text)
        return None if _UNSAFE.search(text) else self.cut(text)

    def _of_piece(self, piece: str) -> Any:
        if piece in self.known:
            return self.known[piece]
        return self.of_piece(piece)

    def of_piece(self, piece: str) -> Any:
        """What the library makes of one pre-token."""
        named = piece.encode().decode("latin-1").translate(_NAMES)
        return self.value([t.id for t in self.library.model.tokenize(named)])

    def encode(self, texts: list[str]) -> list[Any]:
        """The result of each text."""
        if len(self.cache) > self.cached:
            self.cache = _Values(self._of_piece, islice(self.cache.items(), len(self.cache) // 2, None))
        get, out = self.cache.__getitem__, []
        for text in texts:
            cut = self.pieces(text)
            if cut is None:
                out.append(self.value(self.library.encode(text, add_special_tokens=False).ids))
            else:
                out.append(self.join(map(get, cut)))
        return out
