"""Pre-tokens of a byte-level tokenizer: what its merges never cross.

A text is cut at the strings of special tokens first. Each part is cut before every blank that a visible character
follows, which is always an edge of pre-tokens; the same few cuts come up again and again, so the pattern itself runs
once per distinct one. The pattern sees letters and digits as the tokenizers library does, but for characters newer
than the library; a text that holds one is cut by the library.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import regex

#: Fixed value: the pattern that byte-level pre-tokenizers share.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer(source: str, special: bool):
    """The library's tokenizer; `special` says whether special tokens' strings in a text stand for them."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(source)
    made.no_truncation()
    made.no_padding()
    made.encode_special_tokens = not special
    return made


def newer_characters() -> str:
    """Ranges, for a character class, of letters, digits and blanks that the pattern knows and the library does not."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    ranges: list[list[int]] = []
    for ch in regex.findall(r"[\p{L}\p{N}\s]", every):
        if unicodedata.category(ch) == "Cn":
            if ranges and ranges[-1][1] == ord(ch) - 1:
                ranges[-1][1] = ord(ch)
            else:
                ranges.append([ord(ch), ord(ch)])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)


@dataclass(frozen=True)
class Rules:
    """What a task needs to cut texts; made on the driver from the tokenizer's file."""

    source: str
    specials: tuple[str, ...]
    newer: str


def rules(source: str) -> Rules:
    """ValueError for a tokenizer that cuts or normalises in any other way."""
    spec = json.loads(source)
    cut = spec["pre_tokenizer"] or {}
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    added = spec.get("added_tokens") or []
    odd = any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip"))
    if spec.get("normalizer") or not plain or odd:
        raise ValueError("not a plain byte-level tokenizer")
    names = sorted((t["content"] for t in added), key=lambda s: (-len(s), s))
    return Rules(source, tuple(names), newer_characters())


class Cutter:
    """Cuts texts inside a task."""

    def __init__(self, rules: Rules):
        self._pattern = regex.compile(PATTERN)
        self._special = regex.compile("|".join(map(regex.escape, rules.specials))) if rules.specials else None
        self._odd_blank = regex.compile(r" (?!\S)")
        self._cut = regex.compile(r" (?=\S)")
        self._newer = regex.compile(f"[{rules.newer}]") if rules.newer else None
        self._library = tokenizer(rules.source, special=True).pre_tokenizer

    def parts(self, text: str) -> tuple[int, list[str]]:
        """How many special tokens stand in the text, and what lies between them."""
        if self._special is None:
            return 0, [text]
        parts = self._special.split(text)
        return len(parts) - 1, parts

    def words(self, part: str) -> tuple[str, list[str]]:
        """The first piece of a part, and the following ones without the blank that each begins with."""
        if self._odd_blank.search(part):
            first, *rest = self._cut.split(part)
        else:
            first, *rest = part.split(" ")
        return first, rest

    def pretokens(self, piece: str) -> list[str]:
        word = piece[1:] if piece[:1] == " " else piece
        if word.isalpha():  # by far the most pieces
            return [piece]
        if word[:-1].isalpha() and word[-1] in ".,;:!?":
            return [piece[:-1], piece[-1]]
        if self._newer and not piece.isascii() and self._newer.search(piece):
            return [piece[a:b] for _, (a, b) in self._library.pre_tokenize_str(piece)]
        return self._pattern.findall(piece)

    def pieces(self, text: str) -> Iterator[str]:
        """All pieces of a text, those of special tokens left out."""
        for part in self.parts(text)[1]:
            first, rest = self.words(part)
            yield first
            for word in rest:
                yield " " + word
