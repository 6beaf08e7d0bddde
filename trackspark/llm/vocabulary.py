"""A public word-end BPE vocabulary as symbols, and the words it splits text into."""

from __future__ import annotations

import json
import re
import unicodedata

import regex

# Fixed values of the tokenizer's file format: its pre-token pattern and special strings.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
WORD_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+"
_any = regex.compile(WORD)
_ascii = re.compile(WORD_ASCII)


class Vocabulary:
    """Tokens as strings over 512 symbols: a byte, or a byte that ends its word (256 more).

    ``parts[t]`` is the pair a merged token was made from ((t, t) for a symbol), ``merged``
    the inverse, ``symbols[t]`` the symbol string, ``shown[t]`` the token's text.
    """

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        ids = model["vocab"]
        suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.shown = [""] * size
        for text, t in [*ids.items(), *self.special.items()]:
            self.shown[t] = text
        letters = _byte_letters()
        self.parts = [(t, t) for t in range(size)]
        self.symbols: list[tuple[int, ...]] = [()] * size
        self.symbol_id = [0] * 512
        for byte, letter in enumerate(letters):
            for end, text in ((0, letter), (256, letter + suffix)):
                t = ids[text]
                self.symbols[t] = (byte + end,)
                self.symbol_id[byte + end] = t
        self.merged: dict[tuple[int, int], int] = {}
        rank = {}
        for i, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            l, r = ids[left], ids[right]
            t = ids[left + right]
            if t in rank:
                raise ValueError(f"token {t} has two merges; the pair table needs one each")
            rank[t] = i
            self.parts[t] = (l, r)
            self.merged[l, r] = t
            self.symbols[t] = self.symbols[l] + self.symbols[r]
        order = [t for t, _ in sorted(rank.items(), key=lambda x: x[1])]
        if any(a > b for a, b in zip(order, order[1:])):
            raise ValueError("token ids must follow the merge order")
        self._specials = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings: composed, lower-cased, white space dropped."""
        if text.isascii():
            return _ascii.findall(text.lower())
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return _any.findall(text.replace("Σ", "σ").lower())  # letter by letter: no final sigma

    def segments(self, text: str):
        """Alternating ordinary text and ids of special strings that occur in it."""
        at = 0
        if self._specials is not None and "<" in text:
            for m in self._specials.finditer(text):
                yield text[at: m.start()], self.special[m.group()]
                at = m.end()
        yield text[at:], None


def word_symbols(word: str) -> list[int]:
    out = list(word.encode())
    out[-1] += 256
    return out


def _byte_letters() -> list[str]:
    """Printable letter of each byte: printable Latin-1 stands for itself, the rest follow from code point 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordCache(dict):
    """Result per word; emptied when it holds ``limit`` words, so memory stays bounded."""

    def __init__(self, make, limit: int = 120_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, word):
        value = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value
