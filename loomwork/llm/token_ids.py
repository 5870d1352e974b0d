"""Token ids through a word cache: texts are cut where the tokenizer's own splitting always cuts, so that pieces can be encoded alone."""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator

#: Unicode White_Space, which the tokenizers' patterns call white space (Python's own class has four characters more).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters (a part of them: the rest only makes longer pieces) before an ASCII sign other than the apostrophe, where both patterns cut too.
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+(?=[!-&(-/:-@\\[-`{-~])"
#: Spaces and what follows up to the next space: a byte-level pattern always cuts before white space that follows a visible character.
WITH_SPACES = re.compile(f"[{SPACE}]*{LETTERS}|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: For tokenizers that drop white space.
NO_SPACES = re.compile(f"{LETTERS}|[^{SPACE}]+")
#: Letters that both patterns keep in one word and that lower-casing and composing take one by one; a space before them stays with them.
PLAIN_LETTERS = "".join(map(chr, (*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100))))
PLAIN = re.compile(f" ?[{PLAIN_LETTERS}]+")


def ids_as_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def plain_table(tokenizer, cut: re.Pattern) -> dict[int, str] | None:
    """What normalizing and splitting make of each plain letter, and of a space before one; None where they do not keep plain words whole."""

    def shown(text: str) -> list[str]:
        if tokenizer.normalizer:
            text = tokenizer.normalizer.normalize_str(text)
        return [word for word, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    if not tokenizer.pre_tokenizer or any(PLAIN.fullmatch(t.content) for t in tokenizer.get_added_tokens_decoder().values()):
        return None
    alone = {ord(c): shown(c) for c in PLAIN_LETTERS}
    if any(len(x) != 1 for x in alone.values()):
        return None
    table, start = {c: x[0] for c, x in alone.items()}, ""
    if cut.findall(" a") == [" a"]:  # pieces begin with their spaces
        first, start = shown(" a")[0], " "
        table[ord(start)] = first.removesuffix(table[ord("a")])
    return table if shown(start + PLAIN_LETTERS) == [(start + PLAIN_LETTERS).translate(table)] else None


class WordCache(dict):
    """Piece -> its ids as little-endian unsigned 32-bit bytes; bounded, and emptied when full.

    A plain word goes to the tokenizer's model at once: normalizing and splitting it, most of the cost of a call, is one
    look-up a letter.
    """

    def __init__(self, path: str, cut: re.Pattern, most: int = 300_000, longest: int = 64):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.cut, self.most, self.longest = Tokenizer.from_file(path), cut, most, longest
        self.model, self.table, self.plain = self.tokenizer.model, plain_table(self.tokenizer, cut), PLAIN.fullmatch

    def __missing__(self, piece: str) -> bytes:
        if self.table and self.plain(piece):
            out = ids_as_bytes([t.id for t in self.model.tokenize(piece.translate(self.table))])
        else:
            out = ids_as_bytes(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[piece] = out
        return out

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each whole text; null is empty."""
        get, cut = self.__getitem__, self.cut.findall
        for t in texts:
            yield b"".join(map(get, cut(t))) if t else b""


_caches: dict[tuple, WordCache] = {}


def cached(path: str, cut: re.Pattern) -> WordCache:
    """One cache for each worker process and tokenizer."""
    if (path, cut.pattern) not in _caches:
        _caches[path, cut.pattern] = WordCache(path, cut)
    return _caches[path, cut.pattern]
