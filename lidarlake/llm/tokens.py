"""Token ids of whole texts by a byte-level BPE file, with caches for what repeats.

The file's own model makes the ids. A text that has only characters below U+0250, and no special token, is cut where its
pre-tokens cannot cross, at single spaces; ids of such chunks and of their pre-tokens are kept in bounded caches. Every
other text goes through the tokenizer as it is. Both ways give the same ids.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata

CACHE_ENTRIES = 300_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        kinds = {k: "".join(re.escape(chr(i)) for i in range(0x250) if unicodedata.category(chr(i))[0] == k) for k in "LN"}
        space = re.escape("\t\n\v\f\r \x85\xa0")
        letter, number = kinds["L"], kinds["N"]
        # Fixed value: the pre-token pattern of the vocabulary, for the characters below U+0250.
        self.pre = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")
        self.far = re.compile("[^\\x00-ɏ]")
        self.loose = re.compile(f" [{space}]|[{space}] ")
        self.letters = _byte_letters()
        # ids of what followed a space; what came once waits in `fresh`
        self.known: dict[str, bytes] = {}
        self.shorts: dict[str, bytes] = {}
        self.fresh: dict[str, bytes] = {}

    def _ids(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, piece.encode())))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        """A chunk's pre-tokens, one after the other; those that begin with a space may be known as chunks."""
        pieces = self.pre.findall(chunk)
        if len(pieces) == 1:
            return self._ids(chunk)
        return b"".join(self._after_space(p[1:]) if len(p) > 1 and p[0] == " " else self._ids(p) if len(p) > 2 else self._short(p) for p in pieces)

    def _short(self, piece: str) -> bytes:
        found = self.shorts.get(piece)
        if found is None:
            found = self.shorts[piece] = self._ids(piece)  # pre-tokens of two characters at most below U+0250: few
        return found

    def _after_space(self, w: str) -> bytes:
        found = self.known.get(w)
        if found is None:
            found = self.fresh.pop(w, None)
            if found is not None:
                if len(self.known) >= CACHE_ENTRIES:
                    self.known.clear()
                self.known[w] = found
            else:
                found = self._chunk(" " + w)
                if len(w) < 40:
                    if len(self.fresh) >= CACHE_ENTRIES:
                        self.fresh.clear()
                    self.fresh[w] = found
        return found

    def rest(self) -> None:
        """At the end of a task: what came once is forgotten."""
        self.fresh.clear()

    def encode(self, text: str) -> bytes:
        """The ids, each as a little-endian unsigned 32-bit number."""
        if self.far.search(text) or self.special.search(text) or self.loose.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        first, *rest = text.split(" ")
        known, after = self.known, self._after_space
        out = [self._chunk(first)] if first else []
        out += [known.get(w) or after(w) for w in rest]
        return b"".join(out)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
