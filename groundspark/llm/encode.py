"""Token ids of whole texts with a public tokenizer, quickly.

Where a vocabulary splits texts into runs of letters, single digits and runs of signs and drops white space (the word
BPE), the ids of a text are those of its pieces one after another. Pieces repeat, so each task keeps the ids of those
it has seen; a new one goes to the tokenizers library's model. Pieces with other characters than those of _PLAIN
(apostrophes, other scripts, combining marks, spelled-out special tokens) are encoded by the whole tokenizer, word by
word. Other vocabularies encode whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: Pieces in each of the two generations of the cache; about 150 MB in all.
CACHE_PIECES = 400_000
_LETTERS, _SIGNS = "a-zß-öø-ÿœ", "!-&(-/:-@\\[-`{-~"
_PIECES = re.compile(f"[{_LETTERS}]+|[0-9]|[{_SIGNS}]+").findall
_ODD_SIGN = re.compile(f"[^ \\n\\t0-9A-ZÀ-ÖØ-ÞŒ{_LETTERS}{_SIGNS}]|<\\|").search
_PLAIN_ASCII = bytes(c for c in range(128) if not _ODD_SIGN(chr(c)))


def _odd(text: str) -> bool:
    """Whether a text has a character, or the begin of a special token, that its pieces can't be told from."""
    if text.isascii():
        return bool(text.encode().translate(None, _PLAIN_ASCII)) or "<|" in text
    return bool(_ODD_SIGN(text))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_signs() -> dict[int, int]:
    """The sign by which a byte-level vocabulary writes each byte: printable ones as they are, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


class _Pieces(dict):
    """Piece -> its ids as little-endian unsigned 32-bit bytes. Of two generations the older one goes."""

    def __init__(self, model) -> None:
        self.tokenize, self.signs, self.old = model.tokenize, _byte_signs(), {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            written = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.signs)
            found = array("I", [t.id for t in self.tokenize(written)]).tobytes()
        self[piece] = found
        return found

    def aged(self) -> None:
        if len(self) > CACHE_PIECES:
            self.old = dict(self)
            self.clear()


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes; a null text has none."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        splits = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        drops_space = splits[0].get("type") == "Split" and splits[0].get("behavior") == "Removed" and splits[0].get("invert")
        self.by_pieces = bool(config["model"].get("end_of_word_suffix") and drops_space)
        self.known = _Pieces(self.tokenizer.model)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_pieces:
            return self._whole([t or "" for t in texts])
        self.known.aged()
        ids = self.known.__getitem__
        return [b"" if not t else self._by_word(t) if _odd(t) else b"".join(map(ids, _PIECES(t.lower()))) for t in texts]

    def _by_word(self, text: str) -> bytes:
        """Word by word: those with other characters by the whole tokenizer, all of a text's at once."""
        words = text.replace("\n", " ").split(" ")
        odd = list({w for w in words if _odd(w)})
        own = dict(zip(odd, self._whole(odd), strict=True))
        ids = self.known.__getitem__
        return b"".join(own[w] if w in own else b"".join(map(ids, _PIECES(w.lower()))) for w in words)
