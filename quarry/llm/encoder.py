"""Token ids of whole texts by a word-level tokenizer, with the words kept between texts.

The tokenizer drops white space and handles words one by one, so a text's ids are those of its
words. Words of printable ASCII and Latin letters are lower-cased and cut into the tokenizer's
pieces here, and a piece's ids come from its BPE model; all other words, and those that may hold
a special token, go through the whole tokenizer as they are. Either way the ids are the
tokenizer's own (a property test compares whole texts).
"""

from __future__ import annotations

import json
import re
from struct import pack

MEMORY = 250_000_000        # bytes of kept words in each Python worker, estimated
LONGEST = 64                # longer words are not kept
SHORT = 6                   # longer words are kept in their lower-case pieces only
ENTRY = 200                 # bytes of a kept word beside its characters

# Characters for which lower case and letter class are the same in every Unicode version and
# which no normalisation joins: printable ASCII and Latin letters to U+017F but the dotted I.
PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]+")
# Fixed value: the tokenizer's own pieces, within those characters.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")
STEPS = [{"NFC"}, {"Replace"}, {"Lowercase"}]


def byte_letters() -> dict[int, str]:
    """How byte-level BPE writes bytes: printable Latin-1 as itself, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder(dict):
    """Ids of white-space-separated words as little-endian bytes of type ``width``."""

    def __init__(self, path: str, width: str = "<u4", ordinary: bool = False):
        from tokenizers import Tokenizer
        super().__init__()
        self.tokenizer, self.code = Tokenizer.from_file(path), {"<u2": "H", "<u4": "I"}[width]
        self.tokenizer.encode_special_tokens = ordinary     # special tokens in a text are plain text
        self.model, self.letters, self.kept = self.tokenizer.model, byte_letters(), 0
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = [{s["type"]} for s in (made.get("normalizer") or {}).get("normalizers", [])]
        # Pieces are cut here only for a tokenizer that works as described above.
        self.known = steps == STEPS and "'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in json.dumps(
            made["pre_tokenizer"]).replace("\\\\", "\\")

    def _bytes(self, ids: list[int]) -> bytes:
        return pack(f"<{len(ids)}{self.code}", *ids)

    def _keep(self, word: str, ids: bytes) -> bytes:
        if len(word) <= LONGEST:
            self[word] = ids
            self.kept += ENTRY + 2 * len(word) + len(ids)
        return ids

    def _piece(self, piece: str) -> bytes:
        """Ids of a lower-case piece."""
        ids = self.get(piece)
        if ids is None:
            seen = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = self._keep(piece, self._bytes([t.id for t in self.model.tokenize(seen)]))
        return ids

    def __missing__(self, word: str) -> bytes:
        if not word:
            return self._keep(word, b"")
        if not self.known or "<|" in word or not PLAIN.fullmatch(word):
            return self._keep(word, self._bytes(self.tokenizer.encode(word, add_special_tokens=False).ids))
        pieces = PIECES.findall(word.lower())
        if len(pieces) == 1:
            ids = self._piece(pieces[0])
        else:
            ids = b"".join(map(self._piece, pieces))
        return self._keep(word, ids) if len(word) <= SHORT and word not in self else ids

    def text(self, text: str) -> bytes:
        if self.kept > MEMORY:
            self.clear()
            self.kept = 0
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, width: str = "<u4", ordinary: bool = False) -> Encoder:
    """One for each worker process."""
    key = path, width, ordinary
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]
