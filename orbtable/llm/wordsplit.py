"""Pre-splitting of texts for tokenizers of the word-end kind, read from a tokenizer file."""

from __future__ import annotations

import json
import re
import unicodedata

#: White space as the tokenizer's normalizer sees it (Unicode White_Space). Fixed values.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Words, single digits and runs of other signs. Fixed values.
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"
#: Printable ASCII that is neither letter nor digit: as the end of a chunk one piece. Fixed values.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Entries of each of the two generations of a worker's memo.
MEMO = 400_000


def byte_letters() -> dict[int, str]:
    """Each byte's letter: printable Latin-1 stands for itself, the others follow from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = {}, 256
    for b in range(256):
        out[b] = chr(b if b in plain else extra)
        extra += b not in plain
    return out


class Splitter:
    """Chunks of a text between white space, special strings apart, and the pieces of a chunk."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.specials = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")
        self._piece, self._space = regex.compile(PIECE), regex.compile(f"[{SPACE}]+")
        self._odd = re.compile("[\x1c-\x1f]")
        # PIECE for small printable ASCII without white space
        self._plain_piece = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
        self._letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self._far = re.compile("[^\x00-\u024f]").search
        self._first = next(iter(self.specials))[:2] if self.specials else None

    def chunks(self, text: str) -> list[str]:
        """Non-empty chunks in order; a special string is a chunk of its own."""
        if self._first and self._first in text and self._special.search(text):
            return [c for part in self._special.split(text) for c in ([part] if part in self.specials else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        # str.split also cuts at U+001C to U+001F, which are no white space here
        if self._odd.search(text):
            return [c for c in self._space.split(text) if c]
        return text.split()

    @staticmethod
    def _cut(low: str, piece) -> list[str]:
        """Pieces of a small chunk: most are a word, or a word and signs."""
        word = low.rstrip(SIGNS)
        if word.isalpha():
            return [low] if len(word) == len(low) else [word, low[len(word):]]
        return piece.findall(low)

    def pieces(self, chunk: str) -> list[str]:
        """Normalised pieces of a chunk, each byte as its letter."""
        if chunk.isascii() and chunk.isprintable():
            return self._cut(chunk.lower(), self._plain_piece)
        if self._far(chunk):  # beyond Latin, Unicode versions differ: the tokenizer's own normalizer and splitter
            return [p for p, _ in self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(chunk))]
        # no letter up to U+024F changes with its neighbours, so the whole is lower-cased at once
        low = unicodedata.normalize("NFC", chunk).lower()
        found = self._cut(low, self._piece)
        return [p if p.isascii() and p.isprintable() else p.encode("utf-8").decode("latin-1").translate(self._letters) for p in found]


class Memo(dict):
    """What `make` gives for a key, kept in two generations of bounded size."""

    def __init__(self, make, size: int = MEMO):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out
