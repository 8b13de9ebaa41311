"""Token ids of whole texts through a tokenizers file, word by word with caches.

The word-end BPE used here drops white space and never merges across it, so the ids of a text are the ids of
its space-separated words one after another. Words of letters below U+0180 with punctuation after them, nearly all,
are split here and their parts given to the file's BPE model directly; any other word goes through the whole tokenizer.
A test compares this with the library on whole texts.
"""

from __future__ import annotations

from tokenizers import Tokenizer

NAME = "word_bpe_49k.json"
#: ASCII punctuation, but for the apostrophe, which may start a contraction.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def tokenizer_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(NAME)


def byte_letters() -> list[str]:
    """The character that byte-level BPE writes for each byte: itself where that is visible, else the next free one."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class WordEncoder:
    """Ids as little-endian unsigned 32-bit bytes. The caches have a bounded number of entries."""

    def __init__(self, path: str, most: int = 500_000, longest: int = 40):
        self.tokenizer, self.most, self.longest = Tokenizer.from_file(path), most, longest
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {"": b""}

    def _part(self, s: str) -> bytes:
        got = self.parts.get(s)
        if got is None:
            seen = s if s.isascii() else "".join([self.letters[b] for b in s.encode()])
            packed = self.packed
            got = b"".join([packed[t.id] for t in self.model.tokenize(seen)])
            if len(s) <= self.longest:
                self.parts[s] = got
        return got

    def _word(self, s: str) -> bytes:
        letters = s.rstrip(_MARKS)
        # below U+0180 letters are composed and have one lower case each, but for the dotted capital I
        if letters.isascii() and letters.isalpha() or not letters or letters.isalpha() and max(letters) < "\u0180" and "\u0130" not in letters:
            low = letters.lower()
            got = self.parts.get(low)
            if got is None:
                got = self._part(low)
            return got if len(letters) == len(s) else got + self._part(s[len(letters) :])
        return b"".join([self.packed[i] for i in self.tokenizer.encode(s, add_special_tokens=False).ids])

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        words, cache = text.replace("\n", " ").split(" "), self.words
        try:
            return b"".join([cache[w] for w in words])
        except KeyError:
            pass
        for c in (self.words, self.parts):
            if len(c) > self.most:
                c.clear()
                c[""] = b""
        out = []
        for w in words:
            ids = cache.get(w)
            if ids is None:
                ids = self._word(w)
                if len(w) <= self.longest:
                    cache[w] = ids
            out.append(ids)
        return b"".join(out)


def encoder(path: str | None = None) -> WordEncoder:
    return WordEncoder(tokenizer_path(path))
