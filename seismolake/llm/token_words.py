"""Encoding with a public tokenizer that never joins words across white space.

Its pre-tokenizer drops white space, so a text's ids are those of its words in turn. Where it also
folds case and parts letters from marks, texts are folded, and marks set apart by spaces, before
they are split into words. Most words of a corpus are repeats: a worker keeps the ids of words that
it has met, in two generations of bounded size, and hands only the others to the tokenizers library.
"""

from __future__ import annotations

import os
import re

#: Words in a generation of a worker's cache, and the most bytes of one of them: longer words are encoded each time.
CACHE_WORDS, LONGEST = 500_000, 1000
#: Letters of Latin-1 whose case folds one by one, and ASCII marks but the apostrophe, which starts tokens with letters.
CAPITALS, SMALL = "".join(map(chr, [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)])), "".join(map(chr, [*range(97, 123), *range(0xE0, 0xF7), *range(0xF8, 0xFF)]))
LETTERS, MARKS = SMALL + "ßÿ", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
FOLD, WORD = bytes.maketrans(CAPITALS.encode("latin-1"), SMALL.encode("latin-1")), re.compile(f"[{LETTERS}]+")
#: A whole run of marks in folded Latin-1: neither an apostrophe nor a mark beyond ASCII is beside it.
RUN = re.compile(f"(?<=[{LETTERS}0-9 \t-\r])[{re.escape(MARKS)}]+(?=[{LETTERS}0-9 \t-\r])".encode("latin-1"))


class WordEncoder(dict):
    """encode(text) gives the ids as little-endian unsigned 32-bit integers. The items are the young generation of known words."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache_words = cache_words
        self.old: dict[bytes, bytes] = {}
        if self._raw("a b\nc\t d") != b"".join(map(self._raw, "abcd")):
            raise ValueError("the tokenizer joins words; encode whole texts instead")
        self.added = [token.content.encode() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.folded = [token.decode().encode("latin-1", "replace").translate(FOLD) for token in self.added]
        self.model, self.letters = self.tokenizer.model, self._letters()

    def _letters(self) -> dict[int, str] | None:
        """What the model gets for each letter; None unless case folds and runs of letters or marks are pieces of their own."""
        normalizer, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        pieces = lambda text: [piece for piece, _ in cut.pre_tokenize_str(text)]
        if not normalizer or not cut or normalizer.normalize_str(CAPITALS + LETTERS + MARKS) != SMALL + LETTERS + MARKS or any(WORD.fullmatch(token.decode()) for token in self.added):
            return None
        letters = {ord(c): "".join(pieces(c)) for c in LETTERS}
        return letters if pieces(f"{MARKS}{LETTERS}{MARKS}7{MARKS}") == [MARKS, LETTERS.translate(letters), MARKS, "7", MARKS] else None

    def _raw(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            text = word.decode("utf-8", "surrogatepass")
            if self.letters and len(word) <= LONGEST and WORD.fullmatch(text):
                ids = b"".join([token.id.to_bytes(4, "little") for token in self.model.tokenize(text.translate(self.letters))])
            elif (parts := self._words(text)) != [word]:
                ids = b"".join(map(self.__getitem__, parts))
            else:
                ids = self._raw(text)
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def _words(self, text: str) -> list[bytes]:
        """The words of a text in UTF-8: folded, and without marks at letters and digits, where that is sure to leave the ids as they are."""
        if self.letters:
            try:
                folded = text.encode("latin-1").translate(FOLD)
            except UnicodeEncodeError:
                pass
            else:
                if not any(token in folded for token in self.folded):
                    return RUN.sub(rb" \g<0> ", b" %b " % folded).decode("latin-1").encode().split()
        return text.encode("utf-8", "surrogatepass").split()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        out = b"".join(map(self.__getitem__, self._words(text)))
        if len(self) > self.cache_words:
            self.old = dict(self)
            self.clear()
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
