"""Texts to token ids with a tokenizer file of the tokenizers library.

The library encodes about 1 MB/s per core, nearly all of it spent on words it has
just encoded. Both known file kinds first cut a text into words that are encoded
alone. So a worker cuts a text with one pattern, keeps the ids of the words that it
has met, and gives only new words to the library's model. Words are cut here only in
texts of the character range in which the classes are listed below; any other text,
and any other kind of file, goes to the library as a whole. The results are the
library's in every case.
"""

from __future__ import annotations

import codecs
import functools
import json
import re

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession

# The two ways in which the tokenizer files cut words.
BYTE_CUT = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
WORD_CUT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WORD_NORMAL = ["NFC", "Replace", "Lowercase"]
LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
ENDINGS = "'(?:[stmd]|re|ve|ll)"
UNLISTED = re.compile("[^\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u203a\u20ac]")

# Byte-level files show a byte that is no visible Latin-1 character as one of the
# characters from 256 on, in order.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _VISIBLE]
BYTE_LETTERS = "".join(chr(256 + _HIDDEN.index(b) if b in _HIDDEN else b) for b in range(256))

# Characters of the words in one of the two generations that a worker keeps.
CACHE_CHARS = 6_000_000


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file, read on the driver and sent to the executors: a few MB whatever the data."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


class Encoder:
    """Encodes texts as the library does with add_special_tokens=False."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(file)
        told = json.loads(file)
        self.marks = [x["content"] for x in told["added_tokens"]]
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        cut, normal = told["pre_tokenizer"] or {}, told["normalizer"] or {}
        self.lower = False
        self.word = None
        if cut == BYTE_CUT and not normal:
            self.word = re.compile(
                rf" ?[{LETTERS}]+|{ENDINGS}| ?[^\s{LETTERS}{NUMBERS}]+| ?[{NUMBERS}]+|\s+(?!\S)|\s+"
            ).findall
        elif (
            [x.get("pattern", {}).get("Regex") for x in cut.get("pretokenizers", [])] == [WORD_CUT, None]
            and [x["type"] for x in normal.get("normalizers", [])] == WORD_NORMAL
        ):
            self.lower = True
            self.word = re.compile(rf"[{LETTERS}]+|{ENDINGS}|[^\s{LETTERS}{NUMBERS}]+|[{NUMBERS}]").findall
        # The bytes of each id.
        size = self.kind.itemsize
        self.bytes = [n.to_bytes(size, "little") for n in range(max(self.library.get_vocab().values(), default=0) + 1)]
        # For new words, which gain nothing from the model's own memory of words.
        self.model = Tokenizer.from_str(file).model
        if self.word and hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)
        # Two generations of words met, when the young one is full it becomes
        # the old one.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def learn(self, word: str) -> bytes:
        """Ids of a word from the library's model, or from the older generation."""
        found = self.old.get(word)
        if found is None:
            shown = codecs.charmap_decode(word.encode(), "strict", BYTE_LETTERS)[0]
            found = b"".join([self.bytes[x.id] for x in self.model.tokenize(shown)])
        if self.held > CACHE_CHARS:
            self.young, self.old, self.held = {}, self.young, 0
        self.young[word] = found
        self.held += len(word) + 16
        return found

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, self.kind)
        if self.word is None or UNLISTED.search(text) or any(x in text for x in self.marks):
            return np.frombuffer(self.whole(text), self.kind)
        words = self.word(text.lower() if self.lower else text)
        found = list(map(self.young.get, words))
        if None in found:
            # A word may be new twice in one text.
            found = [self.young.get(word) or self.learn(word) if x is None else x for word, x in zip(words, found)]
        return np.frombuffer(b"".join(found), self.kind)


@functools.cache
def encoder(file: str) -> Encoder:
    """One encoder per worker process, with the words it has met."""
    return Encoder(file)
