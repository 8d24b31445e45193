"""Token ids of whole texts with the files of public tokenizers; a word that returns is encoded once per worker."""

import json
import os
import re
from array import array
from itertools import chain

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# White space that one of Python and the tokenizer takes as such and the other may not: such a text is encoded whole.
ODD_SPACE = re.compile(r"[^\S \t\n\r]")
SPACED_WORD = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
BARE_WORD = re.compile(r"[^ \t\n\r]+")
WORD_START = re.compile(r"(?<=[^ \t\n\r])(?=[ \t\n\r])")
CHUNK = 1_000_000
PUNCTUATION = ".,;:!?)\"'"
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
SPACED_LETTERS = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ÿ]+")
BARE_LETTERS = re.compile("[A-Za-z]+")
# Byte-level tokenizers write the bytes that are no visible character of Latin-1 as the characters from U+0100 on, in order.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: 0x100 + n for n, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
SPACE_CHAR = chr(BYTE_CHARS[ord(" ")])
LONGEST_KEPT = 100  # characters of a word that is remembered


def tokenizer_file(name: str) -> str:
    """Where a file of the installed public tokenizers is; used as the default of a parameter."""
    import public_tokenizers
    return public_tokenizers.path(name)


class Words(dict):
    """Ids by word; a word that is missing is learned."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        return self.learn(word)


class Encoder:
    """Encodes texts as the tokenizer does, word by word where its rules allow that.

    A byte-level tokenizer without a prefix space never joins a character that is not white space with white
    space after it, and a word tokenizer that drops white space never joins across it. So a text's ids are the ids of its
    words, each with the white space before it. Other tokenizers, texts with unusual white space, and texts that may hold an
    added token (which the tokenizer takes as such wherever it stands) are encoded whole. Neither kind joins a letter with ASCII
    punctuation after it, so words that differ by the punctuation at their end are one. At most `keep` words are remembered.
    """

    def __init__(self, path: str, keep: int = 600_000):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        added = rules.get("added_tokens") or []
        self.marks = sorted({t["content"][:2] for t in added})
        self.words = self._words(rules)
        self.plain = SPACED_LETTERS if self.words is SPACED_WORD else BARE_LETTERS
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.merge = self.tokenizer.model.tokenize
        self.known = Words(self._learn)
        self.keep = keep

    @staticmethod
    def _words(rules: dict) -> re.Pattern | None:
        before, normal = rules.get("pre_tokenizer") or {}, rules.get("normalizer")
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not normal:
            return SPACED_WORD
        steps = [s.get("type") for s in before.get("pretokenizers", [])]
        folds = [n.get("type") for n in (normal or {}).get("normalizers", [])]
        if steps == ["Split", "ByteLevel"] and before["pretokenizers"][0].get("invert") and folds == ["NFC", "Replace", "Lowercase"]:
            return BARE_WORD
        return None

    def _chunks(self, text: str) -> list[list[str]]:
        """Words of a text in chunks of bounded length, cut only between words."""
        chunks, start = [], 0
        while len(text) - start > CHUNK:
            cut = WORD_START.search(text, start + CHUNK)
            if not cut:
                break
            chunks.append(self.words.findall(text, start, cut.start()))
            start = cut.start()
        chunks.append(self.words.findall(text, start))
        return chunks

    def _ids(self, word: str) -> bytes:
        if not self.plain.fullmatch(word):
            return array(self.code, self.tokenizer.encode_batch_fast([word], add_special_tokens=False)[0].ids).tobytes()
        # A run of letters is one unit of the merges: it needs none of the steps before them.
        unit = (word.lower() if self.plain is BARE_LETTERS else word.replace(" ", SPACE_CHAR) if word.isascii() else
                word.encode().decode("latin-1").translate(BYTE_CHARS))
        return array(self.code, [t.id for t in self.merge(unit)]).tobytes()

    def _learn(self, word: str) -> bytes:
        """The ids of a word that is not remembered; a long one is not remembered either."""
        if len(word) > LONGEST_KEPT:
            return self._ids(word)
        core = word.rstrip(PUNCTUATION)
        ends = len(core) < len(word) and core and core[-1] in LETTERS
        made = self.known[core] + self.known[word[len(core):]] if ends else self._ids(word)
        if len(self.known) >= self.keep:
            self.known.clear()
        self.known[word] = made
        return made

    def _whole(self, text: str) -> bool:
        return self.words is None or any(m in text for m in self.marks) or self.words is SPACED_WORD and ODD_SPACE.search(text) is not None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Give a few megabytes of texts at a time."""
        lookup = self.known.__getitem__
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.dtype) if self._whole(t) else
                np.frombuffer(b"".join(map(lookup, chain.from_iterable(self._chunks(t)))), self.dtype) for t in texts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, made once per worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
