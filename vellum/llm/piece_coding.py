"""SentencePiece merge models: exact encoding by backtracking, and decoding.

A merge model joins, again and again, the two neighbours whose joined text is the best piece, the leftmost of equally good
ones. What comes out is known by its neighbours alone: a row of pieces is the encoding of its text exactly when every
piece encodes to itself and every two adjacent pieces, joined and merged anew, fall into the same two. So the encoder need
not merge the text. An Aho-Corasick automaton finds the longest piece that starts at each place. From the left, the longest
piece that is compatible with the one before is taken; where none is, the place is marked as failed in a bitfield, the piece
before is taken back, and its next shorter prefix is tried. As no place fails twice, the work is linear in the text.

Compatibility is remembered for each pair, and so are whole words where no piece spans a word's border; all such memories
are bounded in characters. Characters that no piece has become their bytes' pieces, as the model has them, or the unknown.
"""

import re
from array import array
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vellum.llm import common

SPACE = "▁"
LONGEST_KEPT = 64  # characters of a word that is remembered
KEPT_CHARS = 4_000_000  # characters of all remembered words
KEPT_PAIRS = 1_000_000
CHUNK = 1_000_000  # characters of a text whose words are listed at a time


class Pieces:
    """The encoder and decoder of one model file."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalize = model.normalize
        ids = range(model.vocab_size())
        self.text = [model.id_to_piece(i) for i in ids]
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        self.control = {i for i in ids if model.is_control(i)}
        self.byte = {int(self.text[i][3:5], 16): i for i in ids if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        plain = [i for i in ids if i not in self.control and i not in self.byte_of and i != self.unknown and not model.is_unused(i)]
        self.id = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: model.get_score(i) for i in plain}
        self.chars = {c for piece in self.id for c in piece}
        self.shorter: dict[int, int] = {}  # the longest piece that is a proper prefix; filled when first asked for
        self.sound: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.kept = 0
        # What a piece adds to decoded text on its own; bytes beyond ASCII and the unknown piece need their neighbours.
        self.plain = ["" if i in self.control else chr(self.byte_of[i]) if i in self.byte_of else self.text[i].replace(SPACE, " ") for i in ids]
        self.joined = np.array([i == self.unknown or self.byte_of.get(i, 0) > 0x7F for i in ids])
        self.found = ahocorasick.Automaton()
        for piece, at in self.id.items():
            self.found.add_word(piece, (len(piece), at))
        self.found.make_automaton()
        # Words may be encoded one by one only if no piece goes on into the next word.
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id)
        breaks = "".join(c for c in "\n\t" if c not in self.chars)
        self.word = re.compile(f"[{breaks}]|{SPACE}*[^{SPACE}{breaks}]+|{SPACE}+" if breaks else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def merged(self, text: str) -> list[str]:
        """`text` by the model's rule itself, merge after merge; used on two pieces at most."""
        parts = list(text)
        while len(parts) > 1:
            best = None
            for at in range(len(parts) - 1):
                score = self.score.get(parts[at] + parts[at + 1])
                if score is not None and (best is None or score > best[0]):
                    best = score, at
            if best is None:
                break
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def _is_sound(self, piece: int) -> bool:
        """Whether a piece encodes to itself."""
        if piece not in self.sound:
            self.sound[piece] = self.merged(self.text[piece]) == [self.text[piece]]
        return self.sound[piece]

    def _shorter(self, piece: int) -> int:
        """The next shorter piece with the same start, -1 if there is none."""
        if piece not in self.shorter:
            text = self.text[piece]
            self.shorter[piece] = next((self.id[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.id), -1)
        return self.shorter[piece]

    def _compatible(self, left: int, right: int) -> bool:
        key = left * len(self.text) + right
        if key not in self.pairs:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            first, second = self.text[left], self.text[right]
            self.pairs[key] = self.merged(first + second) == [first, second]
        return self.pairs[key]

    def _known(self, text: str) -> list[int]:
        """The ids of a text all of whose characters are in pieces."""
        longest = [-1] * (len(text) + 1)
        for last, (length, piece) in self.found.iter(text):
            longest[last - length + 1] = piece  # matches come by their end, so the longest of a start comes last
        open_ = bytearray(b"\xff") * ((len(text) >> 3) + 1)  # a bit per place, off where nothing that fits goes on
        made: list[int] = []
        at, piece = 0, longest[0]
        while at < len(text) or piece >= 0:
            before = made[-1] if made else -1
            while piece >= 0:
                end = at + len(self.text[piece])
                if open_[end >> 3] >> (end & 7) & 1 and self._is_sound(piece) and (before < 0 or self._compatible(before, piece)):
                    break
                piece = self._shorter(piece)
            if piece >= 0:
                made.append(piece)
                at = end
                piece = longest[at]
            else:  # nothing goes on from here: take the piece before back and try its prefixes
                if not made:
                    raise ValueError("the model cannot spell a text of its own characters")
                open_[at >> 3] &= ~(1 << (at & 7)) & 0xFF
                piece = made.pop()
                at -= len(self.text[piece])
        return made

    def _bytes(self, char: str) -> list[int]:
        own = [self.byte.get(b, self.unknown) for b in char.encode()]
        return own if self.byte else [self.unknown]

    def encode_word(self, text: str) -> list[int]:
        """The ids of normalised text."""
        if self.chars.issuperset(text):
            return self._known(text)
        ids: list[int] = []
        for known, run in self._runs(text):
            if known:
                ids += self._known(run)
            elif self.byte:
                ids += chain.from_iterable(map(self._bytes, run))
            else:
                ids.append(self.unknown)  # a run of unknown characters is one
        return ids

    def _runs(self, text: str):
        start = 0
        for at in range(1, len(text) + 1):
            if at == len(text) or (text[at] in self.chars) != (text[start] in self.chars):
                yield text[start] in self.chars, text[start:at]
                start = at

    def _word(self, word: str) -> bytes:
        made = self.words.get(word)
        if made is None:
            made = array("I", self.encode_word(word)).tobytes()
            if len(word) <= LONGEST_KEPT:
                if self.kept > KEPT_CHARS:
                    self.words.clear()
                    self.kept = 0
                self.words[word] = made
                self.kept += len(word)
        return made

    def encode(self, text: str) -> np.ndarray:
        """The ids of `text`, with begin and end ids."""
        normal = self.normalize(text)
        if self.by_word:
            parts, start = [], 0
            while start < len(normal):
                stop = normal.find(SPACE, start + CHUNK)
                stop = stop if stop > 0 and normal[stop - 1] != SPACE else len(normal)  # only before a word
                parts.append(b"".join(map(self._word, self.word.findall(normal, start, stop))))
                start = stop
            body = b"".join(parts)
        else:
            body = array("I", self.encode_word(normal)).tobytes()
        return np.frombuffer(b"".join((array("I", [self.begin]).tobytes(), body, array("I", [self.end]).tobytes())), "<u4")

    def _bytes_text(self, data: bytes) -> str:
        """Byte pieces as text; a byte that is part of no character is one replacement character."""
        made = []
        while data:
            try:
                made.append(data.decode())
                break
            except UnicodeDecodeError as error:
                made.append(data[:error.start].decode() + "�")
                data = data[error.start + 1:]
        return "".join(made)

    def decode(self, ids: np.ndarray) -> str:
        """The text of any ids: byte pieces joined to characters, control pieces left out, the first space taken away."""
        pieces_ = ids.tolist()
        first = next((p for p in pieces_ if p not in self.control), self.unknown)
        spaced = first not in self.byte_of and first != self.unknown and self.text[first].startswith(SPACE)
        if not self.joined[ids.astype(np.int64)].any():
            return "".join(map(self.plain.__getitem__, pieces_))[spaced:]
        made, pending = [], bytearray()
        for piece in pieces_:
            if piece in self.byte_of:
                pending.append(self.byte_of[piece])
                continue
            if pending:
                made.append(self._bytes_text(bytes(pending)))
                pending.clear()
            made.append(" ⁇ " if piece == self.unknown else self.plain[piece])
        if pending:
            made.append(self._bytes_text(bytes(pending)))
        return "".join(made)[spaced:]


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The coder of a file, made once per worker."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def coded(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The ids of every text as little-endian unsigned 32-bit integers, and the text decoded from them: doc_id, n_tokens, ids, decoded.

    A null text is empty: begin and end ids alone, decoded to an empty text. Null ids are passed on, repeated rows each give their
    row, an empty table gives none, and other columns are left out. A text is encoded whole, however long, in memory in
    proportion to it. `model` is a file that every worker has.
    """
    def code(batches):
        own = pieces(model)
        for batch in batches:
            ids, texts = batch.column("doc_id"), common.strings(batch)
            for some in common.slices(texts):
                made = [own.encode(t) for t in texts[some.start:some.stop]]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(some.start, len(some)), pa.array([len(m) for m in made], pa.int64()),
                     pa.array([m.tobytes() for m in made], pa.binary()), pa.array([own.decode(m) for m in made], pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return common.mapped(rows, code, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`coded` with SHA-256 digests in place of ids and text; see there for nulls and the like."""
    return coded(docs, model, doc_id, text).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
