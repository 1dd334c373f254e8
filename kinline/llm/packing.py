"""Harmonic packing of tokenised documents into sequences.

A length in (capacity/(k+1), capacity/k] belongs to class k, and each of that class's sequences takes exactly k
documents, whole ones. Lengths of capacity/``CLASSES`` or less are one class, whose sequences take documents as
long as they fit. What k documents leave of a sequence is filled with pieces of filler documents: whenever a
sequence waits for filler, the next document is cut into it, and what is left of that one fills the next.
A document longer than the capacity is cut into whole sequences and a rest that is packed like a document.

Every task fills its own sequences and knows nothing of the others; it holds at most one open sequence for each
class, one that waits for filler, and a rest of filler. When it ends, what these hold is laid in one run that is cut into
whole sequences and sequences of falling powers of two, so nothing is padded.

Words are runs between ASCII white space, and signs after a letter. The tokenizer never joins what these part, so ids are
looked up by word, and only words that a worker hasn't met lately are tokenised.

Defined results: a null or empty text is the end-of-document id alone; repeated rows and null ids are packed
like any other; other columns of the input are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinline.llm import kernels as K
from kinline.llm.common import batch_of, id_and_text, kept, public_id

CAPACITY = 4096
END_ID = 2
CLASSES = 16  # of lengths; those of capacity / CLASSES or less are one class
MEMO_WORDS = 400_000  # words whose ids a task remembers; a longer memory is dropped and begun anew
MEMO_IDS = 4_000_000  # likewise; 16 MB
MEMO_CHARS = 64  # longer words aren't remembered
LINES = 500  # words that are tokenised as one text
BLOCK_BYTES = 1 << 19  # of texts whose words are looked up at once
PLACED = 1_000  # pieces that a task hands over at once, 4 MB or so of ids

PIECES = "_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Fixed value: the split of tokenizers whose ids can be looked up by word.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_word(tokenizer_json: str) -> bool:
    """Whether a tokenizer lower-cases, joins nothing across white space, and parts letters from signs."""
    spec = json.loads(tokenizer_json)
    steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return "Lowercase" in steps and bool(splits) and splits[0].get("pattern", {}).get("Regex") == WORD_SPLIT and all(t["content"].startswith("<|") for t in spec.get("added_tokens", []))


def word_ends(tokenizer_json: str) -> np.ndarray | None:
    """By id: whether a token ends a word; None where the model doesn't mark that."""
    model = json.loads(tokenizer_json)["model"]
    mark = model.get("end_of_word_suffix")
    if model.get("type") != "BPE" or not mark:
        return None
    out = np.zeros(max(model["vocab"].values()) + 1_000, bool)  # and ids of added tokens, which letters alone don't have
    out[[i for t, i in model["vocab"].items() if t.endswith(mark)]] = True
    return out


# Letters that the normalizer leaves as they are, each in one piece with its neighbours whatever the version of Unicode.
LATIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
STEPS = {"NFC", "Replace", "Lowercase"}


def for_latin(tokenizer_json: str) -> str | None:
    """A ``by_word`` tokenizer for words that ``LATIN`` matches, parted by white space: the same model without the normalizer and
    the regular expression, which do nothing to them. None where the normalizer has other steps."""
    spec = json.loads(tokenizer_json)
    steps = spec["normalizer"]["normalizers"]
    if any(n["type"] not in STEPS or n["type"] == "Replace" and n["pattern"] != {"Regex": r"\s+"} for n in steps):
        return None
    spec["normalizer"], spec["added_tokens"] = None, []
    spec["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
    return json.dumps(spec)


class Numbers(dict):
    """Words by number; one that is met for the first time gets the next, and is in ``new`` until it is tokenised."""

    def __init__(self, zero: bytes):
        super().__init__({zero: 0})
        self.next, self.new = 1, []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = self.next
        self.next += 1
        self.new.append(word)
        return n


def _bytes_in(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), [*chars])


class WordIds:
    """Little-endian 32-bit ids of texts, by way of their words.

    The tokenizer lower-cases, so texts are lower-cased in ASCII first, but for capitals before what may be a mark, since
    some marks compose with the small letter alone. Signs after an ASCII letter are always pieces of their own, so they are
    made words of their own. Texts that may hold a special token are only parted by white space. Words are numbered: ``ids``
    has those of number n from ``begin[n]`` on, ``length[n]`` of them; ``END`` is number 0 and has none. All that holds for
    tokenizers of the form that ``by_word`` knows; for any other whole texts are tokenised.
    """

    TAIL = _bytes_in(b",.!?;:#$%&*|)")
    LETTER = _bytes_in(b"abcdefghijklmnopqrstuvwxyz")
    LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
    MARK = 0xCC  # least first byte of a mark in UTF-8
    END = b"\xff"  # after each text; no byte of UTF-8

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.split = Tokenizer.from_str(tokenizer_json), by_word(tokenizer_json)
        self.ends = word_ends(tokenizer_json) if self.split else None
        latin = for_latin(tokenizer_json) if self.ends is not None else None
        self.latin = Tokenizer.from_str(latin) if latin else None
        self._forget()

    def _forget(self) -> None:
        self.numbers = Numbers(self.END)
        self.ids, self.begin, self.length = array("I"), array("q", [0]), array("q", [0])

    def _encode(self, words: list[bytes]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def _encode_lines(self, lines: list[str], tokenizer) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words of letters alone, tokenised as one text, and where each word's end, if each has one id that ends a word; else None.

        Each has at least one, so that as many ends as words are one of each.
        """
        (e,) = tokenizer.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)
        ids = np.array(e.ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        return (ids, ends) if len(ends) == len(lines) else None

    def _alone(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._encode(words)
        return np.frombuffer(b"".join(ids), "<u4"), np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)

    def _learn(self, words: list[bytes]) -> None:
        """Adds the ids of words that have the next numbers; those of letters alone are tokenised by ``LINES`` at a time, which spares
        the tokenizer's cost of each text."""
        texts = b"\n".join(words).decode().split("\n")
        latin, letters, other = [], [], []
        for i, x in enumerate(texts):
            (other if self.ends is None else latin if self.latin and LATIN(x) else letters if x.isalpha() else other).append(i)
        lines = [(tokenizer, some[i : i + LINES]) for tokenizer, some in ((self.latin, latin), (self.tokenizer, letters)) for i in range(0, len(some), LINES)]
        begin, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for tokenizer, some in [*lines, *([(None, other)] if other else [])]:
            got = self._encode_lines([texts[i] for i in some], tokenizer) if tokenizer else None
            ids, ends = got or self._alone([words[i] for i in some])
            length[some] = np.diff(ends, prepend=0)
            begin[some] = len(self.ids) + ends - length[some]
            self.ids.frombytes(ids.astype(np.uint32).tobytes())
        self.begin.frombytes(begin.tobytes())
        self.length.frombytes(length.tobytes())

    def _spaced(self, texts: list[bytes]) -> bytes:
        """All texts, with white space between words and ``END`` as a word after each."""
        space = b" " + self.END + b" "
        joined = space.join([*texts, b""])
        raw = np.frombuffer(joined, np.uint8)
        data = self.LOWER[raw]
        marked = np.flatnonzero(raw[1:] >= self.MARK)
        data[marked] = raw[marked]
        cut = self.LETTER[data[:-1]] & self.TAIL[data[1:]]
        if b"<|" in joined:
            at = 0
            for t in texts:
                if b"<|" in t:
                    data[at : at + len(t)], cut[at : at + len(t)] = raw[at : at + len(t)], False
                at += len(t) + len(space)
        return np.insert(data, np.flatnonzero(cut) + 1, 32).tobytes()

    def of(self, texts: list[bytes]) -> list[bytes]:
        if not self.split:
            return self._encode(texts)
        try:
            out = self._of(texts)
        except BaseException:  # numbers without ids
            self._forget()
            raise
        if self.numbers.next > MEMO_WORDS or len(self.ids) > MEMO_IDS:
            self._forget()
        return out

    def _of(self, texts: list[bytes]) -> list[bytes]:
        words, numbers = self._spaced(texts).split(), self.numbers
        at = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        del words
        if numbers.new:
            self._learn(numbers.new)
            for w in numbers.new:
                if len(w) > MEMO_CHARS:
                    del numbers[w]
            numbers.new = []
        length = np.frombuffer(self.length, np.int64)[at]
        until = np.cumsum(length)
        place = np.repeat(np.frombuffer(self.begin, np.int64)[at] - until + length, length) + np.arange(until[-1] if len(at) else 0)
        ids = np.frombuffer(self.ids, np.uint32)[place].astype("<u4").tobytes()
        ends = (4 * until[at == 0]).tolist()
        if len(ends) != len(texts):
            raise ValueError("a text isn't UTF-8")
        return [ids[i:j] for i, j in zip([0, *ends], ends)]  # noqa: B905  the last end begins nothing


def word_ids(tokenizer_json: str) -> WordIds:
    """The memory of this Python worker, which later tasks find again."""
    return kept(("words", zlib.crc32(tokenizer_json.encode())), lambda: WordIds(tokenizer_json))


class Piece(NamedTuple):
    """Part of a document's ids."""

    doc: int | None
    start: int
    ids: bytes
    total: int  # ids of the whole document

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece | None]:
        """The first n ids, and the others if there are any."""
        if n >= self.length:
            return self, None
        return self._replace(ids=self.ids[: 4 * n]), self._replace(start=self.start + n, ids=self.ids[4 * n :])


class HarmonicPacker:
    """Sequences of one task; ``placed`` gathers (piece, sequence, offset) of those that are done."""

    def __init__(self, capacity: int, first_sequence: int, classes: int = CLASSES):
        if capacity & (capacity - 1):
            raise ValueError("the capacity has to be a power of two")
        self.capacity, self.next, self.classes = capacity, first_sequence, classes
        self.open: dict[int, list[Piece]] = {}
        self.used: dict[int, int] = {}
        self.waiting: list[Piece] = []  # a sequence with its k documents that waits for filler
        self.room = 0
        self.spare: Piece | None = None  # filler; there is none while a sequence waits
        self.placed: list[tuple[Piece, int, int]] = []

    def _emit(self, pieces: list[Piece]) -> None:
        at = 0
        for p in pieces:
            self.placed.append((p, self.next, at))
            at += p.length
        self.next += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        rest: Piece | None = Piece(doc, 0, ids, len(ids) // 4)
        while rest and rest.length >= self.capacity:
            head, rest = rest.cut(self.capacity)
            self._emit([head])
        if rest and self.waiting:
            self._fill(rest)
        elif rest:
            self._into_class(rest)

    def _into_class(self, p: Piece) -> None:
        k = min(self.capacity // p.length, self.classes)
        if self.used.get(k, 0) + p.length > self.capacity:  # only in the class of the shortest
            self._close(k)
        held = self.open.setdefault(k, [])
        held.append(p)
        self.used[k] = self.used.get(k, 0) + p.length
        if k < self.classes and len(held) == k:
            self._close(k)

    def _close(self, k: int) -> None:
        pieces, room = self.open.pop(k), self.capacity - self.used.pop(k)
        if not room:
            return self._emit(pieces)
        self.waiting, self.room = pieces, room
        if self.spare:
            spare, self.spare = self.spare, None
            self._fill(spare)

    def _fill(self, p: Piece) -> None:
        """Filler for the waiting sequence; what is left of it is kept."""
        head, self.spare = p.cut(self.room)
        self.waiting.append(head)
        self.room -= head.length
        if not self.room:
            self._emit(self.waiting)
            self.waiting = []

    def close(self) -> None:
        left = [*self.waiting, *(p for k in sorted(self.open) for p in self.open[k]), *([self.spare] if self.spare else [])]
        tokens, sequence, room = sum(p.length for p in left), [], 0
        for p in left:
            rest: Piece | None = p
            while rest:
                if not room:
                    room = min(self.capacity, 1 << (tokens.bit_length() - 1))
                    tokens -= room
                head, rest = rest.cut(room)
                sequence.append(head)
                room -= head.length
                if not room:
                    self._emit(sequence)
                    sequence = []
        self.open, self.used, self.waiting, self.spare = {}, {}, [], None


def _pack(tokenizer_json, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def rows(placed: list[tuple]) -> pa.RecordBatch:
        pieces, sequence, offset = zip(*placed, strict=True)
        long = lambda x: np.array(x, np.int64)
        return batch_of(
            _id=long([p.doc for p in pieces]), start=long([p.start for p in pieces]), length=long([p.length for p in pieces]), ids=pa.array([p.ids for p in pieces], pa.binary()),
            doc_tokens=long([p.total for p in pieces]), sequence_id=long(sequence), offset=long(offset),
        )

    def run(batches):
        words = word_ids(tokenizer_json.value)
        packer = HarmonicPacker(capacity, TaskContext.get().partitionId() << 33)
        for batch in batches:
            ids = batch.column("_id").to_pylist()
            for b in K.blocks(batch.column("_text"), BLOCK_BYTES):
                for i, tokens in enumerate(words.of([b.text(i) for i in range(b.rows)])):
                    packer.add(ids[b.first_row + i], tokens + end)
                if len(packer.placed) >= PLACED:
                    yield rows(packer.placed)
                    packer.placed = []
        packer.close()
        if packer.placed:
            yield rows(packer.placed)

    return run


def pack(documents: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: (id, start, length, ids, doc_tokens, sequence_id, offset); ``ids`` are little-endian 32-bit."""
    tokenizer = documents.sparkSession.sparkContext.broadcast(Path(tokenizer_path or word_bpe_path()).read_text())
    out = id_and_text(documents, id_col, text_col).mapInArrow(_pack(tokenizer, capacity, end_id), PIECES)
    return out.select(public_id().alias(id_col), "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def with_digest(pieces: DataFrame) -> DataFrame:
    """``ids_crc32`` in place of the ids."""
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")
