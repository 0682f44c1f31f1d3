"""Byte-pair encoding of whole texts, with tree concatenation of long unsplit stretches.

A text is cut at white space, and every distinct word of a chunk is encoded once.  Words
fall into pieces (what the tokenizer never merges across).  A piece longer than ``LEAF``
symbols is encoded as two halves, each in the same way; then a window around the join is
encoded again and grows until the token pairs at both of its edges are ones that the
tokenizer itself would form.  Any sequence of which all adjacent pairs are such pairs is
the tokenizer's own encoding, so the result is exact.

Texts of more than ``PART_CHARS`` characters are cut into parts that Spark encodes in
parallel; parts meet pairwise, round by round, with the same windows where the cut fell
inside a piece.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from patronlens.llm.words import row_ranges, split_words
from patronlens.sources.stages import stage

LEAF = 96
PART_CHARS = 1 << 20
# Pieces that a Python worker remembers between chunks (about 200 bytes each), and words (about 60 bytes each).
REMEMBERED_PIECES = 180_000
REMEMBERED_WORDS = 500_000
_END = np.uint32(2**32 - 1)

# Latin letters and signs on which this module's own splitting is safe; all else goes
# through the tokenizer's own normalizer and splitter.
_PLAIN_LINES = regex.compile(r"[\n\x21-\x7e¡-¬®-įı-ſ]+")
_SPACES = re.compile(r"[ \t-\r]+")
_PIECES_OF_LINES = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def _byte_letters() -> list[str]:
    """The printable character that byte-level tokenizers write for each byte."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


_LETTER = _byte_letters()
# Space stays: it parts pieces that are encoded together.
_LETTERS = {b: c for b, c in enumerate(_LETTER) if b != 0x20}


def _plain(text: bytes) -> bool:
    return b"<|" not in text and _PLAIN_LINES.fullmatch(text.decode()) is not None


@dataclass
class Part:
    """Encoded part of a text; ``head`` and ``tail`` count the tokens of its first and last piece."""

    ids: np.ndarray
    head: int
    tail: int
    pieces: int


def _slices(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``flat[start: start + size]`` for every place, one after another."""
    ends = np.cumsum(size, dtype=np.int64)
    return flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def _starts(size: np.ndarray, begin: int = 0) -> np.ndarray:
    """Where slices of these sizes begin if they stand one after another."""
    return np.cumsum(size, dtype=np.int64) - size + begin


class _KnownWords:
    """Words and their ids in flat arrays, looked up many at a time: by hash, then by their bytes."""

    def __init__(self):
        self._hashes, self._number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self._text, self._start, self._size = np.zeros(0, np.uint8), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.begin, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def __len__(self) -> int:
        return len(self._hashes)

    def find(self, hashes: np.ndarray, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of the words ``text[start: start + size]``, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self):
            return out
        at = np.minimum(np.searchsorted(self._hashes, hashes), len(self) - 1)
        like = np.flatnonzero(self._hashes[at] == hashes)
        number = self._number[at[like]]
        fits = self._size[number] == size[like]
        like, number = like[fits], number[fits]
        if len(like):
            own = size[like]
            same = _slices(self._text, self._start[number], own) == _slices(text, start[like], own)
            equal = np.logical_and.reduceat(same, _starts(own))
            out[like[equal]] = number[equal]
        return out

    def add(self, hashes: np.ndarray, text: np.ndarray, size: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """Words (none empty) in the order of their hashes; ``text`` and ``ids`` hold theirs one after another."""
        number = np.arange(len(self), len(self) + len(hashes), dtype=np.int32)
        at = np.searchsorted(self._hashes, hashes)
        self._hashes, self._number = np.insert(self._hashes, at, hashes), np.insert(self._number, at, number)
        self._start = np.concatenate([self._start, _starts(size, len(self._text)).astype(np.int32)])
        self.begin = np.concatenate([self.begin, _starts(length, len(self.ids)).astype(np.int32)])
        self._size = np.concatenate([self._size, size.astype(np.int32)])
        self.length = np.concatenate([self.length, length.astype(np.int32)])
        self._text, self.ids = np.concatenate([self._text, text]), np.concatenate([self.ids, ids])


class Codec:
    """A tokenizer file of the kind "BPE with word ends over byte letters"."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        merges = [tuple(pair) for pair in model["merges"]]
        self.suffix = model["end_of_word_suffix"] or ""
        self._ending = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=model["end_of_word_suffix"], cache_capacity=0)
        self._open = models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0)
        self._spaced = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=model["end_of_word_suffix"], cache_capacity=0))
        self._spaced.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        # Ids of pieces and of words, kept between chunks; a line feed stands between words.
        self._known: dict[str, bytes] = {"\n": _END.tobytes()}
        self._older = self._known
        self._words = self._older_words = _KnownWords()
        added = {t["content"]: t["id"] for t in described["added_tokens"]}
        self._added = added
        self._added_split = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        texts = {i: t for t, i in {**model["vocab"], **added}.items()}
        self.token_text = np.array([texts.get(i, "") for i in range(max(texts) + 1)], object)
        self._word_end = np.array([t.endswith(self.suffix) for t in self.token_text])

    # Pieces

    def _model_ids(self, letters: str, ends: bool) -> list[int]:
        return [token.id for token in (self._ending if ends else self._open).tokenize(letters)]

    def encode_piece(self, letters: str, ends: bool = True, leaf: int = LEAF) -> list[int]:
        """Ids of one piece in byte letters; ``ends`` says whether its word end belongs to it."""
        if len(letters) <= leaf:
            return self._model_ids(letters, ends)
        middle = len(letters) // 2
        left = self.encode_piece(letters[:middle], False, leaf)
        right = self.encode_piece(letters[middle:], ends, leaf)
        return self.join(left, right, ends)

    def _letters_of(self, ids: Sequence[int], ends: bool) -> str:
        text = "".join(self.token_text[list(ids)])
        return text.removesuffix(self.suffix) if ends else text

    def _agrees(self, first: int, second: int, ends: bool) -> bool:
        """Whether the tokenizer itself leaves these two neighbours as they are."""
        return self._model_ids(self._letters_of((first, second), ends), ends) == [first, second]

    def join(self, left: Sequence[int], right: Sequence[int], ends: bool) -> list[int]:
        """The encoding of a piece from those of its two halves, by growing windows around the join."""
        left, right, width = list(left), list(right), 4
        while True:
            kept, taken = max(len(left) - width, 0), min(width, len(right))
            at_end = ends and taken == len(right)
            window = self._model_ids(self._letters_of([*left[kept:], *right[:taken]], at_end), at_end)
            whole = kept == 0 and taken == len(right)
            before = kept == 0 or self._agrees(left[kept - 1], window[0], at_end and len(window) == 1)
            after = taken == len(right) or self._agrees(window[-1], right[taken], ends and taken == len(right) - 1)
            if whole or before and after:
                return left[:kept] + window + right[taken:]
            width *= 2

    # Words

    def _pieces(self, text: str) -> Iterator[str | int]:
        """Pieces in byte letters, and the ids of special tokens that stand in the text."""
        at = 0
        for found in chain(self._added_split.finditer(text), [None]):
            before = text[at: found.start() if found else len(text)]
            if before:
                normal = self.tokenizer.normalizer.normalize_str(before)
                yield from (piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal))
            if found:
                yield self._added[found.group()]
                at = found.end()

    def _remember_pieces(self, pieces: set[str]) -> None:
        """Encodes pieces (as plain text) that are not known yet, the short ones in few calls."""
        short = [p for p in pieces if len(p) <= LEAF // 2]
        for at in range(0, len(short), 2000):
            group = short[at: at + 2000]
            letters = " ".join(group).encode().decode("latin-1").translate(_LETTERS)
            ids = np.array(self._spaced.encode_batch_fast([letters], add_special_tokens=False)[0].ids, np.uint32)
            # Only the last token of a piece carries the word end.
            data, begin = ids.tobytes(), 0
            for piece, end in zip(group, (4 * np.flatnonzero(self._word_end[ids]) + 4).tolist()):
                self._known[piece] = data[begin:end]
                begin = end
        for piece in pieces:
            if len(piece) > LEAF // 2:
                ids = self.encode_piece(piece.encode().decode("latin-1").translate(_LETTERS))
                self._known[piece] = np.array(ids, np.uint32).tobytes()

    def _encode_plain(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each word has."""
        pieces = _PIECES_OF_LINES.findall(b"\n".join([*words, b""]).decode().lower())
        if len(self._known) > REMEMBERED_PIECES // 2:
            self._older, self._known = self._known, {}
        missing = set(pieces).difference(self._known)
        for piece in missing.intersection(self._older):
            self._known[piece] = self._older[piece]
        self._remember_pieces(missing.difference(self._older))
        flat = np.frombuffer(b"".join(map(self._known.__getitem__, pieces)), np.uint32)
        ends = np.flatnonzero(flat == _END)
        return flat[flat != _END], np.diff(ends, prepend=-1) - 1

    def _encode_odd(self, word: bytes) -> np.ndarray:
        """Ids of a word through the tokenizer's own normalizer and splitter."""
        ids: list[int] = []
        for piece in self._pieces(word.decode()):
            ids.extend((piece,) if isinstance(piece, int) else self.encode_piece(piece))
        return np.array(ids, np.uint32)

    def encode_words(self, words: Sequence[bytes]) -> list[bytes]:
        """Ids of words without ASCII white space, as 32-bit integers."""
        plain, odd = [], []
        for at in range(0, len(words), 500):
            block = words[at: at + 500]
            if _plain(b"\n".join(block)):
                plain.extend(range(at, at + len(block)))
            else:
                for i, word in enumerate(block, at):
                    (plain if _plain(word) else odd).append(i)
        out = [b""] * len(words)
        flat, sizes = self._encode_plain([words[i] for i in plain])
        data, ends = flat.tobytes(), (4 * np.cumsum(sizes)).tolist()
        begin = 0
        for i, end in zip(plain, ends):
            out[i] = data[begin:end]
            begin = end
        for i in odd:
            out[i] = self._encode_odd(words[i]).tobytes()
        return out

    def encode_texts(self, texts: Sequence[bytes]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit integers."""
        words = split_words(texts)
        if not len(words):
            return [np.zeros(0, np.uint32) for _ in texts]
        hashes = words.hashes()
        order = np.argsort(hashes)
        ordered = hashes[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        kind = np.empty(len(words), np.int64)
        kind[order] = np.cumsum(new) - 1
        first, distinct = order[new], ordered[new]
        start, size = words.start[first], words.end[first] - words.start[first]
        if len(self._words) > REMEMBERED_WORDS // 2:
            self._older_words, self._words = self._words, _KnownWords()
        known, older = self._words, self._older_words
        number = known.find(distinct, words.data, start, size)
        rest = np.flatnonzero(number < 0)
        again = older.find(distinct[rest], words.data, start[rest], size[rest])
        seen, unseen = rest[again >= 0], rest[again < 0]
        again = again[again >= 0]
        data = words.data.tobytes()
        made = self.encode_words([data[a: a + n] for a, n in zip(start[unseen].tolist(), size[unseen].tolist())])
        # Where in all ids at hand those of each distinct word are.
        pool = np.concatenate([known.ids, older.ids, np.frombuffer(b"".join(made), np.uint32)])
        begin, length = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        held = number >= 0
        begin[held], length[held] = known.begin[number[held]], known.length[number[held]]
        begin[seen], length[seen] = older.begin[again] + len(known.ids), older.length[again]
        length[unseen] = np.fromiter(map(len, made), np.int64, len(made)) // 4
        begin[unseen] = _starts(length[unseen], len(known.ids) + len(older.ids))
        short = rest[size[rest] <= LEAF]
        text = _slices(words.data, start[short], size[short])
        known.add(distinct[short], text, size[short], _slices(pool, begin[short], length[short]), length[short])
        ids = _slices(pool, begin[kind], length[kind])
        ends = np.cumsum(length[kind])
        cuts = np.concatenate([[0], ends])[words.first]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    # Parts of long texts

    def encode_part(self, text: str, joined_before: bool, joined_after: bool) -> Part:
        """A part of a text; ``joined_*`` says that the cut there fell inside a piece."""
        # Not split(): that also parts at, and drops, U+001C to U+001F, which have tokens.
        pieces = [p for word in _SPACES.split(text) for p in self._pieces(word)]
        sizes, ids = [], []
        for i, piece in enumerate(pieces):
            ends = not (joined_after and i == len(pieces) - 1)
            own = [piece] if isinstance(piece, int) else self.encode_piece(piece, ends)
            sizes.append(len(own))
            ids.extend(own)
        return Part(np.array(ids, np.uint32), sizes[0] if sizes else 0, sizes[-1] if sizes else 0, len(pieces))

    def join_parts(self, a: Part, b: Part, joined: bool, after: bool) -> Part:
        """``joined``: one piece spans the cut; ``after``: b's last piece goes on behind b."""
        if not a.pieces or not b.pieces:
            return b if not a.pieces else a
        if not joined:
            return Part(np.concatenate([a.ids, b.ids]), a.head, b.tail, a.pieces + b.pieces)
        ends = not (after and b.pieces == 1)
        whole = self.join(a.ids[len(a.ids) - a.tail:].tolist(), b.ids[: b.head].tolist(), ends)
        ids = np.concatenate([a.ids[: len(a.ids) - a.tail], np.array(whole, np.uint32), b.ids[b.head:]])
        head = len(whole) if a.pieces == 1 else a.head
        tail = len(whole) if b.pieces == 1 else b.tail
        return Part(ids.astype(np.uint32), head, tail, a.pieces + b.pieces - 1)

    def cuts(self, text: str, size: int) -> tuple[list[str], list[bool]]:
        """Parts of about ``size`` characters, and for each cut whether it fell inside a piece."""
        parts, joins, at = [], [], 0
        while len(text) - at > size:
            cut, inside = self._cut_near(text, at + size // 2, at + size)
            parts.append(text[at:cut])
            joins.append(inside)
            at = cut
        return [*parts, text[at:]], joins

    def _cut_near(self, text: str, low: int, high: int) -> tuple[int, bool]:
        for spaced in (i for i in range(high, low, -1) if text[i] in " \t\n\r\v\f"):
            return spaced, False
        for cut in range(high, low, -1):
            near = text[cut - 16: cut + 16]
            normal = unicodedata.normalize
            apart = normal("NFC", text[cut - 16: cut]) + normal("NFC", text[cut: cut + 16])
            if normal("NFC", near) == apart and all(c.isalpha() for c in text[cut - 4: cut + 4]):
                pieces = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text[cut - 1: cut + 1].lower())]
                if len(pieces) == 1:
                    return cut, True
        # Neither space nor a run of letters near: the whole stretch stays together.
        after = regex.compile(r"[ \t-\r]").search(text, high)
        return (after.start(), False) if after else (len(text), False)

    def decode(self, ids: np.ndarray) -> str:
        """What the tokenizers library gives without a decoder: token texts with a space between."""
        return " ".join(self.token_text[ids].tolist())


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a tokenizer file, loaded once in each Python process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str, *, key: str = "doc_id", part_chars: int = PART_CHARS) -> DataFrame:
    """``key``, ``ids`` (binary, unsigned 32-bit little-endian) and ``decoded`` for every row.

    A null text counts as empty.  Equal keys are kept apart row by row; other columns do
    not matter.  ``path`` must exist on every executor, as installed packages do.
    """
    source = docs.select(F.col(key).alias("key"), F.col("text").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    long_text = F.length("text") > part_chars

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for rows, texts in row_ranges(batches):
            ids = own.encode_texts(texts)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array([own.decode(i) for i in ids], pa.string())],
                ["key", "ids", "decoded"],
            )

    shape = f"key {kind}, ids binary, decoded string"
    encoded = source.where(~F.coalesce(long_text, F.lit(False))).mapInArrow(short, shape)
    longer = source.where(long_text)
    if not longer.isEmpty():
        encoded = encoded.unionByName(_encode_long(longer, path, kind, part_chars))
    return encoded.withColumnRenamed("key", key)


_PART = "row string, number long, parts long, ids binary, head long, tail long, pieces long, joined boolean"


def _encode_long(longer: DataFrame, path: str, kind: str, part_chars: int) -> DataFrame:
    # A row of its own for each text: a key may repeat or be null.
    named = stage(longer.withColumn("row", F.expr("uuid()")), "long-texts")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for frame in frames:
            for row, text in zip(frame["row"], frame["text"]):
                parts, joins = own.cuts(text, part_chars)
                for i, part in enumerate(parts):
                    before, after = (i > 0 and joins[i - 1]), (i < len(joins) and joins[i])
                    yield pd.DataFrame([(row, i, len(parts), part, before, after)], columns=["row", "number", "parts", "text", "before", "after"])

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for frame in frames:
            for r in frame.itertuples():
                part = own.encode_part(r.text, r.before, r.after)
                yield pd.DataFrame([(r.row, r.number, r.parts, part.ids.tobytes(), part.head, part.tail, part.pieces, r.after)], columns=[c.split()[0] for c in _PART.split(", ")])

    cut_rows = named.select("row", "text").mapInPandas(cut, "row string, number long, parts long, text string, before boolean, after boolean")
    parts = stage(cut_rows.repartition(F.col("row"), F.col("number")).mapInPandas(encode, _PART), "text-parts")

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        own = codec(path)
        rows = frame.sort_values("number")
        made = [Part(np.frombuffer(r.ids, np.uint32), r.head, r.tail, r.pieces) for r in rows.itertuples()]
        joined, after = bool(rows["joined"].iloc[0]), bool(rows["joined"].iloc[-1])
        part = own.join_parts(made[0], made[1], joined, after) if len(made) == 2 else made[0]
        number, count = int(rows["number"].iloc[0]) // 2, (int(rows["parts"].iloc[0]) + 1) // 2
        return pd.DataFrame([(rows["row"].iloc[0], number, count, part.ids.tobytes(), part.head, part.tail, part.pieces, after)], columns=frame.columns)

    while parts.where("parts > 1").limit(1).count():
        pair = F.floor(F.col("number") / 2)
        parts = stage(parts.groupBy("row", pair).applyInPandas(lambda frame: meet(frame), _PART), "text-parts")

    def spell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for frame in frames:
            yield frame.assign(decoded=[own.decode(np.frombuffer(i, np.uint32)) for i in frame["ids"]])

    whole = parts.join(named.select("row", "key"), "row").select("key", "ids").mapInPandas(spell, f"key {kind}, ids binary, decoded string")
    return whole


def ids_sha256(ids: Column) -> Column:
    return F.sha2(ids, 256)
