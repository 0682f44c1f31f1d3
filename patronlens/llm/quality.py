"""Quality rules: counts on each text, and for each language a band of n-gram perplexity.

The language models are modified Kneser-Ney models over the last 1, 2, 3 and 4 bytes; a
text's perplexity is the geometric mean of its perplexities under the four.  The long ones know how a
text goes on, the short ones how usual its bytes are.  Spark counts the n-grams of all
documents, lower orders count distinct continuations, and discounts come from the counts of
counts, all for each language apart.  An n-gram that was seen once is the reading text's own, so
nothing that is looked up knows of it: it has its part in counts and discounts only.

Values are kept as sorted arrays of 64-bit n-gram hashes.  A model may be larger than an executor
should hold: it is then parted by the byte before the predicted one into slices of at most
``SLICE_ENTRIES`` n-grams (or one such byte), and the texts are read once for each slice.  No n-gram is left
out at any size, and no more than a slice is ever on the driver.

Texts are read as bytes, digits as 0 and white space as one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from patronlens.llm.words import Words, mixed, row_ranges, split_words
from patronlens.sources.stages import released, stage

ORDER = 4
SLICE_ENTRIES = 4_000_000
BLOCK = 1 << 17
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
REPEAT_WINDOW = 8
# Bands: so many (scaled) median deviations around the language's median.
BAND_DEVIATIONS = 6.0
# Below the median the band reaches to half of it at least: copies of a text lower its perplexity, and say nothing against it.
BAND_BELOW = 0.301

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_READ = np.arange(256, dtype=np.uint8)
_READ[48:58] = 48
_READ[9:14] = 32
_READ[0] = 1


# Counts on the text


def _repeated_words(words: Words) -> np.ndarray:
    """For each text, the words that lie in a window occurring twice or more in that text."""
    at, hashes = words.windows(words.hashes(), REPEAT_WINDOW)
    counts = np.zeros(len(words.first) - 1, np.int64)
    if not len(at):
        return counts
    own = mixed(hashes + words.text_of()[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own)
    ordered = own[order]
    same = ordered[1:] == ordered[:-1]
    twice = at[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + REPEAT_WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    return covered[words.first[1:]] - covered[words.first[:-1]]


def _per_text(words: Words, counted: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(counted)])
    return sums[words.text_start[1:]] - sums[words.text_start[:-1]]


def _duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def text_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    words = split_words(texts)
    data = words.data
    inside = np.zeros(len(data) + 1, np.int8)
    inside[words.start] += 1
    inside[words.end] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    return {
        "n_words": words.counts,
        "word_chars": _per_text(words, inside & ((data & 0xC0) != 0x80)),
        "n_symbols": _per_text(words, _SYMBOLS[data]),
        "n_dup_lines": np.fromiter(map(_duplicate_lines, texts), np.int64, len(texts)),
        "n_repeat_words": _repeated_words(words),
    }


# N-grams


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the last ``ORDER`` bytes at every byte of the texts as read, and where each text's begin."""
    pad = b"\0" * (ORDER - 1)
    joined = np.frombuffer(pad.join([b"", *texts]), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes + ORDER - 1) - sizes
    pads = np.zeros(len(joined), bool)
    for i in range(1, ORDER):
        pads[begins - i] = True
    read = _READ[joined]
    read[pads] = 0
    space = read == 32
    keep = ~(space & np.concatenate([[False], space[:-1]]))
    scored = keep & ~pads
    codes = read[keep].astype(np.uint32)
    last = codes.copy()
    for i in range(1, ORDER):
        codes[i:] |= last[:-i] << np.uint32(8 * i)
    before = np.concatenate([[0], np.cumsum(scored)])
    return codes[~pads[keep]], np.append(before[begins], before[-1])


def _by_language(rows: pa.RecordBatch, texts: list[bytes]) -> Iterator[tuple[str, list[int]]]:
    groups: dict[str, list[int]] = {}
    for i, lang in enumerate(rows.column("lang").to_pylist()):
        groups.setdefault(lang, []).append(i)
    yield from groups.items()


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang, gram, n`` over all texts of ``docs`` (lang not null, text)."""
    flush_at = 3_000_000

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, counts = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(codes)
        codes = codes[order]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        return codes[first], np.add.reduceat(counts[order], first)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, counts = merged(parts)
                for at in range(0, len(codes), 100_000):
                    part = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(codes[part]), pa.string()), pa.array(codes[part].astype(np.int64)), pa.array(counts[part])],
                        ["lang", "gram", "n"],
                    )

        for rows, texts in row_ranges(batches):
            for lang, own in _by_language(rows, texts):
                codes, _ = _grams([texts[i] for i in own])
                if len(codes):
                    codes.sort()
                    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
                    held.setdefault(lang, []).append((codes[first], np.diff(np.append(first, len(codes)))))
                    size += len(first)
            if size > flush_at:
                held = {lang: [merged(parts)] for lang, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > flush_at // 2:
                    yield from flushed()
                    held, size = {}, 0
        yield from flushed()

    counted = docs.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(grams: DataFrame) -> list[DataFrame]:
    """Stage tables ``lang, gram, n, value, shorter, rest, shorter_rest`` for 1 to ``ORDER`` bytes.

    With P_k the model over k bytes, ``value`` is the sum of log10 P_1 to log10 P_k of the n-gram's
    last byte, ``rest`` the mass that its history leaves to back-off in P_k.  ``shorter`` is the log10
    probability, and ``shorter_rest`` that mass, where the n-gram is a lower order of a longer model.
    """
    raw, continued = {ORDER: grams}, {}
    for size in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * size) - 1)).alias("gram")
        raw[size] = stage(raw[size + 1].groupBy("lang", suffix).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_before")), "grams")
        continued[size] = raw[size].select("lang", "gram", F.col("n_before").alias("n"))
    out: list[DataFrame] = []
    for size in range(1, ORDER + 1):
        table = _discounted(raw[size], size)
        if size < ORDER:
            lower = _discounted(continued[size], size).select("lang", "gram", F.col("own").alias("lower_own"), F.col("rest").alias("shorter_rest"))
            table = table.join(lower, ["lang", "gram"])
        else:
            table = table.withColumns({"lower_own": F.lit(0.0), "shorter_rest": F.lit(1.0)})
        if size == 1:
            below, before = F.lit(1.0 / 256), F.lit(0.0)
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * (size - 1)) - 1))
            shorter = out[-1].select("lang", F.col("gram").alias("suffix"), F.col("value").alias("before"), F.col("shorter").alias("below"))
            table = table.withColumn("suffix", suffix).join(shorter, ["lang", "suffix"])
            below, before = F.pow(F.lit(10.0), "below"), F.col("before")
        out.append(stage(table.select(
            "lang", "gram", "n", (before + F.log10(F.col("own") + F.col("rest") * below)).alias("value"),
            F.log10(F.col("lower_own") + F.col("shorter_rest") * below).alias("shorter"), "rest", "shorter_rest",
        ), f"order-{size}"))
    return out


def _discounted(table: DataFrame, size: int) -> DataFrame:
    """``lang, gram, n`` with the discounted share ``own`` of each n-gram in its history, and the history's ``rest``."""
    ones, twos, threes, fours = (F.count_if(F.col("n") == i) for i in (1, 2, 3, 4))
    share = ones / F.nullif(ones + 2 * twos, F.lit(0))

    def discount(i: int, upper: Column, below: Column) -> Column:
        value = F.lit(float(i)) - (i + 1) * share * upper / F.when(below > 0, below)
        return F.greatest(F.lit(0.0), F.least(F.lit(float(i)), F.coalesce(value, F.lit(0.5 * i))))

    discounts = table.groupBy("lang").agg(
        discount(1, twos, ones).alias("d1"), discount(2, threes, twos).alias("d2"), discount(3, fours, threes).alias("d3")
    )
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    # At most 256 n-grams share a history.
    alike = Window.partitionBy("lang", F.shiftrightunsigned("gram", 8))
    # One row a language.
    seen = table.join(F.broadcast(discounts), "lang").withColumn("own", (F.col("n") - cut) / F.sum("n").over(alike))
    rest = F.greatest(F.lit(1e-12), F.lit(1.0) - F.sum("own").over(alike))
    return seen.withColumn("rest", rest).select("lang", "gram", "n", "own", "rest")


@dataclass
class HashArray:
    """Values by key: sorted 64-bit hashes of the keys, found through a table over their top bits."""

    hashes: np.ndarray
    values: np.ndarray
    shift: np.uint64
    begins: np.ndarray
    longest: int

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> HashArray:
        hashes = mixed(keys.astype(np.uint64))
        order = np.argsort(hashes)
        hashes = hashes[order]
        bits = max(int(len(hashes)).bit_length(), 1)
        shift = np.uint64(64 - bits)
        begins = np.searchsorted(hashes >> shift, np.arange(2**bits + 1, dtype=np.uint64)).astype(np.int32)
        longest = int(np.diff(begins).max()) if len(hashes) else 0
        # Never reached by a lookup's last step, but read by it.
        spare = np.zeros(longest + 1, np.uint64)
        return cls(np.concatenate([hashes, spare]), np.append(values[order], np.zeros(longest + 1)).astype(np.float32), shift, begins, longest)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its value (0 where it is not)."""
        hashes = mixed(keys.astype(np.uint64))
        at = self.begins[hashes >> self.shift]
        place = np.full(len(keys), -1, np.int32)
        open_ = np.arange(len(keys))
        for _ in range(self.longest):
            got = self.hashes[at]
            same = got == hashes
            place[open_[same]] = at[same]
            on = got < hashes
            if not on.any():
                break
            open_, at, hashes = open_[on], at[on] + 1, hashes[on]
        found = place >= 0
        return found, np.where(found, self.values[place], np.float32(0))


# By language and size: value, value as a lower order, and the rests of histories in both places.
Model = dict[str, dict[int, tuple[HashArray, HashArray, HashArray, HashArray]]]


def slices(orders: list[DataFrame], entries: int = SLICE_ENTRIES) -> tuple[int, dict[str, np.ndarray]]:
    """Number of slices, and for each language the slice of every byte before the predicted one.

    The driver sees at most 256 sizes a language.
    """
    before = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit(255)).alias("byte")
    sizes = orders[1].select("lang", before, F.lit(1).alias("n"))
    for table in orders[2:]:
        sizes = sizes.unionByName(table.select("lang", before, F.lit(1).alias("n")))
    number, filled, where = 0, 0, {}
    for row in sorted(sizes.groupBy("lang", "byte").agg(F.sum("n").alias("n")).collect()):
        if filled and filled + row["n"] > entries:
            number, filled = number + 1, 0
        filled += row["n"]
        where.setdefault(row["lang"], np.zeros(256, np.int64))[row["byte"]] = number
    return number + 1, where


def collect_model(orders: list[DataFrame], number: int = 0, where: dict[str, np.ndarray] | None = None) -> Model:
    """One slice of the model as hash arrays; the whole model without ``where``."""
    arrays: Model = {}
    nothing = HashArray.of(np.zeros(0, np.int64), np.zeros(0))
    for size, table in enumerate(orders, 1):
        if where is not None and size > 1:
            spark = table.sparkSession
            own = [(lang, int(byte)) for lang, of in where.items() for byte in np.flatnonzero(of == number)]
            chosen = spark.createDataFrame(own, "lang string, byte long")
            byte = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit(255))
            table = table.withColumn("byte", byte).join(F.broadcast(chosen), ["lang", "byte"], "left_semi")
        frame = table.select("lang", "gram", "n", "value", "shorter", F.log10("rest").alias("rest"), F.log10("shorter_rest").alias("shorter_rest"))
        for lang, rows in frame.toArrow().to_pandas().groupby("lang"):
            histories, first = np.unique(rows["gram"].to_numpy() >> 8, return_index=True)
            # Seen once: the reading text's own.
            others = rows[rows["n"] > 1]
            grams = others["gram"].to_numpy()
            arrays.setdefault(lang, {})[size] = (
                HashArray.of(grams, others["value"].to_numpy()), HashArray.of(grams, others["shorter"].to_numpy()),
                HashArray.of(histories, rows["rest"].to_numpy()[first]), HashArray.of(histories, rows["shorter_rest"].to_numpy()[first]),
            )
    for own in arrays.values():
        for size in range(1, ORDER + 1):
            own.setdefault(size, (nothing,) * 4)
    return arrays


def log10_probabilities(model: dict[int, tuple[HashArray, ...]], codes: np.ndarray) -> np.ndarray:
    """For every code the sum of log10 P_k(last byte | the k - 1 before it) over k = 1 to ORDER.

    A code that is missing down to size k takes ``value`` there, and for each of the longer models the
    ``shorter`` value there and the rests on its way down.
    """
    if len(codes) > BLOCK:
        return np.concatenate([log10_probabilities(model, codes[at: at + BLOCK]) for at in range(0, len(codes), BLOCK)])
    result = np.zeros(len(codes), np.float32)
    open_ = np.arange(len(codes))
    for size in range(ORDER, 0, -1):
        longer = np.float32(ORDER - size)
        grams, lower, rests, lower_rests = model[size]
        own = codes[open_] & np.uint32((1 << 8 * size) - 1)
        found, value = grams.find(own)
        at = open_[found]
        result[at] += value[found]
        if longer and len(at):
            result[at] += longer * lower.find(own[found])[1]
        open_, own = open_[~found], own[~found]
        if not len(open_):
            return result
        result[open_] += rests.find(own >> np.uint32(8))[1]
        if longer:
            result[open_] += longer * lower_rests.find(own >> np.uint32(8))[1]
    result[open_] -= np.float32(ORDER * np.log10(256.0))
    return result


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score_documents(docs: DataFrame, model: Model, *, key: str = "doc_id", number: int = 0, where: dict | None = None) -> DataFrame:
    """``key, lang, mark`` (a hash of the text), counts, number of bytes read and their summed log10 probabilities.

    With ``where``, only the bytes of slice ``number`` are looked up.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, where))
    kind = docs.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, slice_of = shared.value
        for rows, texts in row_ranges(batches):
            for lang, own in _by_language(rows, texts):
                read = [texts[i] for i in own]
                counts = text_counts(read)
                size, total = np.zeros(len(read), np.int64), np.zeros(len(read))
                codes, starts = _grams(read)
                if len(codes):
                    here = np.ones(len(codes), bool)
                    if slice_of is not None:
                        here = slice_of.get(lang, np.zeros(256, np.int64))[codes >> np.uint32(8) & np.uint32(255)] == number
                    scores = np.zeros(len(codes))
                    scores[here] = log10_probabilities(arrays.get(lang) or _nothing(), codes[here])
                    sums = np.concatenate([[0.0], np.cumsum(scores)])
                    total = sums[starts[1:]] - sums[starts[:-1]]
                    size = np.diff(starts)
                taken = rows.take(pa.array(own))
                yield pa.RecordBatch.from_pydict({
                    "key": taken.column("key"), "lang": taken.column("lang"), "mark": taken.column("mark"),
                    **{n: pa.array(counts[n].astype(np.int64)) for n in _COUNTS}, "n_read": pa.array(size), "total": pa.array(total),
                })

    shape = f"key {kind}, lang string, mark long, {', '.join(f'{n} long' for n in _COUNTS)}, n_read long, total double"
    rows = docs.select(F.col(key).alias("key"), _lang(docs).alias("lang"), F.col("text").alias("text"), F.xxhash64("text").alias("mark"))
    return rows.mapInArrow(score, shape)


def _nothing() -> dict[int, tuple[HashArray, ...]]:
    return {size: (HashArray.of(np.zeros(0, np.int64), np.zeros(0)),) * 4 for size in range(1, ORDER + 1)}


def perplexities(docs: DataFrame, orders: list[DataFrame], *, key: str = "doc_id", entries: int = SLICE_ENTRIES) -> DataFrame:
    """``key, lang``, counts, ``n_read`` and ``log10_perplexity`` of every row of ``docs``; one reading of the texts for each slice."""
    count, where = slices(orders, entries)
    if count == 1:
        scored = score_documents(docs, collect_model(orders), key=key)
    else:
        parts = [stage(score_documents(docs, collect_model(orders, i, where), key=key, number=i, where=where), "slice") for i in range(count)]
        row = ["key", "lang", "mark"]
        # Rows alike in all of these have one sum in each slice.
        sums = None
        for part in parts:
            own = part.groupBy(*row).agg(F.max("total").alias("total"))
            sums = own if sums is None else sums.unionByName(own)
        sums = sums.groupBy(*row).agg(F.sum("total").alias("total")).select(*[F.col(c).alias(f"of_{c}") for c in row], "total")
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in row])
        scored = parts[0].drop("total").join(sums, same)
    mean = -F.col("total") / (ORDER * F.greatest("n_read", F.lit(1)))
    return scored.select("key", "lang", *_COUNTS, "n_read", mean.alias("log10_perplexity"))


def _lang(docs: DataFrame) -> Column:
    return F.coalesce(F.col("lang"), F.lit("und")) if "lang" in docs.columns else F.lit("und")


def quality_rules(docs: DataFrame, *, key: str = "doc_id", entries: int = SLICE_ENTRIES) -> DataFrame:
    """One row per row of ``docs`` (key, text, lang): counts, perplexity, its band, ``base_failed`` and ``kept``.

    A null text has no words and fails the base rules.  A null language counts as one
    language of its own.  Bands come from each language's median and median deviation
    over the *different* values of texts that pass the base rules, so that copies have no
    weight.  Texts shorter than usual, whose perplexity varies more, have wider bands.  Rows
    alike have equal results; a language all of whose texts have one perplexity keeps that one.
    """
    read = docs.select(_lang(docs).alias("lang"), F.col("text").alias("text"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    # The model's tables go once all texts are scored.
    with released() as keep:
        orders = kneser_ney(stage(count_grams(read), "grams"))
        scored = perplexities(docs, orders, key=key, entries=entries).withColumnRenamed("key", key).withColumn("base_failed", failed)
        scored = keep(scored, "quality")
    # One row a language.
    bands = perplexity_bands(scored.where(~F.col("base_failed")))
    wider = F.sqrt(F.greatest(F.lit(1.0), F.col("usual_words") / F.greatest(F.col("n_words"), F.lit(1))))
    banded = scored.join(F.broadcast(bands), "lang", "left").withColumns(
        {"lower": F.col("median") - F.greatest(F.lit(BAND_BELOW), F.col("width")) * wider, "upper": F.col("median") + F.col("width") * wider}
    )
    inside = F.round("log10_perplexity", 6).between(F.round("lower", 6), F.round("upper", 6))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return banded.withColumn("kept", kept).drop("median", "width", "usual_words")


def perplexity_bands(scored: DataFrame) -> DataFrame:
    """``lang, median, width, usual_words``: the middle of log10 perplexity and the half width of its band at ``usual_words`` words."""
    different = scored.select("lang", F.round("log10_perplexity", 6).alias("x")).distinct()
    middle = different.groupBy("lang").agg(F.percentile_approx("x", 0.5, 10_000).alias("median"))
    deviation = F.percentile_approx(F.abs(F.col("x") - F.col("median")), 0.5, 10_000)
    spread = different.join(F.broadcast(middle), "lang").groupBy("lang", "median").agg((F.lit(BAND_DEVIATIONS * 1.4826) * deviation).alias("width"))
    return spread.join(scored.groupBy("lang").agg(F.percentile_approx("n_words", 0.5, 10_000).alias("usual_words")), "lang")
