"""Secrets in texts: three fixed patterns, and values in credential contexts that are hard to guess.

A value in a credential context (``pwd: ...``, ``login = ...``, ``://user:value@``, and the
values of the first pattern) is cut into segments so that an attacker who knows the cut
needs the fewest guesses: words (with capitals and look-alike digits), dates, repeats of a
block, walks over neighbouring keys, and spans tried by brute force.  A dynamic program
over the end positions finds the cheapest cut; its cost is the decimal logarithm of the
guesses.  Values that cost at least ``MIN_GUESSES_LOG10`` are secrets of kind ``guess``.

A word costs the logarithm of its rank in ``COMMON_WORDS``, or of one over its share of all
words of the texts, whichever is less.  Spark counts the words and joins the counts to the
letter runs of the values, so no dictionary travels to the tasks.  What values hold is not
counted: a secret, or its copies, must not make its own letters a known word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping, Sequence
from math import expm1, inf, log, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from patronlens.llm.words import row_ranges
from patronlens.sources.stages import released, stage

MIN_GUESSES_LOG10 = 8.0
KINDS = ("assign", "access", "hex", "guess")

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_CONTEXT = re.compile(
    r"(?:(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|credentials?|login|auth(?:orization)?"
    r"|(?:api|access|private|secret)[_-]?key)[\"']?[ \t]*[:=][ \t]*(?:bearer[ \t]+)?[\"']?([^\s\"'<>,;]+)"
    r"|://[^\s/:@]+:([^\s/@]+)@)",
    re.I | re.A,
)
_CONTEXT_HINTS = (b"pass", b"pwd", b"pin", b"secret", b"token", b"cred", b"login", b"auth", b"key", b"://")
_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[list(b"0123456789abcdef")] = True

# Letters of the shortest word; words of more than _START letters are found by their first ones.
LEAST_WORD, _START = 3, 24
# What a repeat is: a block of at most so many characters, twice or more in a row.
_BLOCK = 16

#: Words by falling use in passwords.
COMMON_WORDS = (
    "password pass admin root user login welcome secret letmein master dragon monkey shadow sunshine princess football "
    "baseball superman batman michael jordan hunter ranger thomas robert daniel jessica ashley nicole soccer hockey "
    "killer pepper summer winter spring autumn george harley charlie andrew love money test guest change changeme "
    "default example server system computer internet service access private public token key data cloud dev prod stage "
    "local temp demo sample hello world google apple orange banana flower coffee chocolate cookie purple yellow silver "
    "golden green blue black white red cat dog tiger lion eagle wolf bear horse fish star moon sun night day home "
    "house family mother father brother sister baby friend happy lucky magic power freedom forever trust no one the "
    "and for you my your this that with is are january february march april may june july august september october "
    "november december monday tuesday friday sunday london paris berlin madrid boston dallas chicago texas"
).split()
_LOOKALIKES, _MEANT = "4@8310!|57$2", "aabeloiistsz"
_LOOKALIKE = str.maketrans(_LOOKALIKES, _MEANT)
_ROWS = ("`1234567890-=", " qwertyuiop[]", " asdfghjkl;'", " zxcvbnm,./")
_PLACE = {key: (row, column) for row, keys in enumerate(_ROWS) for column, key in enumerate(keys) if key != " "}
_SHIFTED = str.maketrans('~!@#$%^&*()_+{}:"<>?', "`1234567890-=[];',./")
_KINDS_COST, _LN10 = log10(5), log(10)


def _dates(text: str) -> Iterator[tuple[int, int, float]]:
    """Runs that read as a date with a year, or as a year alone: begin, end, cost."""
    year_of = re.compile(r"(?=((?:19|20)\d\d))")
    for found in year_of.finditer(text):
        yield found.start(), found.start() + 4, log10(max(abs(int(found[1]) - 2000), 20))
    patterns = (
        r"(?=((\d{1,2})([-/._]?)(\d{1,2})\3((?:19|20)?\d\d)))",
        r"(?=(((?:19|20)\d\d)([-/._]?)(\d{1,2})\3(\d{1,2})))",
    )
    for pattern in patterns:
        for found in re.finditer(pattern, text):
            parts = [int(found[2]), int(found[4]), int(found[5])]
            year = max(parts) if max(parts) > 31 else parts[-1]
            parts.remove(year)
            if 1 <= min(parts) <= 12 and 1 <= max(parts) <= 31:
                year += 0 if year > 99 else 2000 if year < 50 else 1900
                days = 365 * max(abs(year - 2000), 20)
                yield found.start(), found.start() + len(found[1]), log10(days * (4 if found[3] else 1))


class _Cheapest:
    """The least of base + log10(end - begin) over begins added so far, for ends that only grow.

    Logarithms rise ever more slowly, so of two begins the earlier one, if it has the smaller base, wins
    from some end on for good; if it has not, it never wins.  What can still win stays on a stack,
    so all begins and ends of a run take time in proportion to its length.
    """

    def __init__(self) -> None:
        # Begin, base, and the end from which the entry below wins.
        self._stack: list[tuple[int, float, float]] = []

    def add(self, begin: int, base: float) -> None:
        stack = self._stack
        while stack and stack[-1][1] >= base:
            # An earlier begin with no smaller base.
            stack.pop()
        until = inf
        while stack:
            gap = (base - stack[-1][1]) * _LN10
            until = begin + (begin - stack[-1][0]) / expm1(gap) if gap < 700 else float(begin)
            if stack[-1][2] > until:
                break
            stack.pop()
            until = inf
        stack.append((begin, base, until))

    def at(self, end: int) -> float:
        stack = self._stack
        while stack[-1][2] <= end:
            stack.pop()
        return stack[-1][1] + log10(end - stack[-1][0])


class _Walks:
    """Runs of three or more keys next to each other on the keyboard: the cheapest that ends at each place."""

    def __init__(self, text: str) -> None:
        places = [_PLACE.get(c.lower().translate(_SHIFTED)) for c in text]
        self._steps: list[tuple[int, int] | None] = [None]
        for last, place in zip(places, places[1:]):
            step = (place[0] - last[0], place[1] - last[1]) if place and last else None
            self._steps.append(step if step and max(map(abs, step)) <= 1 else None)
        # turned[i]: changes of direction up to the step that ends at i.
        self._turned = [0] * len(text)
        for i in range(1, len(text)):
            self._turned[i] = self._turned[i - 1] + (self._steps[i] != self._steps[i - 1])
        self._begin, self._begins = 0, _Cheapest()

    def ending(self, end: int, best: Sequence[float]) -> float:
        """Cost up to ``end`` with such a run as the last segment; ``best`` holds the costs up to all places before."""
        if self._steps[end - 1] is None:
            self._begin, self._begins = end - 1, _Cheapest()
        if end - self._begin < 3:
            return inf
        self._begins.add(end - 3, best[end - 3] - self._turned[end - 2] * log10(6))
        return self._begins.at(end) + log10(47) + (1 + self._turned[end - 1]) * log10(6)


def _words(text: str, costs: Mapping[str, float]) -> Iterator[tuple[int, int, float]]:
    lower = _lowered(text)
    plain = lower.translate(_LOOKALIKE)
    longer: dict[str, list[str]] = {}
    if len(text) > _START:
        for word in costs:
            if len(word) > _START:
                longer.setdefault(word[:_START], []).append(word)
    for i in range(len(text)):
        ends = {*range(i + LEAST_WORD, min(i + _START, len(text)) + 1)}
        for form in (lower, plain) if longer else ():
            ends.update(i + len(word) for word in longer.get(form[i: i + _START], ()) if form.startswith(word, i))
        for j in ends:
            cost = min(costs.get(lower[i:j], inf), costs.get(plain[i:j], inf) + log10(4))
            if cost < inf:
                written = text[i:j]
                capitals = 0.0 if written == lower[i:j] else log10(2) if written[1:].islower() or written.isupper() else log10(2) * len(written) / 2
                yield i, j, cost + capitals


class _Repeats:
    """Blocks of up to 16 characters, twice or more in a row, three characters in all at least: the cheapest that ends at each place."""

    def __init__(self, text: str, costs: Mapping[str, float]) -> None:
        self._text, self._costs = text, costs
        self._known: dict[str, float] = {}
        # For each size: where the text began to repeat itself at that distance, and the begins by their remainder.
        self._runs: dict[int, tuple[int, list[_Cheapest]]] = {size: (0, []) for size in range(1, min(_BLOCK, len(text) // 2) + 1)}

    def ending(self, end: int, best: Sequence[float]) -> float:
        """As that of walks."""
        text, least = self._text, inf
        for size, (begin, begins) in self._runs.items():
            if end > size and text[end - 1] != text[end - 1 - size]:
                self._runs[size] = end - size, []
                continue
            start = end - max(2 * size, 3)
            if start < begin:
                continue
            if not begins:
                begins.extend(_Cheapest() for _ in range(size))
            block = text[start: start + size]
            if block not in self._known:
                self._known[block] = guesses_log10(block, self._costs, repeats=False)
            own = begins[start % size]
            own.add(start // size, best[start] + self._known[block])
            least = min(least, own.at(end // size))
        return least


def guesses_log10(value: str, costs: Mapping[str, float] | None = None, repeats: bool = True) -> float:
    """Decimal logarithm of the guesses that the cheapest segmentation of ``value`` needs; ``costs`` are those of words."""
    costs = COMMON_COSTS if costs is None else costs
    segments: dict[int, list[tuple[int, float]]] = {}
    for begin, end, cost in (*_words(value, costs), *_dates(value)):
        segments.setdefault(end, []).append((begin, cost))
    runs = [_Walks(value), _Repeats(value, costs)] if repeats else [_Walks(value)]
    # best[i]: cheapest cut of value[:i]; tried: the same where a brute-force span ends at i.
    best, tried = [0.0], inf
    for end in range(1, len(value) + 1):
        tried = min(tried, best[end - 1] + _KINDS_COST) + log10(_keys(value[end - 1]))
        known = [*(best[begin] + cost for begin, cost in segments.get(end, ())), *(run.ending(end, best) for run in runs)]
        best.append(min(tried, min(known) + _KINDS_COST))
    return best[-1]


def _keys(letter: str) -> int:
    """Characters that brute force tries for one like this."""
    return 10 if letter.isdigit() else 26 if letter.isalpha() and letter.isascii() else 33 if letter.isascii() else 100


def _lowered(text: str) -> str:
    return text.translate(_LOWER)


_LOWER = {upper: upper + 32 for upper in range(65, 91)}
COMMON_COSTS = {word: log10(place) for place, word in enumerate(COMMON_WORDS, 1)}
_RUN = re.compile("[a-z]{3,}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three fixed patterns, in code points."""
    spans = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(spans)


def context_values(text: str) -> list[tuple[int, int]]:
    """(start, end) of the values in credential contexts, those of the first pattern included."""
    values = {}
    for found in _CONTEXT.finditer(text):
        start, end = found.span(1) if found[1] is not None else found.span(2)
        while end > start and text[end - 1] in ".:)]}":
            end -= 1
        if end > start:
            values[start] = end
    for found in _ASSIGN.finditer(text):
        if len(found[2]) >= 8:
            values.setdefault(*found.span(2))
    return sorted(values.items())


def _own_words(text: str, values: Sequence[tuple[int, int]]) -> list[str]:
    """Words that stand in values, each place once."""
    own = {start + m.start(): m[0] for start, end in values for m in _RUN.finditer(_lowered(text[start:end]))}
    return list(own.values())


def _word_candidates(value: str) -> set[str]:
    """What of a value may be a word, or the first letters of a longer one."""
    lower = _lowered(value)
    runs = {m[0] for form in (lower, lower.translate(_LOOKALIKE)) for m in _RUN.finditer(form)}
    return {run[i:j] for run in runs for i in range(len(run)) for j in range(i + LEAST_WORD, min(i + _START, len(run)) + 1)}


def _joined(spans: Sequence[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _long_hex(texts: Sequence[bytes]) -> np.ndarray:
    """Which texts hold a run of 32 hex digits."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    edges = np.flatnonzero(np.diff(_HEX_BYTE[data], prepend=False, append=False))
    runs = edges[::2][edges[1::2] - edges[::2] >= 32]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    has = np.zeros(len(texts), bool)
    has[np.searchsorted(ends, runs, "right")] = True
    return has


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for value_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = list(_word_candidates(value))
            for at in range(0, len(words), 50_000):
                part = words[at: at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([value_id] * len(part)), pa.array(part)], ["value_id", "start"])


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs = []
        for value, words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            known = dict(COMMON_COSTS)
            for word in words or ():
                known[word["word"]] = min(known.get(word["word"], inf), word["cost"])
            costs.append(guesses_log10(value, known))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.float64())], ["value_id", "cost"])


def _word_counts(docs: DataFrame) -> DataFrame:
    """``word, n``: runs of letters A to Z of all texts, lower-cased."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select(F.explode(F.split(lower, "[^a-z]+")).alias("word"))
    return words.where(F.length("word") >= LEAST_WORD).groupBy("word").agg(F.count("*").alias("n"))


def _shuffled(side: DataFrame) -> DataFrame:
    """``side`` for a join that broadcasts neither side.

    What values unfold to is many times what their file is; by the file's size Spark would
    broadcast it all through the driver, and does not take that back once it knows the size.
    """
    return side.hint("merge")


def _words_held(distinct: DataFrame, known: DataFrame) -> DataFrame:
    """``value_id, words``: the known words, with their costs, that each of the ``value_id, value`` holds."""
    candidates = distinct.mapInArrow(_candidates, "value_id string, start string")
    words = candidates.join(_shuffled(known.withColumn("start", F.substring("word", 1, _START))), "start").drop("start")
    # Of longer words only the beginning has been compared.
    lower = F.translate("value", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = F.translate(lower, _LOOKALIKES, _MEANT)
    held = F.contains(lower, F.col("word")) | F.contains(plain, F.col("word"))
    words = words.join(_shuffled(distinct), "value_id").where((F.length("word") <= _START) | held)
    return words.groupBy("value_id").agg(F.collect_list(F.struct("word", "cost")).alias("words"))


def scan_secrets(docs: DataFrame, *, key: str = "doc_id", least: float = MIN_GUESSES_LOG10) -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds, digest of their spans, all spans, costs of all values.

    A value in a credential context is a span of kind ``guess`` if it costs at least ``least``, within a base
    span too; ``value_costs`` lists ``start:end:cost`` of every such value.  A null or empty text has no
    spans, an empty table gives none; repeated rows each get their row; other columns of ``docs`` are
    ignored.  Offsets count code points, ends are exclusive.  Every text is searched whole; byte searches
    only decide which patterns can occur in it at all.
    """
    kind = docs.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in row_ranges(batches):
            counts, digests, spans, values, own = ([], [], []), [], [], [], []
            for text, hexed in zip(texts, _long_hex(texts).tolist()):
                lower = text.lower()
                hints = any(h in lower for h in _CONTEXT_HINTS)
                base, found, decoded = [], [], ""
                if hints or hexed or b"AKIA" in text:
                    decoded = text.decode()
                    base = base_spans(decoded)
                    found = context_values(decoded) if hints else []
                for number in range(3):
                    counts[number].append(sum(s[1] == number for s in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
                values.append([{"start": a, "end": b, "value": decoded[a:b]} for a, b in found])
                own.append(_own_words(decoded, found))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))),
                    pa.array(values, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))),
                    pa.array(own, pa.list_(pa.string())),
                ],
                ["key", "n_assign", "n_access", "n_hex", "base_sha256", "base", "values", "own"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col("text").alias("text"))
    shape = (
        f"key {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:long,kind:int,end:long>>,"
        " values array<struct<start:long,end:long,value:string>>, own array<string>"
    )
    with released() as keep:
        found = stage(rows.mapInArrow(scan, shape).withColumn("row", F.monotonically_increasing_id()), "secrets")
        counts = stage(_word_counts(rows), "words")
        total = counts.agg(F.sum("n")).first()[0] or 0
        values = found.select("row", F.inline("values")).withColumn("value_id", F.md5("value"))
        distinct = values.select("value_id", "value").distinct()
        own = found.select(F.explode("own").alias("word")).groupBy("word").agg(F.count("*").alias("own"))
        outside = F.col("n") - F.coalesce("own", F.lit(0))
        known = counts.join(_shuffled(own), "word", "left").where(outside > 0).select("word", F.log10(F.lit(total) / outside).alias("cost"))
        words = _words_held(distinct, known)
        costs = distinct.join(_shuffled(words), "value_id", "left").mapInArrow(_costs, "value_id string, cost double")
        scored = values.join(_shuffled(costs), "value_id").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "cost"))).alias("scored"))
        result = found.join(scored, "row", "left").withColumn("scored", F.coalesce("scored", F.expr("cast(array() as array<struct<start:long,end:long,cost:double>>)")))
        guesses = F.filter("scored", lambda v: v["cost"] >= least)
        guessed = F.transform(guesses, lambda v: F.struct(v["start"].alias("start"), F.lit(3).alias("kind"), v["end"].alias("end")))
        names = F.array(*map(F.lit, KINDS))
        spans = F.transform(F.array_sort(F.concat("base", guessed)), lambda v: F.concat_ws(":", F.get(names, v["kind"]), v["start"], v["end"]))
        cost = F.transform("scored", lambda v: F.concat_ws(":", v["start"], v["end"], F.round(v["cost"], 2)))
        result = result.select(
            F.col("key").alias(key), "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(spans, ",").alias("spans"),
            F.size(guesses).cast("long").alias("n_guess"), F.array_join(cost, ",").alias("value_costs"),
        )
        return keep(result, "secrets")
