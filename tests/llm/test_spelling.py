from __future__ import annotations

import re
import zlib
from collections import Counter

from patronlens.llm import spelling
from patronlens.llm.spelling import count_words, near_words, spelling_variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows):
    counts = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    words = brute_counts(rows)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], None if form[w] is None else words[form[w]], root))
    return out


def test_variants_equal_brute_force(spark, make_docs, sample_texts):
    rows = sample_texts[:60] + [(i, t) for i, t in enumerate([
        None, "", "x", "Straße straße STRASSE strasse", "thing thing thing things things things thingz",
        "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa baaaa baaaa baaaa " * 3, "house housé house× housé " * 7, "pre-fixed" * 9,
    ], 10_000)] + [(None, "nothing nothing nothing nothinga nothinga nothinga")] * 4 + sample_texts[:5]
    found = spelling_variants(make_docs(rows)).collect()
    assert {tuple(r) for r in found} == brute(rows)
    assert len(found) == len(brute_counts(rows))


def test_empty_table(make_docs):
    assert spelling_variants(make_docs([])).collect() == []


def test_tiles_of_any_size_give_the_same_pairs(spark, make_docs, sample_texts):
    words = count_words(make_docs(sample_texts[:80]))
    whole = {tuple(r) for r in near_words(words).collect()}
    assert whole and {tuple(r) for r in near_words(words, tile_words=7).collect()} == whole
    assert len(whole) == near_words(words, tile_words=7).count()


def test_long_texts_in_parts(sample_texts, monkeypatch):
    text = " ".join(t for _, t in sample_texts[:40] if t)
    whole, cut = Counter(), Counter()
    spelling.letter_runs(text.encode(), b"7", whole)
    monkeypatch.setattr(spelling, "PART_BYTES", 100)
    spelling.letter_runs(text.encode(), b"7", cut)
    assert +whole == +cut and whole
