from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from patronlens.llm.language import Network, held_out, identify_languages, train, training_sample
from patronlens.llm.quality import (
    HashArray, collect_model, count_grams, kneser_ney, log10_probabilities, perplexities, quality_rules, slices,
)
from patronlens.llm.queries import QUERIES, table

FOLDER = "/root/testdata/sf0.001"


# Language model


def read(text):
    out, space = bytearray(), False
    for b in text.encode():
        b = 48 if 48 <= b <= 57 else 32 if 9 <= b <= 13 else 1 if b == 0 else b
        if not (b == 32 and space):
            out.append(b)
        space = b == 32
    return bytes(out)


class BruteModel:
    """Modified Kneser-Ney over the last 1 to 4 bytes, from its definition; n-grams seen once are not looked up."""

    def __init__(self, texts):
        self.raw = {4: Counter()}
        for text in texts:
            data = b"\0\0\0" + read(text)
            self.raw[4].update(data[i - 3:i + 1] for i in range(3, len(data)))
        lower = {}
        for size in (3, 2, 1):
            self.raw[size], lower[size] = Counter(), Counter(g[1:] for g in self.raw[size + 1])
            for g, n in self.raw[size + 1].items():
                self.raw[size][g[1:]] += n
        self.tops = {size: self.shares(self.raw[size]) for size in self.raw}
        self.lower = {size: self.shares(lower[size]) for size in lower}

    @staticmethod
    def shares(counts):
        """Own share of each n-gram, and the rest of each history."""
        n, cut = Counter(counts.values()), {}
        for i in (1, 2, 3):
            value = 0.5 * i
            if n[i] and n[1] + n[2]:
                value = i - (i + 1) * n[1] / (n[1] + 2 * n[2]) * n[i + 1] / n[i]
            cut[i] = min(max(value, 0), i)
        total = defaultdict(int)
        for g, c in counts.items():
            total[g[:-1]] += c
        own = {g: (c - cut[min(c, 3)]) / total[g[:-1]] for g, c in counts.items()}
        rest = defaultdict(lambda: 1.0, {h: 1.0 for h in total})
        for g, share in own.items():
            rest[g[:-1]] -= share
        return own, defaultdict(lambda: 1.0, {h: max(r, 1e-12) for h, r in rest.items()})

    def whole(self, g):
        if not g:
            return 1 / 256
        own, rest = self.lower[len(g)]
        return own[g] + rest[g[:-1]] * self.whole(g[1:])

    def looked_up(self, g, kind):
        if not g:
            return 1 / 256
        own, rest = kind[len(g)]
        if self.raw[len(g)][g] > 1:
            return own[g] + rest[g[:-1]] * self.whole(g[1:])
        return rest[g[:-1]] * self.looked_up(g[1:], self.lower)

    def value(self, g):
        return sum(math.log10(self.looked_up(g[4 - size:], self.tops)) for size in (1, 2, 3, 4))


def some_texts():
    rng = random.Random(2)
    return ["".join(rng.choice("abcdé 01\n\tXyZ") for _ in range(rng.randrange(80))) for _ in range(60)] + ["", "a", "\0b"]


def test_perplexity_model_as_brute_force(make_docs):
    texts = some_texts()
    docs = make_docs(list(enumerate(texts)))
    model = collect_model(kneser_ney(count_grams(docs.select("lang", "text"))))["en"]
    brute = BruteModel(texts)
    for text in [*texts[:20], "never séen zzz Q"]:
        data = b"\0\0\0" + read(text)
        codes = np.array([int.from_bytes(data[i - 3:i + 1], "big") for i in range(3, len(data))], np.uint32)
        expected = [brute.value(data[i - 3:i + 1]) for i in range(3, len(data))]
        assert log10_probabilities(model, codes) == pytest.approx(expected, abs=5e-4)


def test_models_in_slices_give_the_same_perplexities(spark, make_docs):
    texts = some_texts()
    docs = make_docs([*enumerate(texts), (3, texts[3]), (3, texts[3]), (None, texts[4]), (99, None)])
    docs = docs.unionByName(make_docs([(200, "ab cd ab"), (201, None)], lang=None)).unionByName(make_docs([(202, "zz")], lang="xx"))
    read_ = docs.selectExpr("coalesce(lang, 'und') AS lang", "text")
    orders = kneser_ney(count_grams(read_))
    count, where = slices(orders, 40)
    assert count > 5 and set(where) == {"en", "und", "xx"}
    whole = sorted(map(repr, perplexities(docs, orders).collect()))
    sliced = sorted(map(repr, (r for r in perplexities(docs, orders, entries=40).collect())))
    assert len(whole) == len(sliced) == len(texts) + 7

    def values(rows):
        return sorted((repr(r["key"]), r["lang"], r["n_read"], round(r["log10_perplexity"], 4)) for r in rows)

    assert values(perplexities(docs, orders).collect()) == values(perplexities(docs, orders, entries=40).collect())
    brute = BruteModel(texts + [texts[3]] * 2 + [texts[4]])
    for r in perplexities(docs, orders, entries=40).where("key between 0 and 40").collect():
        data = b"\0\0\0" + read(texts[r["key"]])
        total = sum(brute.value(data[i - 3:i + 1]) for i in range(3, len(data)))
        assert r["log10_perplexity"] == pytest.approx(-total / 4 / max(len(data) - 3, 1), abs=1e-3)


def test_hash_arrays():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**40, 5000))
    array = HashArray.of(keys, keys % 97)
    found, values = array.find(np.concatenate([keys, keys + 1]))
    assert found[:len(keys)].all() and (values[:len(keys)] == keys % 97).all()
    assert (found[len(keys):] == np.isin(keys + 1, keys)).all()


def test_quality_verdicts(make_docs):
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(120)]
    odd = "".join(chr(33 + rng.randrange(90)) + (" " if i % 5 == 4 else "") for i in range(200))
    rows += [(500, odd), (501, None), (502, ""), (503, "few words"), (504, "same eight words stand here again and again " * 9), (None, rows[0][1])]
    rows += [(600 + i, rows[1][1]) for i in range(60)]
    got = {r["doc_id"]: r for r in quality_rules(make_docs(rows)).collect()}
    assert all(got[i]["kept"] for i in [*range(120), *range(600, 660), None])
    assert not got[500]["base_failed"] and not got[500]["kept"]
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (501, 502, 503, 504))
    assert quality_rules(make_docs([])).collect() == []
    nameless = quality_rules(make_docs(rows[:30], lang=None)).collect()
    assert len(nameless) == 30 and {r["lang"] for r in nameless} == {"und"}


def test_junk_of_true_words_is_rejected(spark, make_docs):
    rng = random.Random(7)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(150))) for i in range(200)]
    marked = " ".join(rng.choice(words) + rng.choice(["###", "$$$", "%%%", "&&&"]) for _ in range(150))
    rows += [(500, rows[7][1].upper()), (501, marked), (502, rows[8][1]), (503, rows[8][1])]
    got = {r["doc_id"]: r for r in quality_rules(make_docs(rows)).collect()}
    assert all(not got[i]["base_failed"] and not got[i]["kept"] for i in (500, 501))
    assert all(got[i]["kept"] for i in [*range(200), 502, 503])
    # The verdict by its definition.
    brute = BruteModel([t for _, t in rows])
    value = {}
    for i, t in rows:
        data = b"\0\0\0" + read(t)
        value[i] = -sum(brute.value(data[j - 3:j + 1]) for j in range(3, len(data))) / 4 / (len(data) - 3)
        assert got[i]["log10_perplexity"] == pytest.approx(value[i], abs=1e-3)
    different = sorted({round(got[i]["log10_perplexity"], 6) for i in got})
    middle = different[(len(different) - 1) // 2]
    spread = sorted(abs(v - middle) for v in different)[(len(different) - 1) // 2]
    for i, t in rows:
        wide = 6 * 1.4826 * spread * math.sqrt(max(1, 150 / len(t.split())))
        off = got[i]["log10_perplexity"] - middle
        assert got[i]["kept"] == (-max(wide, 0.301 * wide / (6 * 1.4826 * spread)) - 1e-6 <= off <= wide + 1e-6)


# Language


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    network = Network.drawn(["a", "b", "c"], 4, 3)
    segments = rng.integers(0, 256, (5, 12)).astype(np.uint8)
    lengths, labels = np.array([12, 7, 1, 12, 3]), np.array([0, 1, 2, 1, 0])
    _, grads = network.gradients(segments, lengths, labels)
    for weight, grad in zip(network.weights(), grads):
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        kept, losses = weight[at], []
        for step in (0.01, -0.01):
            weight[at] = kept + step
            losses.append(network.gradients(segments, lengths, labels)[0])
        weight[at] = kept
        assert (losses[0] - losses[1]) / 0.02 == pytest.approx(grad[at], rel=0.02, abs=1e-4)


def test_held_out_accuracy_and_odd_rows(spark, make_docs):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    network = train(training_sample(docs.where(~held_out(docs["doc_id"]))))
    found = {r["doc_id"]: r for r in identify_languages(docs, network).collect()}
    truth = [(r["doc_id"], r["lang"]) for r in docs.collect() if r["lang"]]
    tested = [(i, lang) for i, lang in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(tested) > 100 and sum(found[i]["lang_pred"] == lang for i, lang in tested) / len(tested) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in found.values())
    rows = [(1, None), (2, ""), (3, "12 !? 34"), (4, "x"), (None, "the " * 60_000), (None, "the " * 60_000), (5, "é" * 97)]
    odd = sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in identify_languages(make_docs(rows), network).collect()), key=repr)
    assert [r[1:] for r in odd if r[0] in (1, 2, 3)] == [("und", 0.0)] * 3
    assert len(odd) == 7 and all(r[1] in network.languages for r in odd if r[0] not in (1, 2, 3))
    nothing = train([])
    assert {r["lang_pred"] for r in identify_languages(make_docs(rows), nothing).collect()} == {"und"}
    assert identify_languages(make_docs([]), network).collect() == []


# Pipeline


def test_pipeline_stages(spark):
    docs = table(spark, FOLDER, "documents")
    kept = {"quality": None, "near_dedup": None, "decontamination": None, "surrogates": None}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        rows = out.collect()
        after = {r["doc_id"] for r in rows}
        assert after <= set(before) and len(after) == len(rows)
        if name in kept:
            assert out.columns == docs.columns
            if name in ("quality", "near_dedup", "decontamination"):
                expected = {
                    "quality": lambda: {r["doc_id"] for r in quality_rules(docs).where("kept").collect()},
                    "near_dedup": lambda: {r["doc_id"] for r in _near(docs)},
                    "decontamination": lambda: {r["doc_id"] for r in _clean(spark, docs)},
                }[name]()
                assert after == expected
                assert all(before[r["doc_id"]] == r["text"] for r in rows)
            docs = spark.createDataFrame(rows, out.schema)
            before = {r["doc_id"]: r["text"] for r in rows}
    final = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in rows}
    again = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert again == final and all(n == len(r["ids"]) // 4 for r in rows for n in [r["n_tokens"]])


def _near(docs):
    from patronlens.llm.near_duplicates import near_duplicates

    return near_duplicates(docs).where("kept").collect()


def _clean(spark, docs):
    from patronlens.llm.decontamination import contamination

    return contamination(docs, table(spark, FOLDER, "benchmark")).where("not contaminated").collect()


def test_pipeline_stages_with_odd_rows(make_docs, spark):
    rows = [(1, None), (1, None), (2, ""), (None, "one two three four five six"), (None, None), (3, "word " * 30), (3, "word " * 30)]
    docs = make_docs(rows)
    for name, stage in corpus_pipeline.STAGES:
        count = stage(spark, docs, FOLDER).count()
        assert count == {"quality": 0, "near_dedup": 5, "decontamination": 7, "surrogates": 7, "token_ids": 7}[name], name
        assert stage(spark, make_docs([]), FOLDER).count() == 0


def test_texts_that_share_an_id_are_documents_of_their_own(spark, make_docs):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(40)) for _ in range(4)]
    rows = [(3, texts[0]), (3, texts[1]), (3, texts[1]), (4, texts[1]), (5, texts[2]), (5, texts[2]), (9, texts[0]), (9, texts[3]), (3, None)]
    out = corpus_pipeline.near_dedup(spark, make_docs(rows), FOLDER).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in out) == sorted([(3, texts[0]), (3, texts[1]), (5, texts[2]), (9, texts[3]), (3, "")]) or sorted(
        (r["doc_id"], r["text"] or "") for r in out
    ) == sorted([(3, texts[0]), (4, texts[1]), (5, texts[2]), (9, texts[3]), (3, "")])
    assert Counter(r["text"] for r in out) == Counter([*texts, None])


def test_every_operator_has_its_query():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))
