from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronlens.llm import secret_scan
from patronlens.llm.decontamination import contamination, decontaminate
from patronlens.llm.near_duplicates import near_duplicates
from patronlens.llm.quality import text_counts
from patronlens.llm.queries import ORACLES, QUERIES
from patronlens.llm.substrings import _Chunk, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
FOLDER = "/root/testdata/sf0.001"


def prose(rng, count, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(count))


# Repeated windows


def cut_by_brute_force(rows, window=13):
    first, words = {}, [(i, WORD.findall(t or "")) for i, t in rows]
    for key, own in words:
        for k in range(len(own) - window + 1):
            if key is not None:
                first[tuple(own[k:k + window])] = min(key, first.get(tuple(own[k:k + window]), key))
    out = []
    for key, own in words:
        gone = [False] * len(own)
        for k in range(len(own) - window + 1):
            if key is not None and first[tuple(own[k:k + window])] < key:
                gone[k:k + window] = [True] * window
        out.append((key, len(own), sum(gone), " ".join(w for w, g in zip(own, gone) if not g)))
    return sorted(out, key=repr)


def cut(docs, **options):
    rows = remove_repeats(docs, **options).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"]).decode()) for r in rows), key=repr)


def test_repeats_as_brute_force(make_docs):
    rng = random.Random(5)
    shared = [prose(rng, 30) for _ in range(4)]
    rows = [(i, " ".join([prose(rng, rng.randrange(40)), rng.choice(shared), prose(rng, 5), rng.choice(shared)])) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "one two"), (103, "a " * 60), (104, "a " * 20), (None, shared[0]), (None, shared[0])]
    rows += [(200, shared[1]), (200, shared[1]), (200, shared[2] + " x " + shared[2]), (-5, shared[3].upper())]
    docs = make_docs(rows)
    expected = cut_by_brute_force(rows)
    assert cut(docs) == expected
    assert cut(docs, chunk_windows=50, group_windows=100) == expected
    assert cut(make_docs([])) == []


def test_repeats_query(spark, sample_texts):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op7_rabin_karp_windows"](spark, FOLDER).collect()}
    for key, n, gone, kept in cut_by_brute_force(sample_texts):
        assert got[key] == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


# Near-duplicates


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def groups_by_brute_force(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, one) in enumerate(sets):
        for j, other in sets[a + 1:]:
            common = len(one & other)
            if i is not None and j is not None and common and 100 * common >= 75 * (len(one) + len(other) - common):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return sorted(((i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, s in sets), key=repr)


def edited(rng, text, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def test_near_duplicates_as_brute_force(make_docs):
    rng = random.Random(8)
    bases, passage = [prose(rng, n) for n in (6, 9, 40, 120, 400)], prose(rng, 60)
    rows = [(i, edited(rng, rng.choice(bases), rng.choice([0, 0.01, 0.03, 0.05]))) for i in range(120)]
    rows += [(200 + i, passage + " " + prose(rng, 25)) for i in range(40)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "a B"), (304, "A b"), (305, "a b"), (306, "Same " * 50), (307, "same " * 9)]
    rows += [(None, bases[4]), (400, bases[4]), (400, bases[4]), (401, bases[3].upper()), (7, prose(rng, 30)), (402, bases[4] + " more words")]
    got = sorted((tuple(r) for r in near_duplicates(make_docs(rows)).collect()), key=repr)
    assert got == groups_by_brute_force(rows)
    assert near_duplicates(make_docs([])).collect() == []


def test_small_sets_against_larger_than_a_sketch(make_docs):
    rng, rows = random.Random(10), []
    for small, large in ((31, 41), (32, 42), (31, 40), (32, 41), (30, 40), (30, 38), (25, 33)):
        for _ in range(40):
            words = prose(rng, large + 4, 10**9).split()
            rows += [(len(rows), " ".join(words[:small + 4])), (len(rows) + 1, " ".join(words))]
    for small, large in ((31, 39), (32, 40)):
        for _ in range(40):  # the small set's last shingle is its own
            words = prose(rng, large + 4, 10**9).split()
            rows += [(len(rows), " ".join([*words[:small + 3], "own"])), (len(rows) + 1, " ".join(words))]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(make_docs(rows)).collect()}
    for i in range(0, len(rows), 2):
        one, other = shingles(rows[i][1]), shingles(rows[i + 1][1])
        assert got[i] == i and got[i + 1] == (i if 100 * len(one & other) >= 75 * len(one | other) else i + 1), (len(one), len(other))


def test_groups_larger_than_a_block(make_docs, monkeypatch):
    from patronlens.llm import near_duplicates as module

    monkeypatch.setattr(module, "BLOCK", 16)
    rng = random.Random(9)
    base = prose(rng, 90)
    rows = [(i, edited(rng, base, 0.03)) for i in range(110)]
    got = sorted((tuple(r) for r in near_duplicates(make_docs(rows)).collect()), key=repr)
    assert got == groups_by_brute_force(rows)


def test_near_duplicates_query(spark, sample_texts):
    got = sorted((tuple(r) for r in QUERIES["op9_bottom_k_sketches"](spark, FOLDER).collect()), key=repr)
    assert got == groups_by_brute_force(sample_texts)


def test_sent_windows_grow_with_the_text_alone():
    rng = random.Random(5)
    texts = [prose(rng, 250, 10**6).encode() for _ in range(800)]

    def sent(bits):
        chunk = _Chunk()
        chunk.add(np.arange(800) * 3, np.arange(800), texts, 13)
        return sum(len(v) for row in chunk.rows(1, bits) for v in row if isinstance(v, bytes))

    # Ranges grow in number with the whole input; no more than their share of a chunk's windows may go to each.
    assert sent(10) < 1.2 * sent(4)


# Benchmark passages


def test_passages_with_substitutions(spark, make_docs):
    rng = random.Random(4)
    items = [(i, prose(rng, rng.randrange(15, 60), 10**6)) for i in range(30)]
    benchmark = spark.createDataFrame([*items, (90, None), (91, ""), (92, "too short"), (3, items[3][1])], "item_id long, text string")
    rows, expected = [], {}
    for i in range(60):
        item, text = rng.choice(items)
        words = text.split()
        for k in range(5, len(words), 9):
            words[k] = "other"
        rows.append((i, prose(rng, 30) + " " + ", ".join(words).upper() + ". " + prose(rng, 10)))
        expected[i] = True
    rows += [(100 + i, prose(rng, 200)) for i in range(20)] + [(200, None), (201, ""), (None, items[2][1]), (None, "x")]
    docs = make_docs(rows)
    for block in (2_000_000, 800):
        found = contamination(docs, benchmark, block_tokens=block).collect()
        assert {r["doc_id"] for r in found if r["contaminated"]} == {*expected, None}
        assert len(found) == len(rows)
        kept = decontaminate(docs, benchmark, block_tokens=block)
        assert kept.columns == docs.columns and kept.count() == 20 + 2 + 1
    assert decontaminate(docs, benchmark.limit(0)).count() == len(rows)
    assert contamination(make_docs([]), benchmark).collect() == []


def test_short_items_and_scripts_without_spaces(spark, make_docs):
    rng = random.Random(12)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    thai, kana, long_han = "ภาษาไทยไม่มีช่องว่าง", "すべてのひとはうまれながらにして", han(40)
    items = [(1, "Seven words make this one short item"), (2, "unique-answer"), (3, thai), (4, kana), (5, long_han), (6, "漢字"), (7, "?!"), (8, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    changed = long_han[:20] + "甲" + long_han[21:]
    rows = [
        (1, "a b seven words, make this ONE short item. c"), (2, "the unique answer"), (3, "ก" + thai + "ข"), (4, "かな" + kana), (5, han(30) + changed + han(9)),
        (6, "x漢字y"), (7, long_han[:20] + "，" + long_han[20:]), (10, "seven words make this one item short"), (11, "answer unique"), (12, han(300)), (13, "字漢"), (14, "?!"), (15, None),
    ]
    for block in (2_000_000, 20):
        found = {r["doc_id"]: r["items"] for r in contamination(make_docs(rows), benchmark, block_tokens=block).collect()}
        assert found == {1: "1", 2: "2", 3: "3", 4: "4", 5: "5", 6: "6", 7: "5"} | {i: "" for i in range(10, 16)}
    assert {r["doc_id"] for r in decontaminate(make_docs(rows), benchmark).collect()} == set(range(10, 16))


def test_passages_of_the_test_data(spark, sample_texts):
    import duckdb

    items = duckdb.sql(f"SELECT text FROM '{FOLDER}/benchmark.parquet'").fetchall()
    plain = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    expected = {i for i, t in sample_texts if any(plain(b) in plain(t) for (b,) in items)}
    found = QUERIES["op3_spaced_seeds"](spark, FOLDER).collect()
    assert {r["doc_id"] for r in found if r["contaminated"]} == expected


# Secrets


def spans_by_brute_force(text):
    spans = []
    pattern = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    spans += [(m.start(), 0, m.end()) for m in re.finditer(pattern, text) if len(m[1]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_secret_spans(make_docs, sample_texts):
    rows = [*sample_texts, (-1, None), (-2, ""), (-3, "pwd: X7#kQ!9zLw, pwd: password1"), (-4, "é PASSWORD = 'aaaaaaaa' toKen=12345678 token=1234567"),
            (-5, "é" * 9 + "AKIA" + "Z9" * 6 + " " + "0f" * 16), (-6, "https://joe:Zk3vQ9pLx2@host/ " + "x" * 50_000), (None, "secret: abcdefgh"), (None, "secret: abcdefgh")]
    got = secret_scan.scan_secrets(make_docs(rows)).collect()
    assert len(got) == len(rows)
    by_text = {(i, spans_by_brute_force(t or "")) for i, t in rows}
    for r in got:
        base = ",".join(s for s in r["spans"].split(",") if not s.startswith("guess"))
        assert (r["doc_id"], base) in by_text
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        counts = Counter(s.split(":")[0] for s in base.split(","))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (counts["assign"], counts["access"], counts["hex"])
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert spans[-3] == "guess:5:15"
    assert "guess:12:22" in spans[-6]


def test_guess_costs():
    cost = secret_scan.guesses_log10
    assert cost("") == 0
    for weak in ("password", "Password1", "qwertyuiop", "aaaaaaaaaaaa", "abcabcabcabc", "1987-06-05", "p@ssw0rd", "dragon2019", "zxcvbnm123"):
        assert cost(weak) < secret_scan.MIN_GUESSES_LOG10, weak
    for strong in ("X7#kQ!9zLw", "Zk3vQ9pLx2", "correcthorsebattery", "f81d4fae7dec11d0"):
        assert cost(strong) >= secret_scan.MIN_GUESSES_LOG10, strong


def cost_by_brute_force(value, costs, repeats=True):
    """The least cost over all cuts of a value, each segment costed by itself."""
    def walk(part):
        keys = [secret_scan._PLACE.get(c) for c in part.translate(secret_scan._SHIFTED)]
        if len(part) < 3 or None in keys:
            return np.inf
        steps = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(keys, keys[1:])]
        if any(max(abs(x), abs(y)) > 1 for x, y in steps):
            return np.inf
        turns = 1 + sum(a != b for a, b in zip(steps, steps[1:]))
        return np.log10(47) + turns * np.log10(6) + np.log10(len(part))

    def segment(part):
        options = [sum(np.log10(10 if c.isdigit() else 26 if c.isalpha() else 33) for c in part), walk(part)]
        options.append(costs.get(part, np.inf))
        if len(part) >= 3:
            options.append(costs.get(part.translate(str.maketrans("4@8310!|57$2", "aabeloiistsz")), np.inf) + np.log10(4))
        if re.fullmatch("(19|20)[0-9]{2}", part):
            options.append(np.log10(max(abs(int(part) - 2000), 20)))
        for size in range(1, len(part) // 2 + 1):
            if repeats and len(part) >= 3 and len(part) % size == 0 and part[:size] * (len(part) // size) == part:
                options.append(cost_by_brute_force(part[:size], costs, False) + np.log10(len(part) // size))
        return min(options) + np.log10(5)

    best = np.inf if value else 0.0
    for cut in range(1 << max(len(value) - 1, 0)):
        ends = [i + 1 for i in range(len(value) - 1) if cut >> i & 1] + [len(value)]
        if value:
            best = min(best, sum(segment(value[a:b]) for a, b in zip([0, *ends], ends)))
    return best


def test_cheapest_of_all_cuts():
    rng = random.Random(12)
    costs = {"abc": 0.0, "abcd": 0.7, "bcda": 0.2, "sda": 1.5, "aba": 0.4}
    for value in ["", "a", "aaaaaaaa", "abcabcab", "qweabcd", "2012abc", "5daqwert"] + ["".join(rng.choice("abcd5qwe#") for _ in range(rng.randrange(2, 10))) for _ in range(60)]:
        assert secret_scan.guesses_log10(value, costs) == pytest.approx(cost_by_brute_force(value, costs)), value
    # Long repeats do not take the time of all their cuts.
    assert secret_scan.guesses_log10("a" * 20_000 + "Zk3vQ9") < 20


def test_long_walks_are_cut_anywhere():
    rng, keys = random.Random(5), list(secret_scan._PLACE)

    def walk(length):
        path = ["g"]
        while len(path) < length:
            row, column = secret_scan._PLACE[path[-1]]
            near = [k for k in keys if max(abs(secret_scan._PLACE[k][0] - row), abs(secret_scan._PLACE[k][1] - column)) == 1]
            path.append(rng.choice(near))
        return "".join(path)

    whole = walk(420)
    middle = whole[200:220]
    costs, cost = {middle: 0.3}, secret_scan.guesses_log10
    # A cut of three parts is a cut of the whole.
    assert cost(whole, costs) <= cost(whole[:200], costs) + cost(middle, costs) + cost(whole[220:], costs) + 1e-9
    assert cost("qwertyuiop" * 3_000 + "Zk3vQ9", costs) < 20


def test_words_of_any_length_are_known(make_docs):
    word = "donaudampfschifffahrtsgesellschaftskapitaen"
    texts = [f"the {word} and the {word[:26]} sail " * 40] * 5 + [f"pwd: {word}", f"pwd: {word[:26]}", f"pwd: {word[:30]}"]
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan_secrets(make_docs(list(enumerate(texts)))).collect()}
    assert got[5] == got[6] == "" and got[7] == ""
    texts = [f"the {word} sails " * 40] * 5 + [f"pwd: {word}", f"pwd: {word[:26]}"]
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan_secrets(make_docs(list(enumerate(texts)))).collect()}
    assert got[5] == "" and got[6] == "guess:5:31"


def test_costs_follow_the_words_of_the_corpus(make_docs):
    texts = ["the zebrafish swims by the zebrafish tank " * 30] * 40
    texts += ["password = zebrafishtank", "token: qzkvwpxjtu", "token: qzkvwpxjtu again", "pwd: zebrafish", "api_key=Zk3vQ9pLx2Tt", None, ""]
    docs = make_docs(list(enumerate(texts))).withColumn("values", F.lit(1)).withColumn("row", F.lit("x"))
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(docs).collect()}
    assert len(got) == len(texts)
    # Two words of the corpus are cheap, a base span or not; letters that stand in values alone are no word.
    assert got[40]["spans"] == "assign:0:24" and got[43]["spans"] == ""
    assert got[41]["spans"] == "assign:0:17,guess:7:17" and got[42]["spans"] == got[41]["spans"]
    assert got[44]["spans"] == "assign:0:20,guess:8:20" and got[44]["n_guess"] == 1 and got[44]["value_costs"].startswith("8:20:")
    assert got[45]["spans"] == got[46]["spans"] == got[45]["value_costs"] == ""
    strict = {r["doc_id"]: r["spans"] for r in secret_scan.scan_secrets(docs, least=2.0).collect()}
    assert strict[40] == "assign:0:24,guess:11:24" and strict[43] == ""
    assert secret_scan.scan_secrets(make_docs([])).collect() == []


def test_candidates_of_values_do_not_pass_the_driver(spark, tmp_path):
    spark.createDataFrame([("a" * 32, "correcthorsebattery")], "value_id string, value string").write.parquet(f"{tmp_path}/values")
    spark.createDataFrame([("correct", 1.0), ("horse", 2.0), ("stable", 3.0)], "word string, cost double").write.parquet(f"{tmp_path}/known")
    words = secret_scan._words_held(spark.read.parquet(f"{tmp_path}/values"), spark.read.parquet(f"{tmp_path}/known"))
    assert [(r["value_id"], sorted(w["word"] for w in r["words"])) for r in words.collect()] == [("a" * 32, ["correct", "horse"])]
    assert "Broadcast" not in words._jdf.queryExecution().executedPlan().toString()


# Quality counts


def test_text_counts_as_brute_force(sample_texts):
    texts = [t or "" for _, t in sample_texts] + ["", " \n\n", "a b\na b\n\n x\n a b", "é ü|<>\n" * 9, " ".join("abcdefghij") + " " + " ".join("abcdefgh"), "z " * 40]
    got = text_counts([t.encode() for t in texts])
    for i, text in enumerate(texts):
        words = WORD.findall(text)
        windows = Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
        marked = {j for k in range(len(words) - 7) if windows[tuple(words[k:k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked))
        assert tuple(int(got[n][i]) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == expected


# Queries with SQL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    from oracle import connect, spark_result, sql_result

    assert spark_result(QUERIES[name](spark, FOLDER)) == sql_result(connect(FOLDER), ORACLES[name])
