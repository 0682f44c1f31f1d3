from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from patronlens.llm.bpe import Codec, _KnownWords, codec, encode_documents
from patronlens.llm.queries import QUERIES
from patronlens.llm.records import frame, read_frame, read_records, token_file_digest, write_index, write_records

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "a", "İstanbul ẞ ſ K", "don't 'LL 12½²", "漢字かな " * 40, "x" * 3000, "ab" * 900 + " end", "é" * 500,
    "<|endoftext|>x <|startoftext|>", "áb c d", "🙂👩‍👩‍👧 #$%", "no\x00nul", "ΣΑΣ ΌΣΟΣ", "'s'S'd",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_random_texts_as_the_library(library):
    own, rng = codec(PATH), random.Random(3)
    parts = ["th", "E", "ing", " ", "\n", ".", ",,", "'s", "é", "ß", "漢", "1", "½", "é", "<|endoftext|>", "<|", "­", "Ж", "🙂"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        assert own.encode_texts([text.encode()])[0].tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", [2, 7, 33])
def test_tree_concatenation_of_unsplit_text(library, leaf):
    own, rng = codec(PATH), random.Random(leaf)
    for _ in range(40):
        letters = "".join(rng.choice(["th", "e", "in", "an", "aaaa", "xyz", "ing"]) for _ in range(rng.randint(5, 300)))
        assert own.encode_piece(letters, True, leaf) == library.encode(letters, add_special_tokens=False).ids


def test_words_are_encoded_once_for_many_chunks(library, monkeypatch):
    own, made = Codec(PATH), []
    encode = own.encode_words
    monkeypatch.setattr(own, "encode_words", lambda words: (made.append(len(words)), encode(words))[1])
    chunks = [" ".join(f"w{i:x}." for i in range(at, at + 60_000)) for at in range(0, 240_000, 60_000)]
    first = [own.encode_texts([chunk.encode()])[0] for chunk in chunks]
    assert made == [60_000] * 4
    again = [own.encode_texts([chunk.encode()])[0] for chunk in chunks]
    assert made[4:] == [0] * 4
    for chunk, ids, same in zip(chunks, first, again):
        expected = library.encode(chunk, add_special_tokens=False).ids
        assert ids.tolist() == expected and same.tolist() == expected


def test_words_left_behind_are_encoded_again(library, monkeypatch):
    from patronlens.llm import bpe

    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 40)
    own, rng = Codec(PATH), random.Random(5)
    for _ in range(60):
        text = " ".join(rng.choice(["a", "Ab", "é", "x" * 120, "漢字"]) + str(rng.randint(0, 60)) for _ in range(rng.randint(0, 30)))
        assert own.encode_texts([text.encode(), b"", b" \n"])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_known_words_of_one_hash_are_told_apart():
    known, text = _KnownWords(), np.frombuffer(b"oneowntwoseven", np.uint8)
    hashes, start, size = np.array([5, 5, 5, 9], np.uint64), np.array([0, 3, 6, 9]), np.array([3, 3, 3, 5])
    assert known.find(hashes, text, start, size).tolist() == [-1] * 4
    known.add(hashes[[0, 3]], np.frombuffer(b"oneseven", np.uint8), size[[0, 3]], np.arange(5, dtype=np.uint32), np.array([2, 3]))
    assert known.find(hashes, text, start, size).tolist() == [0, -1, -1, 1]
    assert known.find(np.array([5], np.uint64), text, np.array([0]), np.array([2])).tolist() == [-1]
    assert (known.begin.tolist(), known.length.tolist()) == ([0, 2], [2, 3])


def test_documents_and_parts(spark, make_docs, library):
    rows = [*enumerate(ODD), (3, "a"), (None, "null id")]
    for size in (1 << 20, 64):
        got = sorted((str(r["doc_id"]), bytes(r["ids"]), r["decoded"]) for r in encode_documents(make_docs(rows), PATH, part_chars=size).collect())
        expected = []
        for key, text in rows:
            ids = library.encode(text or "", add_special_tokens=False).ids
            expected.append((str(key), np.array(ids, np.uint32).tobytes(), library.decode(ids, skip_special_tokens=False)))
        assert got == sorted(expected)
    assert encode_documents(make_docs([]), PATH).collect() == []


def test_separators_in_long_texts(spark, make_docs, library):
    odd = "ab\x1ccd \x1d\x1d ef\x1e\n\x1fgh\x0bij\x85kl\xa0\u2028mn "
    rows = [(1, "ab\x1ccd"), (2, odd * 40), (3, "\x1c" * 300), (4, "word " * 30 + odd + "x\x1cy" * 60)]
    for size in (1 << 20, 200, 64, 5):
        got = {r["doc_id"]: bytes(r["ids"]) for r in encode_documents(make_docs(rows), PATH, part_chars=size).collect()}
        for key, text in rows:
            assert got[key] == np.array(library.encode(text, add_special_tokens=False).ids, np.uint32).tobytes(), (key, size)


def test_query_round_trip(spark, sample_texts, library):
    got = {r["doc_id"]: r for r in QUERIES["op10_bpe_round_trip"](spark, "/root/testdata/sf0.001").collect()}
    for key, text in sample_texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[key]["n_tokens"] == len(ids)
        assert got[key]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[key]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_query_token_records(spark, sample_texts, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op8_token_records"](spark, "/root/testdata/sf0.001").collect()}
    start = 0
    for key, text in sample_texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[key] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_record_files_with_ties_nulls_and_empty_texts(spark, make_docs, tmp_path):
    docs = make_docs([(5, "b"), (5, "a"), (5, "a"), (None, "n"), (-1, None), (2**40, ""), (7, "#\n# " * 30)])
    write_records(docs, f"{tmp_path}/data", PATH)
    index = write_index(spark, f"{tmp_path}/data", f"{tmp_path}/index")
    assert index.count() == 7
    few = read_records(spark, f"{tmp_path}/data", index.where("doc_id = 5 or doc_id = 7")).collect()
    assert sorted(r["doc_id"] for r in few) == [5, 5, 5, 7]
    order = [r["doc_id"] for r in token_file_digest(docs, PATH).orderBy("start").collect()]
    assert order == [None, -1, 5, 5, 5, 7, 2**40]
    assert token_file_digest(make_docs([]), PATH).collect() == []


def test_files_grow_in_number_with_the_text(spark, make_docs, tmp_path, monkeypatch):
    from patronlens.llm import records

    monkeypatch.setattr(records, "FILE_TEXT_BYTES", 300)
    docs = make_docs([(i, f"text number {i} " * 3) for i in range(200)])
    write_records(docs, f"{tmp_path}/data", PATH)
    index = write_index(spark, f"{tmp_path}/data", f"{tmp_path}/index")
    assert index.select("file").distinct().count() > 20
    # Any order of reading gives the same records, each by its place in the index.
    back = read_records(spark, f"{tmp_path}/data", index.where("number % 2 = 1"))
    found = {r["doc_id"]: r for r in back.join(index.select("file", "number", "n_tokens"), ["file", "number"]).collect()}
    assert len(found) == index.where("number % 2 = 1").count()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in found.values())
    starts = [tuple(r) for r in token_file_digest(docs, PATH).orderBy("start").select("doc_id", "start", "n_tokens").collect()]
    assert [d for d, _, _ in starts] == list(range(200))
    assert all(s + n == t for (_, s, n), (_, t, _) in zip(starts, starts[1:]))


def test_damaged_files_are_not_read(spark, make_docs, tmp_path):
    write_records(make_docs([(1, "one two three four five")]), f"{tmp_path}/data", PATH)
    index = write_index(spark, f"{tmp_path}/data", f"{tmp_path}/index")
    (file,) = [f for f in (tmp_path / "data").glob("part-*") if f.stat().st_size]
    data = bytearray(file.read_bytes())
    data[30] ^= 1
    file.with_name(f".{file.name}.crc").unlink()
    file.write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        read_records(spark, f"{tmp_path}/data", index).collect()


def test_damage_is_seen():
    data = bytearray(frame(9, np.arange(5), 2))
    assert read_frame(bytes(data), 0, 2)[0] == 9
    for at in (3, 9, 15, len(data) - 3):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            read_frame(bytes(broken), 0, 2)
