from __future__ import annotations

import re

from pyspark.sql import functions as F

from patronlens.llm.surrogates import pseudonymize, settle


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


ROWS = [
    (1, "write to bob.smith42@mail1.example.com or BOB.SMITH42@MAIL1.EXAMPLE.COM."),
    (2, "again bob.smith42@mail1.example.com, and ann@b.org"),
    (3, "call +1 (988) 555-2485 or 988-555-2485 now"),
    (4, "card 4845168114407329, split 4845 1681 1440 7329; order 2669109448945251 stays"),
    (5, "host 70.123.182.155 and 70.123.182.155; version 2.0.1, 1.2.3.4.5, 300.1.1.1"),
    (6, "ssn 123-45-6789"),
    (7, "Mrs. Anna Kowalska met Mr. Kowalska. Later Anna left; Annabel did not."),
    (8, "г-жа Вера Петрова и Петрова"),
    (9, None), (10, ""), (11, "nothing here"), (12, "x" * 200_000 + "@"), (13, "a" * 60_000 + " " + "q@w.io " * 50),
    (1, "write to bob.smith42@mail1.example.com or BOB.SMITH42@MAIL1.EXAMPLE.COM."), (1, "other text, ann@b.org"), (None, "ann@b.org"), (None, None),
]


def test_surrogates_keep_type_format_and_identity(make_docs):
    docs = make_docs(ROWS)
    got = pseudonymize(docs, "k")
    assert got.columns == [*docs.columns, "n_entities"] and got.count() == len(ROWS)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, pseudonymize(docs, "k").collect()))
    text = {r["doc_id"]: r["text"] for r in got.collect() if r["doc_id"] not in (1, None)}
    ones = sorted(r["text"] for r in got.where("doc_id = 1").collect())
    assert ones[1] == ones[2]
    mail, loud = re.findall(r"\S+@\S+[a-zA-Z]", ones[1])
    assert loud == mail.upper() and re.fullmatch(r"[a-z]{3}\.[a-z]{5}\d\d@mail\d\d\.example\.(com|net|org)", mail)
    assert mail in text[2] and mail != "bob.smith42@mail1.example.com"
    ann = re.search(r"and (\S+)", text[2])[1]
    assert ann in ones[0] and ann != mail and ann in {r["text"] for r in got.where("doc_id is null").collect()}
    phone = re.fullmatch(r"call \+1 \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})-(\d{3})-(\d{4}) now", text[3]).groups()
    assert phone[:3] == phone[3:] and "".join(phone[:3]) != "9885552485"
    one, other = re.fullmatch(r"card (\d{16}), split (\d{4} \d{4} \d{4} \d{4}); order 2669109448945251 stays", text[4]).groups()
    assert one == other.replace(" ", "") and one[0] == "4" and luhn(one) and one != "4845168114407329"
    addresses = re.findall(r"10\.\d+\.\d+\.\d+", text[5])
    assert len(addresses) == 2 and addresses[0] == addresses[1]
    assert text[5].endswith("version 2.0.1, 1.2.3.4.5, 300.1.1.1")
    assert re.fullmatch(r"ssn 9\d\d-\d\d-\d{4}", text[6])
    given, surname, again, bare = re.fullmatch(r"Mrs\. (\p{L}+|\w+) ([\w-]+) met Mr\. ([\w-]+)\. Later (\w+) left; Annabel did not\.".replace(r"\p{L}+|", ""), text[7]).groups()
    assert given == bare != "Anna" and surname == again != "Kowalska"
    cyrillic = re.fullmatch(r"г-жа (\w+) ([\w-]+) и ([\w-]+)", text[8]).groups()
    assert cyrillic[1] == cyrillic[2] and all(re.fullmatch("[А-Яа-яё-]+", w) for w in cyrillic) and "Петрова" not in text[8]
    assert text[9] is None and text[10] == "" and text[11] == "nothing here" and text[12] == ROWS[11][1]
    assert "q@w.io" not in text[13] and len(set(re.findall(r"\S+@\S+", text[13]))) == 1
    counts = {r["doc_id"]: r["n_entities"] for r in got.where("doc_id is not null").collect()}
    assert (counts[4], counts[9], counts[11], counts[13]) == (2, 0, 0, 50)
    other_key = {r["doc_id"]: r["text"] for r in pseudonymize(docs, "other").collect()}
    assert other_key[2] != text[2]
    assert pseudonymize(make_docs([]), "k").collect() == []


def test_crowded_formats_stay_distinct(spark):
    # 2,600 local parts of one letter and two digits, in a space hardly larger; 300 given names on lists of 16.
    mails = [("email", f"{chr(97 + i % 26)}{i // 26:02d}@x.io") for i in range(2600)]
    names = [("given-female", f"name{i}") for i in range(150)] + [("given-male", f"other{i}") for i in range(150)] + [("surname", "anna")]
    rows = settle(spark.createDataFrame([*mails, *names, *mails[:500]], "kind string, canonical string"), "k").collect()
    assert len(rows) == 2600 + 301
    drawn = [(r["kind"] == "email", r["surrogate"].lower()) for r in rows]
    assert len(set(drawn)) == len(drawn)
    assert not {s for _, s in drawn} & {r["canonical"] for r in rows}


def test_no_python_in_the_plan(make_docs):
    plan = pseudonymize(make_docs(ROWS[:3]), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "MapInArrow" not in plan


def test_unchanged_columns(make_docs):
    docs = make_docs(ROWS).withColumn("n_entities", F.lit("mine"))
    assert pseudonymize(docs, "k").columns.count("n_entities") == 1
