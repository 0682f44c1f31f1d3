"""The registered queries: each applies an operator to its whole table."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

_SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string",
}


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if it is not installed."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_records(spark: SparkSession, folder: str) -> DataFrame:
    from patronlens.llm.records import token_file_digest

    return token_file_digest(table(spark, folder, "documents"), tokenizer_path(), end_id=2)


def bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    from patronlens.llm.bpe import encode_documents

    encoded = encode_documents(table(spark, folder, "documents"), tokenizer_path())
    return encoded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    from patronlens.llm.secret_scan import scan_secrets

    return scan_secrets(table(spark, folder, "documents"))


def quality_verdict(spark: SparkSession, folder: str) -> DataFrame:
    from patronlens.llm.quality import quality_rules

    ruled = quality_rules(table(spark, folder, "documents"))
    return ruled.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "lang", "log10_perplexity", "lower", "upper",
    )


def repeated_substrings(spark: SparkSession, folder: str) -> DataFrame:
    from patronlens.llm.substrings import remove_repeats

    cut = remove_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def near_duplicate_groups(spark: SparkSession, folder: str) -> DataFrame:
    from patronlens.llm.near_duplicates import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


def warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    from patronlens.llm.warc import archive_round_trip

    read = archive_round_trip(table(spark, folder, "pages"), min_bytes=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def benchmark_passages(spark: SparkSession, folder: str) -> DataFrame:
    from patronlens.llm.decontamination import contamination

    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def surrogate_texts(spark: SparkSession, folder: str) -> DataFrame:
    from patronlens.llm.surrogates import pseudonymize

    return pseudonymize(table(spark, folder, "documents"), key="patronlens").select("doc_id", "text", "n_entities")


def languages(spark: SparkSession, folder: str) -> DataFrame:
    from patronlens.llm.language import held_out, identify_languages, train, training_sample

    docs = table(spark, folder, "documents")
    network = train(training_sample(docs.where(~held_out(F.col("doc_id")))))
    found = identify_languages(docs, network)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def spelling_groups(spark: SparkSession, folder: str) -> DataFrame:
    from patronlens.llm.spelling import spelling_variants

    return spelling_variants(table(spark, folder, "documents"))


def prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    from patronlens.llm.prefix_trie import conversation_trie

    return conversation_trie(table(spark, folder, "conversations"))


def rendezvous_shards(spark: SparkSession, folder: str) -> DataFrame:
    from patronlens.llm.sharding import shard_table

    return shard_table(table(spark, folder, "documents"), [1.0] * 24, more=[1.0])


#: Checksums by half bytes: what CRC-32 (reflected polynomial EDB88320) does to each of the 16.
_HALF_BYTES = """[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384,
    4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"""


def _crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8 bytes."""
    return f"""xor(4294967295::BIGINT, list_reduce(
        list_transform(
            regexp_extract_all(regexp_replace(hex({text}), '(.)(.)', '\\2\\1', 'g'), '.'),
            lambda p: ('0x' || p)::BIGINT),
        lambda c, x: xor(c >> 4, list_extract({_HALF_BYTES}, (xor(c, x) & 15) + 1)), 4294967295::BIGINT))"""


QUERIES = {
    "op1_warc_boundary_chain": warc_round_trip,
    "op2_pii_surrogates": surrogate_texts,
    "op3_spaced_seeds": benchmark_passages,
    "op4_secret_guess_cost": secret_scan,
    "op5_bidirectional_gru": languages,
    "op6_ngram_perplexity": quality_verdict,
    "op7_rabin_karp_windows": repeated_substrings,
    "op8_token_records": token_records,
    "op9_bottom_k_sketches": near_duplicate_groups,
    "op10_bpe_round_trip": bpe_round_trip,
    "op11_gram_spelling": spelling_groups,
    "op12_double_array_trie": prefix_trie,
    "op13_rendezvous_shards": rendezvous_shards,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op1_warc_boundary_chain": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (
            SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex,
                max(page_id) OVER (PARTITION BY html) AS holder
            FROM p
        )
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
            translate(
                array_to_string([lpad(upper(to_base(('0x' || hex[5 * i + 1 : 5 * i + 5])::BIGINT, 32)), 4, '0')
                    FOR i IN range(8)], ''),
                '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'
            ) AS payload_digest,
            CASE WHEN coalesce(page_id, holder - 1) <> holder THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN coalesce(page_id, holder - 1) <> holder THEN holder END AS refers_to
        FROM d
    """,
    "op11_gram_spelling": f"""
        WITH RECURSIVE runs AS (
            SELECT doc_id, run, count(*) AS times FROM (
                SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
                FROM documents)
            GROUP BY ALL HAVING length(run) >= 5
        ),
        hashed AS (SELECT *, {_crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs),
        words AS (
            SELECT word, sum(times)::BIGINT AS n FROM (
                SELECT times, CASE WHEN h % 97 = 0
                    THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
                FROM hashed)
            GROUP BY word HAVING length(word) >= 5 AND sum(times) >= 3
        ),
        cuts AS (
            SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest
            FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
        ),
        near AS (
            SELECT a.word, a.n, b.word AS near, b.n AS near_n
            FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION
            SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
            UNION
            SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
        ),
        best AS (
            SELECT word, n, count(*) AS n_near, max(near_n) AS most FROM near GROUP BY word, n
        ),
        forms AS (
            SELECT b.word, n_near, CASE WHEN most >= 2 * b.n THEN min(near.near) END AS form,
                CASE WHEN most >= 2 * b.n THEN most END AS form_n
            FROM best b JOIN near ON near.word = b.word AND near_n = most GROUP BY b.word, b.n, n_near, most
        ),
        chain(word, root) AS (
            SELECT word, word FROM words
            UNION ALL
            SELECT chain.word, form FROM chain JOIN forms ON forms.word = chain.root WHERE form IS NOT NULL
        ),
        ends AS (SELECT chain.word, root FROM chain LEFT JOIN forms ON forms.word = chain.root WHERE form IS NULL)
        SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, form, form_n, root
        FROM words w LEFT JOIN forms ON forms.word = w.word JOIN ends ON ends.word = w.word
    """,
    "op12_double_array_trie": f"""
        WITH turns AS (
            SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST,
                sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS own
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ),
        shares AS (SELECT *, {_crc32_sql("conv_id::VARCHAR")} % 9 AS h FROM turns),
        rebuilt AS (
            SELECT s.conv_id, list_concat(coalesce(t.own, [])[1 : h], s.own[h + 1 :]) AS seq
            FROM shares s LEFT JOIN turns t ON t.conv_id = s.conv_id - s.conv_id % 5
        ),
        members AS (SELECT conv_id, seq, len(seq) AS length, unnest(range(len(seq) + 1)) AS depth FROM rebuilt),
        nodes AS (
            SELECT depth, seq[1 : depth] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
                sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256
            FROM members GROUP BY 1, 2
        ),
        kids AS (
            SELECT n.*, count(k.conv_id) AS n_children
            FROM nodes n LEFT JOIN nodes k ON k.depth = n.depth + 1 AND k.prefix[1 : n.depth] = n.prefix GROUP BY ALL
        ),
        sums AS (
            SELECT up, prefix[1 : up] AS prefix, count(*) FILTER (n_children = 0) AS n_leaves,
                sum(CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(prefix[depth].text) ELSE 0 END) AS saved_tokens
            FROM (SELECT *, unnest(range(depth + 1)) AS up FROM kids) GROUP BY 1, 2
        )
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves,
            saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
        FROM kids n JOIN sums ON up = n.depth AND sums.prefix = n.prefix
        LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1 : n.depth - 1]
    """,
    "op13_rendezvous_shards": f"""
        WITH d AS (
            SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, {_crc32_sql("coalesce(text, '')")} AS text_crc32
            FROM documents
        ),
        draws AS (
            SELECT DISTINCT doc_id, s, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || s), 1, 13))::BIGINT AS u
            FROM (SELECT DISTINCT doc_id FROM d), range(25) r(s)
        ),
        best AS (
            SELECT doc_id, arg_max(s, u * 32 - s) FILTER (s < 24) AS shard, arg_max(s, u * 32 - s) AS grown_shard
            FROM draws GROUP BY doc_id
        )
        SELECT d.doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
            row_number() OVER (
                PARTITION BY shard
                ORDER BY md5(coalesce(d.doc_id::VARCHAR, '') || ':' || size || ':' || text_crc32), d.doc_id, size, text_crc32
            ) - 1 AS slot,
            grown_shard::INTEGER AS grown_shard
        FROM d JOIN best ON best.doc_id IS NOT DISTINCT FROM d.doc_id
    """,
    "op7_rabin_karp_windows": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ),
        w AS (
            SELECT doc_id, s, words[s : s + 12] AS win
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS s FROM d)
        ),
        repeated AS (
            SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY win) AS least FROM w) WHERE least < doc_id
        ),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS j FROM repeated),
        per AS (SELECT doc_id, count(*) AS n, list(j) AS js FROM gone GROUP BY doc_id)
        SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
            sha256(array_to_string(
                CASE WHEN n IS NULL THEN words
                ELSE [words[i] FOR i IN range(1, len(words) + 1) IF NOT list_contains(js, i)] END, ' ')) AS kept_sha256
        FROM d LEFT JOIN per ON per.doc_id = d.doc_id
    """,
    "op9_bottom_k_sketches": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ),
        s AS (
            SELECT DISTINCT doc_id, words[k : k + 4] AS shingle
            FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS k FROM d WHERE len(words) > 0)
        ),
        n AS (SELECT d.doc_id, count(shingle) AS size FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
        common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_
            FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
        ),
        links AS (
            SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
            WHERE 100 * both_ >= 75 * (x.size + y.size - both_)
        ),
        reach(node, seen) AS (
            SELECT doc_id, doc_id FROM n
            UNION
            SELECT node, b FROM reach JOIN links ON a = seen
        ),
        least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
        SELECT doc_id, size::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
        FROM n JOIN least ON node = doc_id
    """,
}
