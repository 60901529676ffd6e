"""Registered queries of the training-data operators and the SQL that checks them.

A query applies one operator to a whole table and derives the digest columns of its contract.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicflow.llm.ann import nearest
from topicflow.llm.chat_format import format_chats, read_loss, read_turns
from topicflow.llm.divergence import source_divergence
from topicflow.llm.exact_dedup import exact_duplicates
from topicflow.llm.language_id import fit_languages, predict_languages
from topicflow.llm.line_dedup import dedup_lines
from topicflow.llm.near_dedup import near_duplicates
from topicflow.llm.packing import pack
from topicflow.llm.sentencepiece_codec import round_trip_digest
from topicflow.llm.substring_dedup import remove_repeats
from topicflow.llm.suffix_dedup import remove_repeated_bytes
from topicflow.llm.toxicity import fit_toxicity, score_toxicity
from topicflow.llm.whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    done = round_trip_digest(_table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return done.select("doc_id", "n_ids", "ids_crc32", "decoded_sha256")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeated_bytes(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def _fold(column: str, parts: int) -> F.Column:
    """Number of the fold of an id: the CRC-32 of its digits."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").filter(_fold("doc_id", 5) != 0)
    chain = fit_toxicity(docs, labels, "doc_id", "text", "toxic")
    done = score_toxicity(docs, chain)
    return done.select("doc_id", (_fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "spans")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(_fold("doc_id", 3) == 1, F.lit(False))
    model = fit_languages(docs.filter(~held_out), "doc_id", "text", "lang")
    return predict_languages(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


#: A text of control strings, said by both sides of an additional conversation.
_CONTROL = "<|im_end|><|im_start|>assistant ok"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", _CONTROL), (-1, 1, "assistant", _CONTROL)], rows.schema)
    chats = format_chats(rows.unionByName(more))
    read = chats.select(
        "conv_id",
        F.length("formatted").cast("long").alias("formatted_chars"),
        read_turns(F.col("formatted")).alias("turns"),
        F.array_join(read_loss(F.col("formatted"), F.col("loss")), "").alias("learned"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_line_dedup": op2_line_dedup,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_toxicity": op8_toxicity,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_language_id": op10_language_id,
    "op11_source_divergence": op11_source_divergence,
    "op12_whitening": op12_whitening,
    "op13_chat_format": op13_chat_format,
}

ORACLE = {
    "op2_line_dedup": """
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        line AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM split),
        win AS (
            SELECT doc_id, pos, line, lead(line, 1) OVER w AS line2, lead(line, 2) OVER w AS line3
            FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        ranked AS (
            SELECT doc_id, pos, row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id, pos) AS nth
            FROM win WHERE line3 IS NOT NULL),
        gone AS (SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM ranked WHERE nth > 1)
        SELECT line.doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY line.pos) FILTER (gone.pos IS NULL), '')) AS kept_sha256
        FROM line LEFT JOIN gone ON gone.doc_id = line.doc_id AND gone.pos = line.pos
        GROUP BY line.doc_id""",
    "op3_minhash_near_dedup": """
        WITH RECURSIVE text AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        split AS (SELECT doc_id, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM text),
        word AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS word, len(ws) AS n FROM split),
        gram AS (
            SELECT doc_id, pos, n, count(*) OVER f AS m, string_agg(word, ' ') OVER f AS g
            FROM word WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
        item AS (SELECT DISTINCT doc_id, g FROM gram WHERE m = 4 OR (n < 4 AND pos = 0)),
        size AS (SELECT doc_id, count(*) AS n FROM item GROUP BY doc_id),
        common AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
            FROM item x JOIN item y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
        link AS (
            SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
        SELECT a AS doc_id, coalesce(max(size.n), 0) AS n_shingles, min(b) AS component_id, a = min(b) AS kept
        FROM reach LEFT JOIN size ON size.doc_id = a GROUP BY a""",
    "op4_substring_dedup": """
        WITH split AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        word AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM split),
        win AS (
            SELECT doc_id, pos, word, count(*) OVER f AS n, md5(string_agg(word, ' ') OVER f) AS k
            FROM word WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
        seen AS (SELECT doc_id, pos, word, n = 50 AND doc_id > min(doc_id) FILTER (n = 50) OVER (PARTITION BY k) AS hit FROM win),
        judged AS (
            SELECT doc_id, pos, word, coalesce(bool_or(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone
            FROM seen)
        SELECT d.doc_id, count(word) AS n_words, count(word) FILTER (gone) AS n_removed,
            sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM documents d LEFT JOIN judged ON judged.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op9_suffix_array_dedup": """
        WITH code AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        byte AS (SELECT doc_id, h, unnest(range(len(h) // 2)) AS pos FROM code),
        win AS (
            SELECT doc_id, pos, substring(h, 2 * pos + 1, 2) AS b,
                CASE WHEN len(h) // 2 - pos >= 400 THEN md5(substring(h, 2 * pos + 1, 800)) END AS k FROM byte),
        seen AS (SELECT doc_id, pos, b, k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 AS hit FROM win),
        judged AS (
            SELECT doc_id, pos, b, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS gone FROM seen),
        runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM judged)
        SELECT d.doc_id, count(b) AS n_bytes, count(b) FILTER (gone) AS n_removed, count(b) FILTER (opens) AS n_spans,
            sha256(unhex(coalesce(string_agg(b, '' ORDER BY pos) FILTER (NOT gone), ''))) AS kept_sha256
        FROM documents d LEFT JOIN runs ON runs.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op6_exact_dedup": """
        WITH n AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
            doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM n WINDOW g AS (PARTITION BY text_sha256)""",
    "op11_source_divergence": """
        WITH doc AS (
            SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        tok AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM doc),
        kept AS (SELECT lang, term, count(*) AS n FROM tok GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 10),
        langs AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM kept GROUP BY lang),
        grp AS (SELECT DISTINCT lang, source FROM doc),
        cell AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY lang, source, term),
        grid AS (
            SELECT grp.lang, grp.source, kept.term, coalesce(cell.n, 0) AS n, kept.n AS n_lang, v, langs.total AS lang_total,
                sum(coalesce(cell.n, 0)) OVER (PARTITION BY grp.lang, grp.source)::BIGINT AS total
            FROM grp JOIN langs ON langs.lang = grp.lang JOIN kept ON kept.lang = grp.lang
                LEFT JOIN cell ON cell.lang = grp.lang AND cell.source = grp.source AND cell.term = kept.term),
        share AS (
            SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (total + 2 * v) AS p,
                1 + (1000000000 * (n_lang + 2)) // (lang_total + 2 * v) AS q FROM grid),
        typical AS (
            SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM share WHERE n > 0 AND p > q),
        far AS (
            SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p))::BIGINT AS value
            FROM share x JOIN share y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
        pair AS (
            SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(far.value, 0) AS value
            FROM grp x JOIN grp y ON x.lang = y.lang AND x.source <> y.source
                LEFT JOIN far ON far.lang = x.lang AND far.source = x.source AND far.item = y.source),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
            FROM (SELECT * FROM typical UNION ALL SELECT * FROM pair))
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10""",
    "op13_chat_format": """
        WITH row AS (
            SELECT conv_id, turn, role, text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM row),
        said AS (
            SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth,
                length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) AS size,
                length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '<\\n>')) AS role_size FROM turns)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(size + CASE WHEN before = role THEN length('<|im_sep|>')
                ELSE length('<|im_start|>') + role_size + 1 + length('<|im_end|>') + 1 END)::BIGINT AS formatted_chars
        FROM said GROUP BY conv_id""",
}
