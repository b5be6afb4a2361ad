"""Registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import chat, decontam, exact, language, licenses, passages, ring, sentencepiece_rounds, simhash, token_blocks, token_cache, trie, whitening
from cuelake.llm.common import tables


def op1_chat_format(spark: SparkSession, d: str) -> DataFrame:
    rows = tables(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    made = chat.format_messages(chat.fold_events(chat.table_log(rows.unionByName(more))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chat.read_back(made).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


def op2_token_files(spark: SparkSession, d: str) -> DataFrame:
    return token_blocks.token_files(tables(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op3_simhash(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.near_duplicates(tables(spark, d, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    found = decontam.contaminated(tables(spark, d, "documents"), tables(spark, d, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "plain", "needed")


def op5_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = exact.exact_duplicates(tables(spark, d, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_cache.count_tokens(tables(spark, d, "documents"), token_cache.fresh_cache(spark), public_tokenizers.path("byte_bpe_50k.json"))


def op7_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    return sentencepiece_rounds.piece_digests(tables(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = tables(spark, d, "documents").withColumn("held_out", language.in_fold(F.col("doc_id")))
    model = language.train(docs.filter(~F.col("held_out")))
    return language.classify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op9_shard(spark: SparkSession, d: str) -> DataFrame:
    return ring.shard_rows(tables(spark, d, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "moved")


def op10_repeated_passages(spark: SparkSession, d: str) -> DataFrame:
    found = passages.repeated_spans(tables(spark, d, "documents"))
    return found.select("doc_id", "start", "end", "n_units", "n_words", "kept_doc_id")


def op11_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return licenses.summary(licenses.scan(tables(spark, d, "documents")))


def op12_whitening(spark: SparkSession, d: str) -> DataFrame:
    x = whitening.same_length(whitening.vectors(tables(spark, d, "embeddings").select("vec_id", "embedding")))
    return whitening.whiten(x, whitening.fit_whitener(x))


def op13_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    return trie.prefix_trie(*trie.rebuilt(trie.turns_of(tables(spark, d, "conversations"))))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_token_files, op3_simhash, op4_decontaminate, op5_exact_dedup, op6_token_counts,
                                   op7_sentencepiece, op8_language_id, op9_shard, op10_repeated_passages,
                                   op11_license_scan, op12_whitening, op13_prefix_trie)}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ESCAPED = r"replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e')"

SQL = {
    "op1_chat_format": rf"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, n, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)),
             f AS (SELECT *, '### ' || CASE WHEN role IN ('user', 'assistant', 'system', 'tool') THEN upper(role[1]) || role[2:]
                     ELSE '=' || replace({ESCAPED.replace("text", "role")}, ':', '\c') END || ': ' || {ESCAPED} || '</turn>' || chr(10) AS line FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
          sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
          sum(length(line))::BIGINT AS formatted_chars
        FROM f GROUP BY conv_id""",
    "op5_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {LOWER} AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM n GROUP BY t)
        SELECT n.doc_id, keep_id, group_size, n.doc_id IS NOT DISTINCT FROM keep_id
                 AND row_number() OVER (PARTITION BY n.t, n.doc_id) = 1 AS kept, text_sha256
        FROM n JOIN g USING (t)""",
    "op13_prefix_trie": """
        WITH turns AS (SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                         ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
                       FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
             hashed AS (SELECT c, l, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT,
                         list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce(
                         list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h
                       FROM turns),
             made AS (SELECT a.c, list_concat(coalesce(b.l, [])[:a.h], a.l[a.h + 1:]) AS l FROM hashed a LEFT JOIN turns b ON b.c = a.base),
             steps AS (SELECT c, len(l) AS n, d, l[:d] AS p FROM made, unnest(range(len(l) + 1)) AS u(d)),
             nodes AS (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, d > 0 AS below,
                         coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends,
                         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(p[d].text) END AS own FROM steps GROUP BY d, p),
             kids AS (SELECT d - 1 AS d, p[:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
             full_ AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.d = n.d AND k.p = n.p),
             tree AS (SELECT u.d, v.p[:u.d] AS p, sum(v.own) AS saved_tokens, count(*) FILTER (v.n_children = 0) AS n_leaves
                      FROM full_ v, unnest(range(v.d + 1)) AS u(d) GROUP BY ALL)
        SELECT n.conv_id, n.d AS depth, m.conv_id AS parent_conv_id, n.n_convs, n.n_children, t.n_leaves, t.saved_tokens::BIGINT AS saved_tokens,
          sha256(n.ends) AS ends_sha256
        FROM full_ n JOIN tree t ON t.d = n.d AND t.p = n.p LEFT JOIN nodes m ON n.below AND m.d = n.d - 1 AND m.p = n.p[:n.d - 1]""",
    "op11_license_scan": licenses.twin_sql(),
}
