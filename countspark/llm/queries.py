"""The registered queries of the subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countspark.llm import bpe, edit_embedding, embeddings, fim, importance, packing, pii, quotes, sharding, simhash, token_counts, toxicity, wrapper
from countspark.llm.common import scratch_path, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(encoded, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placed by version 1 of a stored map; next_shard is where version 2, edited for one more shard, would put the row."""
    places, first = sharding.shard(table(spark, sf_dir, "documents"), shards=16)
    maps = scratch_path(spark)
    sharding.write_map(first, maps)
    sharding.write_map(sharding.grow(sharding.read_map(spark, maps), 16), maps)
    after = sharding.read_map(spark, maps, 2).select("virtual_slot", F.col("shard").alias("next_shard"))
    return places.join(F.broadcast(after), "virtual_slot").select(  # a row for each slot
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard"
    )


def op4_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


OP4_SQL = r"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, role, text, regexp_split_to_array(text, '\r?\n') AS lines,
         row_number() OVER () AS part
  FROM conversations
), every AS (
  SELECT part, conv_id, turn, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
  FROM said WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), marked AS (
  SELECT *, regexp_extract(line, '^((?:[ \t]*>)+)', 1) AS marks FROM every
), quoted AS (
  SELECT part, conv_id, turn, pos, length(regexp_replace(marks, '[^>]', '', 'g')) AS level, substr(line, length(marks) + 1) AS line
  FROM marked WHERE marks <> ''
), opened AS (
  SELECT *, CASE WHEN lag(pos) OVER w IS NOT NULL AND (lag(pos) OVER w <> pos - 1 OR lag(level) OVER w <> level) THEN 1 ELSE 0 END AS opens
  FROM quoted WINDOW w AS (PARTITION BY part ORDER BY pos)
), passages AS (
  SELECT *, sum(opens) OVER (PARTITION BY part ORDER BY pos) AS passage FROM opened
), whole AS (
  SELECT conv_id, turn, level, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) + 1 AS weight
  FROM passages GROUP BY part, conv_id, turn, level, passage
), paragraphs AS (
  SELECT conv_id, turn, level, line, length(line) - length(replace(line, chr(10), '')) + 2 AS weight
  FROM (SELECT conv_id, turn, level, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) AS line FROM whole WHERE regexp_matches(text, '\n[ \t\r]*\n'))
), sought AS (
  SELECT conv_id, turn, level, trim(regexp_replace(lower(line), '\s+', ' ', 'g'), ' ') AS said, weight
  FROM (SELECT conv_id, turn, level, text AS line, weight FROM whole UNION ALL FROM paragraphs UNION ALL SELECT conv_id, turn, level, line, 1 FROM quoted)
), own_lines AS (
  SELECT part, conv_id, turn, pos, line FROM marked WHERE marks = ''
), own_texts AS (
  SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY pos) AS text FROM own_lines GROUP BY part, conv_id, turn
), own AS (
  SELECT conv_id, turn, trim(regexp_replace(lower(line), '\s+', ' ', 'g'), ' ') AS said
  FROM (SELECT conv_id, turn, line FROM own_lines
        UNION ALL SELECT conv_id, turn, text FROM own_texts
        UNION ALL SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) FROM own_texts)
), firsts AS (
  SELECT conv_id, said, min(turn) AS original FROM own WHERE said <> '' GROUP BY conv_id, said
), votes AS (
  SELECT s.conv_id, s.turn, s.level, f.original, sum(s.weight) AS weight
  FROM sought s JOIN firsts f ON s.conv_id = f.conv_id AND s.said = f.said AND f.original < s.turn
  GROUP BY s.conv_id, s.turn, s.level, f.original
), parents AS (
  SELECT conv_id, turn, original AS parent_turn FROM votes
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, weight DESC, original) = 1
), up AS (
  SELECT conv_id, turn, parent_turn, parent_turn AS root_turn, 1 AS depth FROM parents
  UNION ALL
  SELECT u.conv_id, u.turn, u.parent_turn, p.parent_turn, u.depth + 1
  FROM up u JOIN parents p ON p.conv_id = u.conv_id AND p.turn = u.root_turn
), placed AS (
  SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY depth DESC) = 1
), clean AS (
  SELECT conv_id, turn, role, text, len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*>'))) AS n,
         array_to_string(list_filter(lines, lambda x: NOT regexp_matches(x, '^[ \t]*>')), chr(10)) AS own
  FROM said
)
SELECT c.conv_id, c.turn, c.role, CASE WHEN n > 0 THEN regexp_replace(own, '^\s+|\s+$', '', 'g') ELSE text END AS text,
       CAST(coalesce(n, 0) AS BIGINT) AS n_quoted_lines, p.parent_turn AS parent_turn,
       coalesce(p.root_turn, c.turn) AS root_turn, CAST(coalesce(p.depth, 0) AS BIGINT) AS depth
FROM clean c LEFT JOIN placed p ON p.conv_id = c.conv_id AND p.turn = c.turn
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.against_edits(table(spark, sf_dir, "documents"))


def edit_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7's banding and verification: (doc_id, fingerprint, component_id)."""
    return edit_embedding.near_duplicates(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.spans(docs, pii.fit(docs))
    said = {c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",") for c in ("base", "spans")}
    kinds = F.col("base")["kind"]
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(said["base"], 256).alias("base_sha256"), said["spans"].alias("spans"))


def op11_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(table(spark, sf_dir, "pages"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.restore(fim.transform(table(spark, sf_dir, "documents")))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP12_SQL = r"""
WITH read AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents
), drawn AS (
  SELECT *, CAST(len(tokens) AS BIGINT) AS n, CAST('0x' || substr(digest, 1, 8) AS BIGINT) % (len(tokens) + 1) AS a,
         CAST('0x' || substr(digest, 9, 8) AS BIGINT) % (len(tokens) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR CAST('0x' || substr(digest, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(digest, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM read
), cut AS (
  SELECT doc_id, n, form, text, array_to_string(tokens[:least(a, b)], '') AS prefix,
         array_to_string(tokens[least(a, b) + 1 : greatest(a, b)], '') AS middle, array_to_string(tokens[greatest(a, b) + 1 :], '') AS suffix
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM cut
"""


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_toxicity": op2_toxicity,
        "op3_sharding": op3_sharding,
        "op4_quotes": op4_quotes,
        "op5_packing": op5_packing,
        "op6_embeddings": op6_embeddings,
        "op7_edit_embedding": op7_edit_embedding,
        "op8_simhash": op8_simhash,
        "op9_token_counts": op9_token_counts,
        "op10_pii": op10_pii,
        "op11_wrapper": op11_wrapper,
        "op12_fim": op12_fim,
        "op13_importance": op13_importance,
        "edit_duplicates": edit_duplicates,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_quotes": OP4_SQL, "op12_fim": OP12_SQL}
