"""Queries over the driver's tables that apply each operator of this subpackage, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushpage.llm.fingerprints import fingerprint_with_next
from hushpage.llm.hard_negatives import mine_hard_negatives
from hushpage.llm.importance import importance_resample
from hushpage.llm.jaccard_join import near_duplicates
from hushpage.llm.language_model import language_model_scores
from hushpage.llm.mixing import id_or_text, mix_sources, quality_weight, word_count
from hushpage.llm.packing import pack_documents
from hushpage.llm.preferences import answer_swaps, format_preferences
from hushpage.llm.sentence_pieces import encode_texts
from hushpage.llm.substrings import remove_repeats
from hushpage.llm.token_counts import token_counts
from hushpage.llm.toxicity import id_remainder, toxicity_scores
from hushpage.llm.vector_search import exact_top_k, scaled_integers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"), id_remainder("doc_id", 5) == 1, rounds=4)


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with another's last answer; masks as runs such as 22-,340+,1-."""
    out = format_preferences(answer_swaps(table(spark, sf_dir, "conversations")))
    for side in ("chosen", "rejected"):
        runs = F.transform(f"{side}_mask", lambda r: F.concat(r["length"].cast("string"), F.when(r["scored"], "+").otherwise("-")))
        out = out.withColumn(f"{side}_mask", F.array_join(runs, ","))
    return out


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = word_count(F.col("text"))
    return mix_sources(table(spark, sf_dir, "documents"), size, quality_weight(F.col("text"), size), identity=id_or_text(F.col("doc_id"), F.col("text")))


def op4_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", scaled_integers(F.col("embedding"), 64.0).alias("vector"))
    return exact_top_k(rows, F.col("vec_id") % 20 == 0, k=20)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " "), F.lit(" "))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_next(table(spark, sf_dir, "documents"))


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decode=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", scaled_integers(F.col("embedding"), 256.0).alias("vector"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows, label, F.col("vec_id") % 50 == 0)


ROLE_SQL, TEXT_SQL = (
    f"replace(replace({field}, '<|im_start|>', '< |im_start| >'), '<|im_end|>', '< |im_end| >')"
    for field in ("regexp_replace(t.role, '[\\r\\n]+', ' ', 'g')", "t.text")
)


def _turns_sql(turns: str) -> str:
    """SQL for the rendered form of a list of turns."""
    rendered = f"'<|im_start|>' || {ROLE_SQL} || chr(10) || {TEXT_SQL} || '<|im_end|>' || chr(10)"
    return f"array_to_string(list_transform({turns}, lambda t: {rendered}), '')"


def _runs_sql(turns: str) -> str:
    """SQL for the mask of a list of turns; a run's length is that of the text that it covers."""
    head, body = f"length('<|im_start|>' || {ROLE_SQL} || chr(10))", f"length({TEXT_SQL} || '<|im_end|>')"
    runs = f"{head} || '-,' || {body} || CASE WHEN t.role = 'assistant' THEN '+' ELSE '-' END || ',1-'"
    return f"array_to_string(list_transform({turns}, lambda t: {runs}), ',')"


OP2_SQL = f"""
WITH n AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS own, coalesce(max(pos) FILTER (WHERE role = 'assistant'), 0) AS last
  FROM n GROUP BY conv_id),
p AS (
  SELECT a.conv_id AS pair_id, a.own AS c,
         CASE WHEN a.last = 0 THEN a.own WHEN coalesce(b.last, 0) = 0 THEN a.own[1:a.last - 1]
              ELSE list_concat(a.own[1:a.last - 1], b.own[b.last:b.last]) END AS r
  FROM c a LEFT JOIN c b ON b.conv_id = xor(a.conv_id, 1)),
q AS (
  SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(c), len(r)) + 1),
                     lambda i: i > least(len(c), len(r)) OR c[i] IS DISTINCT FROM r[i])) - 1, len(c))::INT AS n_common FROM p),
s AS (SELECT *, c[n_common + 1:] AS cs, r[n_common + 1:] AS rs FROM q)
SELECT pair_id, len(c)::INT AS n_chosen, len(r)::INT AS n_rejected, n_common, {_turns_sql("c[1:n_common]")} AS prompt,
       {_turns_sql("cs")} AS chosen, {_turns_sql("rs")} AS rejected, {_runs_sql("cs")} AS chosen_mask, {_runs_sql("rs")} AS rejected_mask
FROM s
"""

OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
e AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '#' || md5(text))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
         / ((CASE WHEN length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) BETWEEN 3 * size AND 10 * size THEN 1::DOUBLE ELSE 0.25::DOUBLE END)
            * (CASE WHEN size >= 50 THEN 1::DOUBLE ELSE 0.5::DOUBLE END)) AS key
  FROM d),
s AS (
  SELECT source, source_size, sid, w, 2::DOUBLE * source_size AS cap FROM (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid,
           [3::DOUBLE, 1::DOUBLE, 2::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
    FROM e GROUP BY source)),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (
  SELECT source, source_size,
         CASE WHEN cap <= level * w THEN cap ELSE max(level) FILTER (WHERE cap > level * w) OVER () * w END AS target FROM l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
u AS (
  SELECT e.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS room,
         sum(size) OVER (PARTITION BY e.source ORDER BY key, doc_id NULLS FIRST, size) - size AS ahead
  FROM e JOIN p ON e.source IS NOT DISTINCT FROM p.source),
f AS (SELECT *, size > 0 AND ahead + size / 2::DOUBLE <= room AS first FROM u),
g AS (SELECT *, room - sum(CASE WHEN first THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM f),
h AS (SELECT *, NOT first AND size > 0 AND size <= gap AS fits FROM g),
i AS (SELECT *, sum(CASE WHEN fits THEN size ELSE 0 END)
                OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size) - size AS later FROM h)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM (
  SELECT *, epochs + (first OR (fits AND later + size / 2::DOUBLE <= gap))::BIGINT AS copies FROM i)
"""

OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

#: crc32 goes over the hexadecimal bytes of each different word, with a table that the SQL makes of its polynomial.
OP12_SQL = r"""
WITH poly AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
                        lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END)) AS t),
own AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
other AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
a AS (SELECT doc_id, unnest(words) AS word FROM own),
b AS (SELECT unnest(words) AS word FROM other),
known AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM (SELECT word FROM a UNION ALL SELECT word FROM b)),
bucket AS (
  SELECT word, xor(4294967295::BIGINT, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
           lambda c, x: xor(c // 256, t[(xor(c, x) % 256) + 1]))) % 10000 AS bucket
  FROM known, poly),
s AS (SELECT bucket, count(*) AS s FROM a JOIN bucket USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN bucket USING (word) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM a) + 10000)::DOUBLE
                                 / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)),
w AS (
  SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM a JOIN bucket USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
d AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h
  FROM own LEFT JOIN w USING (doc_id)),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM e)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= (SELECT count(*) FROM e WHERE n_features >= 20) * 10 // 100 THEN place END AS rank
FROM r
"""

OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

QUERIES = {
    "op1_language_model": op1_language_model,
    "op2_preference_format": op2_preference_format,
    "op3_mix_sources": op3_mix_sources,
    "op4_pack_documents": op4_pack_documents,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_token_counts": op7_token_counts,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_fingerprints": op10_fingerprints,
    "op11_sentence_pieces": op11_sentence_pieces,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES = {"op2_preference_format": OP2_SQL, "op3_mix_sources": OP3_SQL, "op5_exact_top_k": OP5_SQL, "op12_importance_resampling": OP12_SQL, "op13_hard_negatives": OP13_SQL}
