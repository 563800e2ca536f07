"""The subpackage's registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitweave.llm import chat_format, exact_dedup, mixing, near_dedup, quality_rules, sentencepiece_codec, substring_dedup, token_binary, toxicity, warc_index


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body, length(coalesce(text, '')) AS n FROM documents),
g AS (SELECT body, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256 FROM t JOIN g ON t.body = g.body
"""


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t (conv_id, turn, role, text)")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat_format.read_windows(chat_format.format_windows(turns))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (SELECT *, row_number() OVER w AS place, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 3 AS tokens,
  length(regexp_replace(text, '(\[|<)(~*)(TURN\]|PAST\]|SAYS\]|INST\]|/INST\]|s>|/s>|<SYS>>|</SYS>>)', '\1~\2\3', 'g'))
  + length(regexp_replace(role, '(\[|<)(~*)(TURN\]|PAST\]|SAYS\]|INST\]|/INST\]|s>|/s>|<SYS>>|</SYS>>)', '\1~\2\3', 'g')) + 16 AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
s AS (SELECT *, coalesce(sum(CASE WHEN place = 1 AND role = 'system' THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS starts FROM p),
k AS (SELECT *, starts // 512 AS span FROM s),
first_of AS (SELECT conv_id, span, min(starts) AS begins, lead(min(starts)) OVER (PARTITION BY conv_id ORDER BY span) AS next_begins, count(*) OVER (PARTITION BY conv_id) AS spans FROM k GROUP BY conv_id, span),
c AS (SELECT k.*, CASE WHEN place = 1 AND role = 'system' THEN spans WHEN next_begins - starts <= 128 THEN 2 ELSE 1 END AS copies FROM k JOIN first_of USING (conv_id, span))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars * copies)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (ARRAY[1, 2, 3])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM d GROUP BY source),
l AS (SELECT *, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT - coalesce(sum(3 * source_size) OVER w, 0)::BIGINT AS rest,
  (sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER w, 0)::BIGINT AS weights
  FROM s WINDOW w AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT rest AS r, weights AS w FROM l WHERE cap * weights >= rest * weight ORDER BY cap::DOUBLE / weight, source NULLS LAST LIMIT 1),
g AS (SELECT source, source_size, CASE WHEN cap * w < r * weight THEN cap::DOUBLE ELSE (r * weight)::DOUBLE / w::DOUBLE END AS target FROM l, f),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
x AS (SELECT o.doc_id, o.size, g.source_size, g.target, o.start, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END AS whole FROM o JOIN g ON o.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN (2 * start + size)::DOUBLE < 2.0 * (target - (whole * source_size)::DOUBLE) THEN 1 ELSE 0 END) AS taken FROM x
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


OP7_SQL = r"""
WITH w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM documents)),
g AS (SELECT doc_id, p, word, CASE WHEN count(*) OVER ahead = 13 THEN string_agg(word, ' ') OVER ahead END AS gram
  FROM w WINDOW ahead AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
least AS (SELECT gram, min(doc_id) AS first_doc FROM g WHERE gram IS NOT NULL GROUP BY gram),
hit AS (SELECT g.doc_id, p, word, coalesce(first_doc < g.doc_id, false) AS again FROM g LEFT JOIN least ON g.gram = least.gram),
gone AS (SELECT doc_id, p, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS lost FROM hit),
told AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (lost) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT lost), '')) AS kept_sha256 FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM documents d LEFT JOIN told ON d.doc_id = told.doc_id
"""


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.write_and_read(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE l AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM l),
s AS (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, p, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS gram FROM w) WHERE p <= greatest(n - 4, 1)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_have JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, a AS other FROM edge UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other),
comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN size ON size.doc_id = d.doc_id LEFT JOIN comp ON comp.doc_id = d.doc_id
"""


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc_index.archive_and_read(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
b AS (SELECT html, max(page_id) AS best FROM p WHERE payload_bytes >= 1000 GROUP BY html)
SELECT page_id, payload_bytes, sha1(p.html) AS payload_digest, CASE WHEN best > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN best > page_id THEN best END AS refers_to
FROM p LEFT JOIN b ON p.html = b.html
"""


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_quality_rules": op4_quality_rules,
        "op5_chat_formatting": op5_chat_formatting,
        "op6_source_mixing": op6_source_mixing,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_token_binary": op8_token_binary,
        "op9_near_dedup": op9_near_dedup,
        "op10_warc_index": op10_warc_index,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op5_chat_formatting": OP5_SQL, "op6_source_mixing": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op9_near_dedup": OP9_SQL, "op10_warc_index": OP10_SQL}
