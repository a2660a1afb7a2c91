"""Queries of the training-data operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import brown, exact, lexical, licenses, mixing, near, order_minhash, packing, pii, quality, resample, sharding, token_files
from inkwell.llm._tables import read


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents")).drop("lang", "source")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(read(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_classes(read(spark, sf_dir, "documents")).drop("text_hash")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read(spark, sf_dir, "documents")).drop("text_hash")


def op6_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_documents(read(spark, sf_dir, "documents")).drop("class_tokens")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_documents(read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("text_hash")


def op10_pii(spark: SparkSession, sf_dir: str, key: str = "inkwell demonstration key") -> DataFrame:
    return pii.pseudonymise(read(spark, sf_dir, "documents"), key).select("doc_id", "kinds", "text")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.written_and_read(read(spark, sf_dir, "documents"), tokenizer_path())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_hilbert, op3_licenses, op4_near_dedup, op5_exact_dedup, op6_brown, op7_order_minhash, op8_packing, op9_quality, op10_pii, op11_lexical, op12_resample, op13_token_files, pipeline)}


OP5_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS r, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d),
k AS (SELECT text_sha256, doc_id AS keep_id FROM g WHERE r = 1)
SELECT g.doc_id, k.keep_id, g.group_size, g.r = 1 AS kept, g.text_sha256 FROM g JOIN k USING (text_sha256)
"""


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
q AS (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
k AS (SELECT i, item_id, w, count(*) AS times FROM q GROUP BY ALL),
s AS (SELECT count(*) FILTER (len(words) > 0) AS n, sum(len(words))::BIGINT AS l FROM d),
p AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(words) AS w FROM d) WHERE w IN (SELECT w FROM k) GROUP BY r, w),
f AS (SELECT w, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY w, s.n),
v AS (SELECT p.r, d.doc_id, p.w, f.weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(d.words) * s.n) // s.l))) AS worth FROM p JOIN d USING (r) JOIN f USING (w), s),
t AS (SELECT i, item_id, r, doc_id, sum(times * worth)::BIGINT AS score FROM k JOIN v USING (w) GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM t WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""

#: crc32 by its table of 256 entries; each distinct word is hashed once.
OP12_SQL = r"""
WITH t AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) r(i)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
q AS (SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
dw AS (SELECT r, unnest(words) AS w FROM d),
qw AS (SELECT unnest(words) AS w FROM q),
v AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM qw)),
h AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(w)), lambda k: ('0x' || substr(hex(encode(w)), 2 * k + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t.crc[(xor(c, b) & 255) + 1]))) % 10000 AS b FROM v, t),
s AS (SELECT b, count(*) AS n FROM dw JOIN h USING (w) GROUP BY b),
g AS (SELECT b, count(*) AS n FROM qw JOIN h USING (w) GROUP BY b),
total AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS s, coalesce((SELECT sum(n) FROM g), 0)::DOUBLE AS t),
gain AS (SELECT i.b, floor(1000 * ln((coalesce(g.n, 0) + 1)::DOUBLE * (total.s + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * (total.t + 10000))))::BIGINT AS gain
         FROM range(10000) i(b) LEFT JOIN s USING (b) LEFT JOIN g USING (b), total),
f AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS total FROM dw JOIN h USING (w) JOIN gain USING (b) GROUP BY r),
x AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(CASE WHEN total < 0 THEN -((-total + n - 1) // n) ELSE total // n END, 0) AS weight,
             ('0x' || substr(sha256('2024:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN f USING (r)),
y AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM y)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score, CASE WHEN n_features >= 20 AND place <= (10 * n) // 100 THEN place END AS rank FROM z
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op11_lexical": OP11_SQL, "op12_resample": OP12_SQL}
