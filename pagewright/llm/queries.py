"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import decontamination, embedding_dedup, licences, minhash_dedup, mixing, passages, quality, spelling, spotsigs, token_output, toxicity, warc, whitening
from pagewright.llm.common import Scratch, read


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), max_repeats=2.0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(read(spark, sf_dir, "embeddings"), threshold=0.95)


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.mark(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    warc.write_warc(read(spark, sf_dir, "pages"), scratch.path("archives"))
    records = scratch.table("records", warc.summarise(warc.read_warc(spark, scratch.path("archives"))))
    captures = scratch.table("captures", warc.assemble(records).withColumn("page_id", warc.page_id(F.col("metadata"))))
    first = captures.filter("type = 'response'").groupBy(F.col("record_id").alias("_to")).agg(F.min("page_id").alias("first_page"))
    joined = captures.withColumn("_to", F.coalesce("refers_to", "record_id")).join(first, "_to", "left")
    revisit = F.when(F.col("type") == "revisit", F.col("first_page"))
    return joined.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), revisit.alias("refers_to"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Scratch(spark, "tokens").path("shards")
    token_output.write_tokens(read(spark, sf_dir, "documents"), out, tokenizer_path())
    return token_output.read_documents(spark, out)


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(read(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"), components=16, scale=64.0, shift=1_000_000)


def op12_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_edited(read(spark, sf_dir, "documents"))


def dropped_letters(doc_id: int | None):
    """What changes a document's runs: one in 199, by a hash of the id and the run, loses the letter that the hash names."""
    seed = zlib.crc32(f"{doc_id}:".encode())

    def change(word: str) -> str:
        h = zlib.crc32(word.encode(), seed)
        if h % 199:
            return word
        at = h % len(word)
        return word[:at] + word[at + 1 :]

    return change


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spelling.word_counts(read(spark, sf_dir, "documents"), min_length=6, min_count=5, edit=dropped_letters)
    return spelling.variants(counts, min_length=6, ratio=5)


def queries() -> dict:
    return {f.__name__: f for f in (op1_mixing, op2_quality, op3_embeddings, op4_licences, op5_toxicity, op6_warc, op7_decontamination, op8_tokens, op9_passages, op10_minhash, op11_whitening, op12_spotsigs, op13_spelling)}


SQL_WARC = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_page THEN first_page END AS refers_to
FROM (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
             min(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS first_page
      FROM pages)
"""


# A CRC is worked out bit by bit: a byte is mixed in, then eight shifts follow. Letters are ASCII or two bytes beginning with 195.
SQL_SPELLING = """
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zà-ÿÀ-ß]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
crcs AS (
  SELECT doc_id, run, n,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
           flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)),
           lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END)) AS h
  FROM runs),
words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM crcs)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
shorter AS (SELECT DISTINCT c.word, c.n, w.word AS other, w.n AS other_n FROM cut c JOIN words w ON w.word = c.rest),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT word, other, other_n FROM shorter
  UNION ALL SELECT other, word, n FROM shorter),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word),
named AS (SELECT b.word, b.n_near, b.top, min(e.other) AS other FROM best b JOIN near e ON e.word = b.word AND e.other_n = b.top GROUP BY ALL),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.top >= 5 * w.n THEN b.other END AS form, CASE WHEN b.top >= 5 * w.n THEN b.top END AS form_n
  FROM words w LEFT JOIN named b USING (word)),
paths AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT p.word, f.form FROM paths p JOIN formed f ON f.word = p.root WHERE f.form IS NOT NULL),
roots AS (SELECT p.word, p.root FROM paths p JOIN formed f ON f.word = p.root WHERE f.form IS NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN roots r USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": SQL_WARC, "op13_spelling": SQL_SPELLING}
