"""The registered query of each corpus operator: production parameters, whole tables, and the columns to compare."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, jaccard, knn, langid, licenses, mixing, phrases, pii, sharding, simhash, warc, whitening
from .common import new_path, table

#: Shards of op5.
SHARDS = 24
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_disclosure_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir), keep_text=False)
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != pii.TERM)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(F.array_join(F.transform(base, one), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", one), ",").alias("spans"),
        count(pii.TERM).alias("n_term"),
    )


def op3_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = audio.features(audio.encode(documents(spark, sf_dir).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))).drop("text"))
    spans = F.array_join(F.transform("segments", lambda s: F.concat(s.start_ms.cast("string"), F.lit("-"), s.end_ms.cast("string"))), ",")
    feature = F.concat_ws(
        ";", F.col("n_frames").cast("string"), F.round("mean_log_mel", 4).cast("string"), F.size("segments").cast("string"),
        F.sha2(spans.cast("binary"), 256), F.sha2("tensors", 256),
    )
    return made.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    found = bpe.encode(documents(spark, sf_dir), path, decoded=True)
    return found.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.coalesce("text", F.lit("")).cast("binary")
    sized = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(data).cast("long") + 8).alias("size"), F.crc32(data).alias("text_crc32")
    )
    return sharding.shard_by_bytes(sized, SHARDS, keys=["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op7_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("payload")), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_block_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    return mixing.taken(docs)


def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("text")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows)
    if model is None or not len(model.values):
        nothing = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], nothing)
    explained = F.element_at(F.array(*[F.lit(x).cast("double") for x in model.explained]), F.col("component"))
    return (
        whitening.whiten(rows, model)
        .select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
        .select("vec_id", (F.col("place") + 1).alias("component"), "deviation", "whitened")
        .select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))
    )


def op12_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_classes(documents(spark, sf_dir))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def _crc32_step(low: int) -> int:
    """What four shifts of a reflected CRC-32 make of its low four bits."""
    for _ in range(4):
        low = low >> 1 ^ (0xEDB88320 if low & 1 else 0)
    return low


# The checksum takes the hex digits of a text one by one, the low digit of each byte first.
OP5_SQL = f"""
WITH h AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes FROM documents
), n AS (
  SELECT doc_id, size, list_transform(flatten(list_transform(bytes, lambda b: [b[2], b[1]])), lambda x: CAST(strpos('123456789ABCDEF', x) AS BIGINT)) AS digits FROM h
), c AS (
  SELECT doc_id, size, CASE WHEN len(digits) = 0 THEN 0 ELSE xor(list_reduce(digits, lambda c, x:
    xor(c >> 4, CAST({[_crc32_step(i) for i in range(16)]} AS BIGINT[])[(xor(c, x) & 15) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) END AS text_crc32 FROM n
), p AS (
  SELECT *, row_number() OVER w AS place, CAST(sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) - size + size // 2 AS middle, CAST(sum(size) OVER () AS BIGINT) AS total
  FROM c WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size)
), s AS (SELECT *, CAST(least({SHARDS - 1}, middle * {SHARDS} // total) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""

OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS f FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.f, c.f) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""

OP8_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + (CAST('0x' || substr(h, CAST(5 * i + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * j AS INT)) % 32, 1)), '')), '') AS payload_digest
  FROM p
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""

#: ASCII letters in lower case, as DuckDB writes it; white space as the contracts have it.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12_SQL = f"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT id, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS shingles FROM t
), one AS (SELECT id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
links AS (
  SELECT a.id AS a, b.id AS b FROM one a JOIN one b ON a.shingle = b.shingle AND a.id <> b.id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, least(s.doc_id, min(o.doc_id)) AS component_id
FROM s LEFT JOIN reach ON reach.a = s.id LEFT JOIN s o ON o.id = reach.b GROUP BY s.id, s.doc_id, s.shingles
"""

OP13_SQL = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), q AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p
), x AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM q
), g AS (SELECT lang, w[i] AS w1, CASE WHEN i < len(w) THEN w[i + 1] END AS w2, CASE WHEN i + 1 < len(w) THEN w[i + 2] END AS w3 FROM x
), n AS (SELECT lang, count(*) AS n FROM g GROUP BY lang
), f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY lang, w1
), f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY lang, w1, w2
), f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 10
), inside AS (
  SELECT lang, a, b, max(f) AS longer FROM (SELECT lang, w1 AS a, w2 AS b, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY lang, a, b
), cut AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, 1 AS k, a.f AS l, b.f AS r FROM f2 t
  JOIN f1 a ON a.lang = t.lang AND a.w1 = t.w1 JOIN f1 b ON b.lang = t.lang AND b.w1 = t.w2
  LEFT JOIN inside i ON i.lang = t.lang AND i.a = t.w1 AND i.b = t.w2 WHERE t.f >= 10 AND (i.longer IS NULL OR 100 * i.longer < 50 * t.f)
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, a.f, b.f FROM f3 t
  JOIN f1 a ON a.lang = t.lang AND a.w1 = t.w1 JOIN f2 b ON b.lang = t.lang AND b.w1 = t.w2 AND b.w2 = t.w3
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, a.f, b.f FROM f3 t
  JOIN f2 a ON a.lang = t.lang AND a.w1 = t.w1 AND a.w2 = t.w2 JOIN f1 b ON b.lang = t.lang AND b.w1 = t.w3
), s AS (SELECT *, CAST((1000000 * CAST(a AS HUGEINT) * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cut
), c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c QUALIFY rank <= 2000)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_bktree": op1_simhash_bktree,
    "op2_disclosure_spans": op2_disclosure_spans,
    "op3_audio_features": op3_audio_features,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_prefix_sum_shards": op5_prefix_sum_shards,
    "op6_voronoi_knn": op6_voronoi_knn,
    "op7_byte_cnn_language": op7_byte_cnn_language,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_block_mixture": op9_block_mixture,
    "op10_license_rules": op10_license_rules,
    "op11_whitening": op11_whitening,
    "op12_signature_trees": op12_signature_trees,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {"op5_prefix_sum_shards": OP5_SQL, "op6_voronoi_knn": OP6_SQL, "op8_warc_revisits": OP8_SQL, "op12_signature_trees": OP12_SQL, "op13_collocations": OP13_SQL}
