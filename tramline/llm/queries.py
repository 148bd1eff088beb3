"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, language, media, negatives, packing, resampling, secrets, sentencepieces, simhash, spans, substrings, toxicity, urls

#: The rules of the url query.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: The list of the url query: hosts (and all below them) that the filter blocks.
BLOCKED = tuple(f"{name}.example.{end}/" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(mod: int, id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(mod))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded, then decoded."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    out = sentencepieces.round_trip(table(spark, sf_dir, "documents"), model)
    return out.select("doc_id", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, then by the list."""
    return urls.judge(table(spark, sf_dir, "pages"), RULES, BLOCKED).drop("listed")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's fingerprint, its edited text's, and how near they and the next document's are."""
    rows = fingerprints.with_next(table(spark, sf_dir, "documents")).withColumn("edited", fingerprints.half_replaced(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_vector", fingerprints.vector(F.col("edited")))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.text_of(F.col("vector")).alias("fingerprint"), fingerprints.text_of(F.col("edited_vector")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"), fingerprints.likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as WAV, read back, with its spectral fingerprint."""
    out = media.features(media.to_media(table(spark, sf_dir, "documents")))
    digest = F.sha2(F.concat_ws(";", F.array_join("times", ","), F.array_join("hashes", ",")), 256)
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("times").cast("string"), digest).alias("feature"), F.col("times").alias("peak_times"), F.col("hashes").alias("peak_hashes"),
    )


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's language, learned from documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(docs.where(fold(4) != 2)))
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the words that windows of 20 words repeat."""
    return spans.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's score, learned from labels outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.where((fold(3) != 1) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    found = toxicity.score(docs, toxicity.fit(docs, known))
    return found.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's fingerprint and component."""
    found = simhash.linked(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's secrets: base patterns, and what the network adds."""
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fit(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    shown = lambda own: F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = shown(F.filter("spans", lambda s: s["kind"] != "net"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's weight towards the benchmark's texts, and the draw of five in a hundred."""
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the bytes that repeated strings of 200 bytes cover."""
    return substrings.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; every seventh vector's label is moved on first."""
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(rows, F.col("id") % 50 == 0)


def queries():
    made = (op1_sentencepiece, op2_url_filter, op3_fingerprints, op4_media, op5_language, op6_packing, op7_substring_dedup, op8_toxicity, op9_simhash, op10_secrets, op11_resampling, op12_substrings, op13_negatives)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{k}', '{v}')" for k, v in RULES.items())
    blocked = ", ".join(f"('{k}')" for k in BLOCKED)
    fits = "('.' || host) LIKE ('%.' || split_part(key, '/', 1)) AND starts_with(path, substr(key, strpos(key, '/')))"
    return {
        "op2_url_filter": rf"""
WITH u AS (
  SELECT page_id, row_number() OVER () AS n,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
r(key, verdict) AS (VALUES {rules}),
b(key) AS (VALUES {blocked}),
fit AS (SELECT n, arg_max(key, length(key)) AS rule, arg_max(verdict, length(key)) AS verdict FROM u JOIN r ON {fits} GROUP BY n),
hit AS (SELECT DISTINCT n FROM u JOIN b ON {fits})
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN hit.n IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fit USING (n) LEFT JOIN hit USING (n)""",
        "op7_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS h FROM s),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM h) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM rep),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
        "op12_substrings": r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT n, unnest(range(0, length(x) // 2 - 199, 500)) AS c, x FROM d),
y AS (SELECT n, c, substr(x, 2 * c + 1, 1398) AS y FROM c),
s AS (SELECT n, c, y, unnest(range(0, length(y) // 2 - 199)) AS i FROM y),
h AS (SELECT n, c + i AS i, md5_number(substr(y, 2 * i + 1, 400)) AS h FROM s),
again AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
rep AS (SELECT n, i, lag(i) OVER (PARTITION BY n ORDER BY i) AS before FROM h SEMI JOIN again USING (h)),
led AS (SELECT n, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY n ORDER BY i) AS g FROM rep),
runs AS (SELECT n, min(i) AS a, max(i) + 200 AS b FROM led GROUP BY n, g),
gaps AS (SELECT n, a, b, coalesce(lag(b) OVER w, 0) AS c FROM runs WINDOW w AS (PARTITION BY n ORDER BY a)),
cut AS (SELECT n, sum(b - a) AS gone, count(*) AS k, max(b) AS last, string_agg(substr(x, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS head FROM gaps JOIN d USING (n) GROUP BY n)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(k, 0) AS n_spans, sha256(unhex(CASE WHEN cut.n IS NULL THEN x ELSE head || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (n)""",
        "op13_negatives": """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM pos JOIN p USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3""",
        "op11_resampling": r"""
WITH tab AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
d AS (SELECT 0 AS kind, doc_id, row_number() OVER () AS n, text FROM documents UNION ALL SELECT 1, item_id, -row_number() OVER (), text FROM benchmark),
w AS (SELECT kind, doc_id, n, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
u AS (SELECT n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
f AS (
  SELECT n, unnest([x, x || ' ' || lead(x) OVER o, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o]) AS g FROM u WINDOW o AS (PARTITION BY n ORDER BY i)),
g AS (SELECT n, g, count(*) AS k FROM f WHERE g IS NOT NULL GROUP BY n, g),
b AS (
  SELECT g, xor(list_reduce(list_transform(range(0, octet_length(encode(g))), lambda i: ('0x' || substr(hex(encode(g)), 2 * i + 1, 2))::BIGINT), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) % 10000 AS b
  FROM (SELECT DISTINCT g FROM g), tab),
h AS (SELECT n, b, sum(k) AS k FROM g JOIN b USING (g) GROUP BY n, b),
c AS (SELECT b, coalesce(sum(k) FILTER (n > 0), 0)::DOUBLE AS s, coalesce(sum(k) FILTER (n < 0), 0)::DOUBLE AS t FROM h GROUP BY b),
r AS (SELECT b, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM c) + 10000) / ((s + 1) * ((SELECT sum(t) FROM c) + 10000)))) AS gain FROM c),
e AS (SELECT n, sum(k)::BIGINT AS n_features, sum(k * gain)::BIGINT AS weight FROM h JOIN r USING (b) GROUP BY n),
z AS (
  SELECT doc_id, n, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN e USING (n) WHERE kind = 0),
o AS (SELECT n, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * (SELECT count(*) FROM o) // 100 THEN rank END AS rank
FROM z LEFT JOIN o USING (n)""",
    }
