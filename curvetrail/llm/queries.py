"""The registered queries of this subpackage, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvetrail.llm import bpe, conversations, decontam, jpeg, langid, mixing, neardup, repeats, secrets, toxicity, urlfilter, vectorcodes, warc
from curvetrail.llm.common import fold_of, materialize, read_table

#: Rules of the URL query, as given: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    history = warc.capture_history(pages)
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


OP1_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, url, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS kept FROM p),
n AS (SELECT page_id, i, (('0x' || substr(hex, 5*i + 1, 5))::BIGINT >> s) & 31 AS v, s FROM d, (VALUES (0),(1),(2),(3),(4),(5),(6),(7)) a(i), (VALUES (15),(10),(5),(0)) b(s)),
b AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v::INT + 1, 1), '' ORDER BY i, s DESC) AS payload_digest FROM n GROUP BY page_id),
h AS (SELECT page_id, lower(regexp_extract(regexp_extract(url, '://(.*)$', 1), '^([^/?#:]*)', 1)) AS host, regexp_extract(regexp_extract(url, '://(.*)$', 1), '^[^/?#:]*(.*)$', 1) AS tail FROM p)
SELECT d.page_id, payload_bytes, payload_digest, CASE WHEN kept = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN kept = d.page_id THEN NULL ELSE kept END AS refers_to, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || tail AS url_key,
  strftime(make_timestamp((1700000000 + ((d.page_id % 1000000000) + 1000000000) % 1000000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM d JOIN b USING (page_id) JOIN h USING (page_id)
"""


def op2_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH p AS (SELECT page_id,
  CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1) ELSE '' END AS raw_host,
  CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
h AS (SELECT page_id, path, coalesce(translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host FROM p),
r(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT h.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS rn
  FROM h LEFT JOIN r ON (h.host = r.rhost OR ends_with(h.host, '.' || r.rhost)) AND starts_with(h.path, r.rpath))
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(rverdict, 'allow') AS verdict FROM m WHERE rn = 1
"""


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.find_secrets(docs).select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op4_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    features = jpeg.media_features(materialize(jpeg.store_media(docs), "media", **jpeg.SMALL_GROUPS))
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height"), F.col("frames").cast("string"), "thumb_hash")
    return features.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.find_repeats(docs).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Each 100-byte string by its digest, each byte by the last later occurrence that reaches it. Texts are cut into stretches
#: first, as a substring of a long text takes time with its place.
OP5_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT doc_id, len(h) // 2 AS n, base, substr(h, 2 * base + 1, 1200) AS part FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2, 500)) AS base FROM d)),
b AS MATERIALIZED (SELECT doc_id, base + i AS p, substr(part, 2 * i + 1, 2) AS x, CASE WHEN n - base - i >= 100 THEN md5_number(substr(part, 2 * i + 1, 200)) END AS s FROM (SELECT *, unnest(range(least(500, n - base))) AS i FROM q)),
f AS (SELECT s, min((doc_id::HUGEINT << 40) + p) AS least FROM b WHERE s IS NOT NULL GROUP BY s HAVING count(*) > 1),
c AS (SELECT b.doc_id, b.p, b.x, max(CASE WHEN (b.doc_id::HUGEINT << 40) + b.p > f.least THEN b.p END) OVER (PARTITION BY b.doc_id ORDER BY b.p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM b LEFT JOIN f ON f.s = b.s),
g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), FALSE) AS starts FROM c),
k AS (SELECT doc_id, count_if(gone) AS removed, count_if(starts) AS spans, string_agg(x, '' ORDER BY p) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_leaks(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.withColumnRenamed("id", "doc_id")


#: Domains of the labels table, and the share of tokens that each is to have.
MIX_TARGETS = {"clean": 0.9, "junk": 0.09, "toxic": 0.01}


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain: toxic, else junk (quality 0), else clean; rows with a null label have none."""
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", kind.alias("domain"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.mix(docs, docs, label_domains(read_table(spark, sf_dir, "labels")), MIX_TARGETS).drop("text")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.similar_texts(docs).withColumnRenamed("id", "doc_id")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold_of(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.where(~held))
    return langid.predict(docs, model, extra=held).withColumnRenamed("id", "doc_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held = fold_of(F.col("doc_id"), 3) == 1
    model = toxicity.fit(docs.where(~held), labels.where(~held))
    scored = toxicity.score(docs, model, extra=held).withColumnRenamed("id", "doc_id")
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op11_vectorcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return vectorcodes.compress(rows, parts=16, entries=64, rounds=2, scale=256).withColumnRenamed("id", "vec_id")


def _op11_sql() -> str:
    """One assignment and one update of the entries for each round."""
    near = """a{n} AS MATERIALIZED (SELECT vec_id, label, part, u, least % 64 AS e, least // 64 AS d FROM (
  SELECT vec_id, any_value(label) AS label, p.part, any_value(u) AS u, min(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(u, c)])::BIGINT * 64 + e) AS least
  FROM p JOIN c{n} c ON c.part = p.part GROUP BY vec_id, p.part)),
"""
    move = """s{n} AS (SELECT part, e, i, sum(u[i + 1])::BIGINT AS s, count(*) AS n FROM a{n}, range(4) r(i) GROUP BY part, e, i),
m{n} AS (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{n} GROUP BY part, e),
c{k} AS MATERIALIZED (SELECT c{n}.part, c{n}.e, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} ON m{n}.part = c{n}.part AND m{n}.e = c{n}.e),
"""
    return (
        """WITH k AS MATERIALIZED (SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, v[part * 4 + 1 : part * 4 + 4] AS u FROM k, range(16) r(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, u AS c FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64)),
"""
        + near.format(n=0) + move.format(n=0, k=1) + near.format(n=1) + move.format(n=1, k=2) + near.format(n=2)
        + """h AS (SELECT sha256(string_agg(c[i + 1]::VARCHAR, ',' ORDER BY part, e, i)) AS codebooks_sha256 FROM c2, range(4) r(i)),
o AS (SELECT vec_id, any_value(label) AS label, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o, h"""
    )


OP11_SQL = _op11_sql()


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.repair(conversations.damaged(rows))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.decode(bpe.encode(docs, tokens, public_tokenizers.PATTERN), tokens)
    spaced = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(spaced, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_urlfilter": op2_urlfilter,
    "op3_secrets": op3_secrets,
    "op4_jpeg": op4_jpeg,
    "op5_repeats": op5_repeats,
    "op6_decontam": op6_decontam,
    "op7_mixing": op7_mixing,
    "op8_ngram_join": op8_ngram_join,
    "op9_langid": op9_langid,
    "op10_toxicity": op10_toxicity,
    "op11_vectorcodes": op11_vectorcodes,
    "op12_conversations": op12_conversations,
    "op13_bpe": op13_bpe,
}

ORACLES = {"op1_warc": OP1_SQL, "op2_urlfilter": OP2_SQL, "op5_repeats": OP5_SQL, "op11_vectorcodes": OP11_SQL}
