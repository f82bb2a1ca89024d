"""The operators' queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import encoding, language, licences, near_vectors, neighbours, packing, pii
from assay.llm import sharding, shards, simhash, spelling, substrings, whitening
from assay.llm.common import table
from assay.session import run_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


PII_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
kinds AS (
  SELECT unnest([1, 2, 3, 4, 5, 6]) AS o,
         unnest(['email', 'ip', 'card', 'phone', 'iban', 'secret']) AS kind
),
found AS (
  SELECT r, o, kind, t,
         CASE o WHEN 1 THEN regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')
                WHEN 2 THEN regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)')
                WHEN 3 THEN regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+')
                WHEN 4 THEN regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]')
                WHEN 5 THEN regexp_extract_all(t, '[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?')
                ELSE regexp_extract_all(t, '[A-Za-z0-9_-]{32,}') END AS ms,
         CASE o WHEN 1 THEN string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')
                WHEN 2 THEN string_split_regex(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)')
                WHEN 3 THEN string_split_regex(t, '[0-9]([\x20-]?[0-9])+')
                WHEN 4 THEN string_split_regex(t, '\+[0-9][\x20().0-9-]+[0-9]')
                WHEN 5 THEN string_split_regex(t, '[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?')
                ELSE string_split_regex(t, '[A-Za-z0-9_-]{32,}') END AS gs
  FROM docs, kinds
),
listed AS (
  SELECT r, o, kind, t, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(1, len(ms) + 1)) AS i
  FROM found WHERE len(ms) > 0
),
placed AS (
  SELECT *, CAST(sum(length(g) + length(m)) OVER (PARTITION BY r, o ORDER BY i) AS BIGINT) - length(m) AS s,
         CAST(sum(length(g) + length(m)) OVER (PARTITION BY r, o ORDER BY i) AS BIGINT) AS e,
         regexp_replace(m, '[^0-9]', '', 'g') AS d,
         replace(m, ' ', '') AS p
  FROM listed
),
near AS (SELECT *, lower(substring(t, greatest(s - 40, 0) + 1, least(s, 40))) AS b FROM placed),
spans AS (
  SELECT r, o, kind, s, e FROM near
  WHERE CASE o
    WHEN 1 THEN true
    WHEN 2 THEN NOT list_contains([length(ltrim(x, '0')) > 3 OR (length(ltrim(x, '0')) = 3 AND ltrim(x, '0') > '255')
                                   FOR x IN string_split(m, '.')], true)
    WHEN 3 THEN length(d) BETWEEN 13 AND 19 AND list_sum([
             CASE WHEN (length(d) - j) % 2 = 0 THEN CAST(d[j] AS INT)
                  ELSE CAST(d[j] AS INT) * 2 // 10 + CAST(d[j] AS INT) * 2 % 10 END
             FOR j IN range(1, length(d) + 1)]) % 10 = 0
    WHEN 4 THEN length(d) BETWEEN 9 AND 15
    WHEN 5 THEN length(p) BETWEEN 15 AND 34
           AND NOT regexp_matches(substring(t, s, CASE WHEN s > 0 THEN 1 ELSE 0 END), '[A-Za-z0-9]')
           AND NOT regexp_matches(substring(t, e + 1, 1), '[A-Za-z0-9]')
           AND CAST(array_to_string([CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END
                 FOR c IN string_split(p[5:] || p[1:4], '')], '') AS HUGEINT) % 97 = 1
    ELSE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND length(m) <= 128
         AND regexp_matches(b, 'token|secret|passw|api.?key|access.?key|bearer') END
),
sums AS (
  SELECT r, count(*) FILTER (o = 1) AS n_email, count(*) FILTER (o = 2) AS n_ip,
         count(*) FILTER (o = 3) AS n_card, count(*) FILTER (o = 4) AS n_phone,
         string_agg(kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(e AS VARCHAR), ','
                    ORDER BY o, s) FILTER (o <= 4) AS base,
         string_agg(kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(e AS VARCHAR), ','
                    ORDER BY o, s) AS spans
  FROM spans GROUP BY r
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN sums USING (r)
"""


@query(PII_SQL)
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*[k.name for k in pii.KINDS if k.base]))
    return found.select(
        F.col("key").alias("doc_id"),
        *[count(k.name) for k in pii.KINDS if k.base],
        F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


@query()
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, most=3)
    return found.select(
        F.col("key").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query()
def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that are left without passages of earlier documents."""
    found = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


@query()
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by the tokenization automaton."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = encoding.round_trip(table(spark, sf_dir, "documents"), path)
    return found.withColumnRenamed("key", "doc_id")


@query()
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids packed into sequences of 2048."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = packing.packed(table(spark, sf_dir, "documents"), path, with_ids=False)
    return found.withColumnRenamed("key", "doc_id")


@query()
def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to binary shards and read back through their index."""
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = shards.write_shards(table(spark, sf_dir, "documents"), run_dir(spark, "shards"), path)
    return shards.read_shards(manifest).withColumnRenamed("key", "doc_id")


@query()
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from three quarters of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~language.held_out("doc_id")))
    # the label does not travel with the rows that are predicted
    rows = docs.select("doc_id", "text", language.held_out("doc_id").alias("held_out"))
    return language.predicted(rows, model).select("doc_id", "held_out", "lang_pred", "score")


@query()
def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of embeddings with a cosine of at least 0.95."""
    found = near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.95)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


@query()
def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings of every twentieth one."""
    found = neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
    return found.withColumnRenamed("id", "vec_id")


@query()
def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of all documents that name a licence."""
    docs = table(spark, sf_dir, "documents")
    return licences.scanned(docs, licences.fit(docs)).withColumnRenamed("key", "doc_id")


@query()
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every embedding."""
    vectors = table(spark, sf_dir, "embeddings")
    found = whitening.whitened(vectors, whitening.fit(vectors, components=4), components=4)
    long = F.col("deviation").try_cast("long")
    return found.withColumnRenamed("id", "vec_id").withColumn("deviation", long)


#: Checksums of texts by a table of 256 steps, as SQL has no function for them.
CRC_SQL = """
steps(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8
),
crc AS (SELECT list(v ORDER BY i) AS tab FROM steps WHERE k = 8)"""


def crc_of(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    chain = f"list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))"
    return f"CAST(xor({chain}, 4294967295) AS BIGINT)"


SHARDING_SQL = f"""
WITH RECURSIVE {CRC_SQL},
docs AS (
  SELECT row_number() OVER () AS c, doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 16 AS size,
         CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS a,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS b
  FROM documents
),
spread AS (
  SELECT *, sum(size) OVER () AS total, sum(size) OVER (PARTITION BY a) AS alike, count(*) OVER (PARTITION BY a) AS copies,
         sum(size) OVER (ORDER BY a, b, c ROWS UNBOUNDED PRECEDING) - size AS below
  FROM docs
),
units AS (
  SELECT *, min(below) OVER (PARTITION BY a) AS first, copies = 1 OR alike * 40 <= 0.01 * total AS together FROM spread
),
dealt AS (
  SELECT *, CAST(CASE WHEN together THEN (2 * first + alike) * 40 ELSE (2 * below + size) * 40 END // (2 * total) AS INT) AS shard
  FROM units
)
SELECT doc_id, CAST(size AS BIGINT) AS size, {crc_of("t")} AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY a, b, c) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM dealt, crc
"""


@query(SHARDING_SQL)
def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    docs = table(spark, sf_dir, "documents")
    checksum = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    found = sharding.sharded(docs, 40, keep=["doc_id", checksum])
    return found.select(
        "row.doc_id",
        "size",
        "row.text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


SPELLING_SQL = f"""
WITH RECURSIVE {CRC_SQL},
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k,
         translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
),
kinds AS (SELECT k, run, count(*) AS times FROM runs WHERE length(run) >= 7 GROUP BY k, run),
summed AS (SELECT run, times, {crc_of("k || ':' || run")} AS h FROM kinds, crc),
cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
              ELSE run END AS word, times
  FROM summed
),
vocabulary AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM vocabulary),
gaps AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS gap FROM places),
links AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM gaps x JOIN gaps y ON x.gap = y.gap AND x.p = y.p AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM gaps x JOIN vocabulary y ON x.gap = y.word
  UNION SELECT y.word, x.word, x.n FROM gaps x JOIN vocabulary y ON x.gap = y.word
),
near AS (
  SELECT word, count(*) AS n_near, max(near_n) AS top FROM links GROUP BY word
),
forms AS (
  SELECT v.word, v.n, coalesce(max(n_near), 0) AS n_near,
         min(CASE WHEN near_n = top AND near_n >= 10 * n THEN near END) AS form, max(CASE WHEN top >= 10 * n THEN top END) AS form_n
  FROM vocabulary v LEFT JOIN near ON v.word = near.word LEFT JOIN links ON v.word = links.word GROUP BY v.word, v.n
),
ways AS (
  SELECT word, word AS at, form AS further, 0 AS far FROM forms
  UNION ALL SELECT ways.word, forms.word, forms.form, far + 1 FROM ways JOIN forms ON ways.further = forms.word
)
SELECT forms.word, forms.form, ways.at AS root, n, n_near, form_n
FROM forms JOIN ways ON forms.word = ways.word AND ways.further IS NULL
"""


@query(SPELLING_SQL)
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling.variants(spelling.words(table(spark, sf_dir, "documents")))
