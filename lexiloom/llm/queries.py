"""The registered queries of the operators, each with the SQL that gives the same rows where SQL can."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import bpe, decontaminate, extraction, line_rules, phrases, ppm, simhash, token_files, toxicity, urls, warc, weak_labels, whitening

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def hex_of_list(c: str):
    """Lowercase SHA-256 of the entries joined by commas."""
    return F.sha2(F.concat_ws(",", F.col(c).cast("array<string>")), 256)


WORD_SQL = r"[^\x20\x09-\x0D]+"
LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: fixed values: (verdict, host, path)
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)


@query(
    f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {_RULES_SQL}),
parts AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
best AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
         FROM urls JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN best USING (page_id)
"""
)
def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return urls.filter_urls(pages, urls.rule_table(spark, URL_RULES)).drop("url")


@query(
    rf"""
WITH i AS (SELECT item_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
iw AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, k, n, item_id FROM dw JOIN iw USING (n, win)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
          FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)
"""
)
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.find_benchmark(docs, table(spark, folder, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        hex_of_list("items").alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query()
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@query()
def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    codec = bpe.Codec(spark, bpe.load_ranks(public_tokenizers.path(VOCABULARY)))
    docs = table(spark, folder, "documents").select("doc_id", codec.round_trip("text").alias("r")).select("doc_id", "r.*")
    return docs.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        hex_of_list("ids").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(
    rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD_SQL}') AS w FROM documents),
lines AS (SELECT doc_id, source, t, line, {LOWER_SQL.replace("text", "line", 1)} AS low FROM
          (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD_SQL}')),
normal AS (SELECT doc_id, source, t, line, array_to_string(regexp_extract_all(low, '{WORD_SQL}'), ' ') AS norm,
                  len(regexp_extract_all(low, '{WORD_SQL}')) AS n FROM lines),
hosts AS (SELECT source, count(DISTINCT doc_id) AS docs FROM d GROUP BY source),
frequent AS (SELECT source, norm FROM normal JOIN hosts USING (source) GROUP BY source, norm
             HAVING count(DISTINCT doc_id) >= 10 AND (count(DISTINCT doc_id) > any_value(docs) * 0.02::DOUBLE OR count(DISTINCT doc_id) > 500)),
lost AS (SELECT doc_id, sum(n) AS lost FROM normal JOIN frequent USING (source, norm) GROUP BY doc_id),
again AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM normal GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
             coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_words
      FROM d LEFT JOIN again USING (doc_id) LEFT JOIN cover USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       n_words >= 10 AND 100 * n_repeat_words <= 20 * n_words AND lost_words <= n_words * 0.5::DOUBLE AND n_words - lost_words >= 10 AS kept FROM c
"""
)
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return line_rules.line_rules(docs, host="source").select("doc_id", *line_rules.COUNTS, "base_failed", "kept", "lost_words")


@query()
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return toxicity.score_texts(docs, table(spark, folder, "labels")).select("doc_id", "held_out", "score", "predicted")


@query()
def op10_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return ppm.score_texts(docs).drop("text")


@query()
def op7_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract(table(spark, folder, "pages")).drop("html")


END_OF_DOCUMENT = 50256


@query()
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    codec = bpe.Codec(spark, bpe.load_ranks(public_tokenizers.path(VOCABULARY)))
    blocks = token_files.write_texts(table(spark, folder, "documents"), "doc_id", "text", codec, END_OF_DOCUMENT)
    return token_files.named_counts(blocks, END_OF_DOCUMENT).select("doc_id", "n_tokens")


@query()
def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return weak_labels.score_quality(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


@query()
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows = whitening.whiten(table(spark, folder, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").cast("bigint"))


@query(
    rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({LOWER_SQL}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
g AS (SELECT lang, unnest(flatten([[w[i:i + k] FOR i IN range(1, len(w) - k + 1)] FOR k IN range(5)])) AS g FROM p),
f AS (SELECT lang, g, len(g) AS k, count(*) AS f FROM g GROUP BY lang, g HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
c AS (SELECT lang, g, f AS a, n FROM f JOIN n USING (lang) WHERE k > 1),
i AS (SELECT lang, s AS g, max(a) AS inside
      FROM (SELECT lang, a, unnest(flatten([[g[i:i + k] FOR i IN range(1, len(g) - k + 1)] FOR k IN range(1, len(g) - 1)])) AS s FROM c) GROUP BY lang, s),
kept AS (SELECT c.* FROM c LEFT JOIN i USING (lang, g) WHERE inside IS NULL OR 100 * inside < 100 * a),
cut AS (SELECT lang, g, a, n, unnest(range(1, len(g))) AS k FROM kept),
s AS (SELECT cut.lang, cut.g, a, n, cut.k, x.f AS l, y.f AS r, (1000::HUGEINT * a * n // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM cut JOIN f x ON x.lang = cut.lang AND x.g = cut.g[1:cut.k] JOIN f y ON y.lang = cut.lang AND y.g = cut.g[cut.k + 1:]),
low AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, n, l, r, score FROM s
        QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM low
QUALIFY rank <= 2000
"""
)
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


#: base 32 of a SHA-1: five hex digits are four digits
_BASE32_SQL = "array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> s) % 32 + 1, 1) FOR s IN [15, 10, 5, 0]], '')"


@query(
    f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT t, sha1(t) AS h, max(page_id) AS best FROM p GROUP BY t),
b AS (SELECT t, h, best, [('0x' || substr(h, 5 * i + 1, 5))::BIGINT FOR i IN range(8)] AS vs FROM d),
c AS (SELECT t, best, array_to_string([{_BASE32_SQL} FOR v IN vs], '') AS digest FROM b)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < best THEN best END AS refers_to
FROM p JOIN c USING (t)
"""
)
def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.archive_pages(table(spark, folder, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
