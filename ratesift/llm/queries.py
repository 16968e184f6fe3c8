"""One query per corpus operator over its whole table; SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratesift.llm.columns import table, values
from ratesift.llm.decontamination import contaminated
from ratesift.llm.jaccard_join import jaccard_components
from ratesift.llm.line_dedup import drop_common_lines
from ratesift.llm.packing import pack
from ratesift.llm.passage_dedup import repeated_passages
from ratesift.llm.periodic_runs import periodic_runs
from ratesift.llm.piecewise_hash import fingerprints
from ratesift.llm.pseudonyms import pseudonymise
from ratesift.llm.ring_sharding import shard_rows
from ratesift.llm.sentencepiece_codec import encode_documents
from ratesift.llm.token_alignment import align_tokens
from ratesift.llm.toxicity import toxicity
from ratesift.llm.url_rules import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def corpus_query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


@corpus_query("op1_sentencepiece")
def sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    coded = encode_documents(table(spark, folder, "documents"))
    return coded.select("doc_id", "n_chars", "n_ids", "ids", "round_trip", F.sha2("decoded", 256).alias("decoded_sha256"))


@corpus_query("op2_decontamination")
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@corpus_query("op3_piecewise_hash")
def piecewise_hash(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(table(spark, folder, "documents"))


@corpus_query("op4_ring_sharding")
def ring_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_rows(table(spark, folder, "documents"), shards=8)


@corpus_query("op5_line_dedup", """
WITH l AS (SELECT rowid AS r, i, lines[i] AS line, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT rowid, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT row_number() OVER () AS rowid, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
common AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
kept AS (SELECT r, count(*) AS n, count(*) FILTER (common.k IS NOT NULL) AS d,
        coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (common.k IS NULL), '') AS t
    FROM l LEFT JOIN common ON l.k = common.k GROUP BY r)
SELECT doc_id, n AS n_lines, d AS n_dropped, sha256(t) AS kept_sha256
FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) JOIN kept USING (r)""")
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    lines = drop_common_lines(table(spark, folder, "documents"), min_docs=10)
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


#: The query's key; a real one is secret and comes from the caller.
PSEUDONYM_KEY = "corpus queries"


@corpus_query("op6_pseudonyms")
def pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, personal values with pseudonyms in their place."""
    changed = pseudonymise(table(spark, folder, "documents"), PSEUDONYM_KEY)
    return changed.select("doc_id", "n_replaced", F.array_join(F.array_sort("kinds"), ",").alias("kinds"), "text")


@corpus_query("op7_passage_dedup")
def passage_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_passages(table(spark, folder, "documents"))


@corpus_query("op8_toxicity")
def toxic_scores(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@corpus_query("op9_jaccard_join", r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b USING (g) WHERE a.doc_id < b.doc_id
        AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
        GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
l AS (SELECT a, b FROM i UNION ALL SELECT b, a FROM i),
r AS (SELECT DISTINCT a AS id, a AS reached FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.reached = l.a)
SELECT doc_id, len(s) AS n_shingles, coalesce(c, doc_id) AS component_id
FROM s LEFT JOIN (SELECT id, min(reached) AS c FROM r GROUP BY id) ON doc_id = id""")
def jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"))


#: Hosts, path prefixes and verdicts of the rules.
URL_RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
]


@corpus_query("op10_url_rules", """
WITH r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
    ('org', '/fr/', 'allow')) AS t(rule_host, rule_path, verdict)),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS raw FROM u),
p AS (SELECT row_number() OVER () AS i, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) AS path FROM h),
f AS (SELECT i, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(verdict, length(rule_host || rule_path)) AS verdict
    FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (i)""")
def url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"), values(spark, URL_RULES, "host, path, verdict"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """Documents with the query's repeats: where crc32(doc_id) ends in 0, the words from place a on repeat the first p of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    n = F.size("words")
    a = F.col("g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("g") % 8)).cast("long")
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    repeated = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), n - F.col("a")))
    picked = docs.select("doc_id", "text", g.alias("g"), F.coalesce(h % 10 == 0, F.lit(False)).alias("picked"))
    split = picked.withColumn("words", F.when(F.col("picked"), words))
    placed = split.withColumn("a", F.when(n > 0, a).cast("int")).withColumn("p", F.when(n > 0, p).cast("int"))
    return placed.select("doc_id", F.when(F.col("p") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


@corpus_query("op11_periodic_runs")
def periodic(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(with_repeats(table(spark, folder, "documents")), min_length=24, min_periods=3)
    # the greatest length/period; equal ones by start, then period, which is the order of the runs
    best = F.aggregate("runs", F.get("runs", 0), lambda x, y: F.when(y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


@corpus_query("op12_token_alignment")
def token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align_tokens(table(spark, folder, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")


@corpus_query("op13_harmonic_packing")
def harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack(table(spark, folder, "documents"), capacity=2048, end_id=1)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
