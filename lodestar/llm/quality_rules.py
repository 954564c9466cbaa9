"""Host-level quality rules (native: DataFrame functions only).

Rule failures are counted per document, summed by host, shrunk with an empirical
beta prior fitted to all hosts, and the verdict on each host is joined back.

Defined cases: a null or empty text has no words and fails; a null host has no
verdict, so its documents stand on their own; repeated rows count once each;
an empty table gives an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import cut, let, words

WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(tokens: Column, n: Column) -> Column:
    """Words inside 8-word windows whose hash occurs twice or more in the text.

    Windows are compared by 64-bit hashes of 64-bit word hashes, within one text only.
    """

    def covered(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda x, k, d: F.get(s, k + d)["h"].eqNullSafe(x["h"])
            repeated = F.filter(s, lambda x, k: ((k > 0) & same(x, k, -1)) | ((k < last) & same(x, k, 1)))
            starts = F.array_sort(F.transform(repeated, lambda x: x["i"]))
            start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n"))
            step = lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"))
            return F.aggregate(starts, start, step, lambda a: a["n"])

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(ordered, twice))

    def windows(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), n - WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.when(n < WINDOW, F.lit(0)).otherwise(let(hashes, lambda h: let(windows(h), covered)))


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row a document: id, host and the five counts the rules rest on."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def measure(w: Column) -> Column:
        n = F.size(w)
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w, n).cast("long").alias("n_repeat_words"),
        )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), let(words(F.col(text_col)), measure).alias("m"))
    return rows.select("doc_id", "host", *[F.col(f"m.{c}").alias(c) for c in COUNTS])


def host_verdicts(counts: DataFrame, reject_rate: float = 0.7, symbol_share: float = 0.25, line_share: float = 0.5) -> DataFrame:
    """Per host: documents, failures, shrunk failure rate and whether the host is rejected.

    The prior is a beta distribution with the mean and variance of the hosts' own
    rates, less the variance that sampling alone explains. Only five sums reach the driver.
    """
    failed = F.col("base_failed") | (F.col("n_symbols") > symbol_share * F.col("word_chars")) | (F.col("n_dup_lines") * 8 > line_share * F.col("n_words"))
    hosts = cut(
        counts.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(failed.cast("long")).alias("host_failed")),
        "op1-hosts",
    )
    rate = F.col("host_failed") / F.col("host_docs")
    total = hosts.agg(
        F.count("*").alias("hosts"), F.sum("host_docs").alias("docs"), F.sum("host_failed").alias("failed"),
        F.sum(rate).alias("rates"), F.sum(rate * rate).alias("squares"), F.sum(1 / F.col("host_docs")).alias("inverse"),
    ).first()
    alpha = beta = 1.0
    if total["hosts"] and 0 < total["failed"] < total["docs"]:
        mean = total["rates"] / total["hosts"]
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        sampling = mean * (1 - mean) * total["inverse"] / total["hosts"]
        spread = max(total["squares"] / total["hosts"] - mean * mean - sampling, 1e-9)
        strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e4)
        alpha, beta = mean * strength, (1 - mean) * strength
    shrunk = (F.col("host_failed") + alpha) / (F.col("host_docs") + alpha + beta)
    return hosts.select("host", "host_docs", "host_failed", shrunk.alias("host_rate"), (shrunk > reject_rate).alias("host_rejected"))


def apply_rules(docs: DataFrame, salts: int = 16, min_words: int = 20, repeat_pct: int = 30, **verdict) -> DataFrame:
    """Counts, base verdict and final verdict for every document.

    The host table is repeated `salts` times and joined on (host, salt), so a host with a
    third of the documents is spread over that many join keys.
    """
    counts = rule_counts(docs)
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeat_pct)
    counts = cut(counts.withColumn("base_failed", failed), "op1-counts")
    hosts = host_verdicts(counts, **verdict).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = counts.withColumn("salt", F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(salts)).cast("int"))
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False))
    return salted.join(hosts, ["host", "salt"], "left").select("doc_id", *COUNTS, "base_failed", kept.alias("kept"))


def op1_quality_rules(spark, sf_dir):
    """Every document of `documents` against the rules."""
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The host step uses the same sums as host_verdicts.
OP1_SQL = """
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
grams AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
hits AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
cover AS (SELECT rid, count(DISTINCT i + k)::BIGINT AS n FROM hits, (SELECT unnest(range(0, 8)) AS k) GROUP BY rid),
c AS (
  SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))::BIGINT
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))))::BIGINT AS n_dup_lines,
    coalesce(cover.n, 0) AS n_repeat_words
  FROM w LEFT JOIN cover USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
h AS (
  SELECT source, count(*)::DOUBLE AS n,
    sum(CASE WHEN base_failed OR n_symbols > 0.25 * word_chars OR n_dup_lines * 8 > 0.5 * n_words THEN 1 ELSE 0 END)::DOUBLE AS bad
  FROM f WHERE source IS NOT NULL GROUP BY source),
t AS (SELECT count(*)::DOUBLE AS hosts, sum(n) AS docs, sum(bad) AS failed, sum(bad / n) AS rates, sum(bad / n * bad / n) AS squares, sum(1 / n) AS inverse FROM h),
m AS (SELECT *, least(greatest(rates / hosts, 1e-6), 1 - 1e-6) AS mean FROM t),
s AS (SELECT *, least(greatest(mean * (1 - mean) / greatest(squares / hosts - mean * mean - mean * (1 - mean) * inverse / hosts, 1e-9) - 1, 1.0), 1e4) AS strength,
        failed > 0 AND failed < docs AS fitted FROM m),
p AS (SELECT CASE WHEN fitted THEN mean * strength ELSE 1 END AS a, CASE WHEN fitted THEN (1 - mean) * strength ELSE 1 END AS b FROM s),
v AS (SELECT source, (bad + a) / (n + a + b) > 0.7 AS rejected FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(rejected, FALSE) AS kept
FROM f LEFT JOIN v USING (source)
"""
