"""The content gate: one verdict a row from additive layers, the batch filter and the purge built on it.

Every layer reads its own row, so a verdict costs a scan and no shuffle. A null text counts as
empty and is rejected as too short; null titles, sources and urls count as empty; equal rows get
equal verdicts; an empty table gives an empty table. Columns of the input are carried as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import rowwise as r
from lodestar.operators.lexicon import FORMATTING, GENERIC_AUTHORS, HEDGES, PLATFORM, SPAM_DOMAINS, STRONG, STRUCTURE, TRANSITIONS, TRUSTED_DOMAINS, WEAK

STRICT, LENIENT, LENIENT_TRUST, BONUS_TRUST = 0.30, 0.55, 0.85, 0.90
FLAGS = "(?iUd)"
MAX_SIGNALS = 25


def _count(text: Column, pattern: str, flags: str = FLAGS) -> Column:
    return F.regexp_count(text, F.lit(flags + pattern))


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(FLAGS + pattern)


def _number(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)).cast("int")


def _sum(items) -> Column:
    return reduce(lambda a, b: a + b, items)


PATTERNS = [*STRONG, *WEAK, *STRUCTURE, *PLATFORM, *FORMATTING]


def _measures(df: DataFrame, approved: DataFrame | None) -> DataFrame:
    """The row as `row`, then what the layers read."""
    have = {c.lower() for c in df.columns}
    col = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) if name in have else F.lit("")
    author = r.strip(F.lower(col("author")))
    links = F.coalesce(F.size("external_links") >= 2, F.lit(False)) if "external_links" in have else F.lit(False)
    checks = [(F.length(author) > 2) & ~author.isin(GENERIC_AUTHORS), col("published_date") != "", col("content").rlike(r"(?U)\[\d+\]|\(\d{4}\)|https?://"), links]
    place = F.when(col("url") != "", col("url")).otherwise(col("source_name"))
    out = df.select(
        F.struct("*").alias("row"), r.strip(col("content")).alias("text"), col("title").alias("title"), col("source_name").alias("source"),
        F.lower(F.when(F.contains(place, F.lit("://")), F.regexp_extract(place, "://([^/?#]*)", 1)).otherwise(place)).alias("domain"), (_sum(map(_number, checks)) / 4).alias("provenance"),
    )
    if approved is None:
        out = out.withColumn("trusted", F.lit(False))
    else:
        names = approved.select(F.col(approved.columns[0]).alias("approved")).distinct()
        out = out.join(names, F.col("source") == F.col("approved"), "left").withColumn("trusted", F.col("approved").isNotNull()).drop("approved")
    text = F.col("text")
    out = out.withColumn("m", r.measured(text, PATTERNS, TRANSITIONS, HEDGES))
    m = F.col("m")
    n = m["n"]
    # expressions run only where the text may have a match
    where = lambda p: F.get(m["may"], PATTERNS.index(p))
    count = lambda p, flags=FLAGS: F.when(where(p), _count(text, p, flags)).otherwise(0)
    per_word = lambda x: F.when(n >= 50, x / n).otherwise(0.0)
    trust = F.coalesce(*[F.when(F.contains("domain", F.lit(d)), t) for d, t in TRUSTED_DOMAINS.items()], F.lit(0.0))
    urls = F.when(F.contains(text, F.lit("http")), F.regexp_count(text, F.lit(r"(?U)https?://\S+"))).otherwise(0)
    return out.withColumns({
        "n": n,
        "spam": reduce(lambda a, b: a | b, [F.contains("domain", F.lit(d)) for d in SPAM_DOMAINS]),
        "trust": trust,
        "strong": F.array(*[count(p) for p in STRONG]),
        "weak": F.array(*[count(p) for p in WEAK]),
        "structure": _sum(count(p, FLAGS + "(?m)") * 0.08 for p in STRUCTURE),
        "platform": _sum(_number((where(p) & _has(text, p)) | _has(F.col("title"), p)) for p in PLATFORM),
        "formatting": _sum(count(p, FLAGS + "(?m)") for p in FORMATTING),
        **{name: m[name] for name in ("entropy", "sentences", "paragraphs", "repetition", "richness", "syntax", "burstiness", "compression")},
        "facts": per_word(m["facts"] + 3 * urls),
        "transitions": per_word(m["transitions"]),
        "hedging": per_word(m["hedges"]),
    })


def _layers() -> list[tuple[str, Column, Column]]:
    """Name, condition and addend of each layer, in the order in which they act; clamped ones are negative."""
    c = F.col
    hits = lambda name: F.size(F.filter(c(name), lambda x: x > 0))
    return [
        ("spam domain", c("spam"), F.lit(0.4)),
        ("source not approved", ~c("spam") & ~c("trusted") & (c("trust") == 0), F.lit(0.05)),
        ("strong phrases", hits("strong") > 0, F.least(0.15 * hits("strong"), F.lit(0.50))),
        ("dense weak phrases", (hits("weak") >= 4) & (hits("weak") / F.greatest(c("n") / 1000.0, F.lit(0.2)) >= 3.0), F.least(0.04 * hits("weak"), F.lit(0.15))),
        ("structure", c("structure") > 0, F.least(c("structure"), F.lit(0.25))),
        ("platform", c("platform") > 0, 0.35 * c("platform")),
        ("formatting", c("formatting") >= 3, F.lit(0.15)),
        ("low entropy", c("entropy") < 3.0, F.lit(0.2)),
        ("high entropy", c("entropy") > 5.5, F.lit(0.15)),
        ("uniform sentences", c("sentences") > 0.85, F.lit(0.18)),
        ("uniform paragraphs", c("paragraphs") > 0.8, F.lit(0.12)),
        ("repetition", c("repetition") > 0.3, F.lit(0.15)),
        ("poor vocabulary", c("richness") < 0.3, F.lit(0.12)),
        ("same sentence starts", c("syntax") > 0.85, F.lit(0.15)),
        ("few facts", (c("facts") < 0.05) & (c("n") > 200), F.lit(0.1)),
        ("transitions", c("transitions") > 0.08, F.lit(0.12)),
        ("hedging", c("hedging") > 0.06, F.lit(0.1)),
        ("provenance", c("provenance") >= 0.5, F.lit(-0.10)),
        ("no provenance", (c("provenance") == 0) & (c("n") > 200), F.lit(0.06)),
        ("compressible", (c("n") > 150) & (c("compression") < 0.30), F.lit(0.15)),
        ("low burstiness", (c("n") > 150) & (c("burstiness") < 0.20), F.lit(0.12)),
        ("trusted domain", c("trust") >= BONUS_TRUST, F.lit(-0.15)),
    ]


def verdicts(items: DataFrame, approved: DataFrame | None = None) -> DataFrame:
    """`items` with one struct column `verdict`; reads content and, where there, title, source_name, url,
    author, published_date and external_links. `approved` lists approved source names in its first column.

    The score takes the layers in order and stays at 0 or more after each that lowers it. Approved sources and
    domains trusted at 0.85 or more have it damped by 0.6 and are rejected above 0.55, others above 0.30, spam domains always.
    """
    c = F.col
    layers = _layers()
    steps = F.array(*[F.struct(F.lit(name).alias("name"), F.coalesce(when, F.lit(False)).alias("on"), by.cast("double").alias("by")) for name, when, by in layers])
    m = _measures(items, approved).withColumn("fired", F.filter(steps, lambda s: s["on"]))
    score = F.aggregate("fired", F.lit(0.0), lambda a, s: F.when(s["by"] < 0, F.greatest(F.lit(0.0), a + s["by"])).otherwise(a + s["by"]))
    eased = c("trusted") | (c("trust") >= LENIENT_TRUST)
    m = m.withColumn("score", score).withColumn("score", F.least(F.when(eased, c("score") * 0.6).otherwise(c("score")), F.lit(1.0)))
    short = F.length("text") < 20
    fields = {
        "is_slop": c("spam") | (c("score") > F.when(eased, LENIENT).otherwise(STRICT)),
        "confidence": F.round("score", 4),
        "signals": F.slice(F.transform("fired", lambda s: s["name"]), 1, MAX_SIGNALS),
        "boilerplate_count": F.aggregate(F.concat("strong", "weak"), F.lit(0), lambda a, x: a + x),
        "source_trusted": c("trusted"),
        **{f"{out}": F.round(name, 4) for out, name in [
            ("structure_score", "structure"), ("entropy_score", "entropy"), ("factual_density", "facts"), ("syntactic_uniformity", "syntax"), ("repetition_score", "repetition"),
            ("vocabulary_richness", "richness"), ("provenance_score", "provenance"), ("compression_ratio", "compression"), ("burstiness", "burstiness"),
        ]},
    }
    fixed = {"is_slop": F.lit(True), "confidence": F.lit(0.7), "signals": F.array(F.lit("too short")), "source_trusted": F.lit(False), "boilerplate_count": F.lit(0)}
    struct = F.struct(*[F.when(short, fixed.get(k, F.lit(0.0))).otherwise(v).alias(k) for k, v in fields.items()])
    kept = [c("row")[name].alias(name) for name in items.columns if name.lower() != "verdict"]
    # a generated column: filters on the verdict don't repeat its expressions below
    return m.select(*kept, F.explode(F.array(struct)).alias("verdict"))


def screen(items: DataFrame, approved: DataFrame | None = None) -> DataFrame:
    """Every row with its verdict carried: split it by `_slop_verdict`. Rejected rows have no quality and no trust."""
    v = F.col("verdict")
    fine = ~v["is_slop"]
    return verdicts(items, approved).withColumns({
        "_slop_score": v["confidence"], "_slop_signals": v["signals"], "_slop_verdict": F.when(fine, "pass").otherwise("rejected"),
        "_quality_score": F.when(fine, 1 - v["confidence"]), "_source_trusted": F.when(fine, v["source_trusted"]),
    }).drop("verdict")


def purge(items: DataFrame, approved: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What stays, and one audit row for each row that goes. Authors and dates are not looked at; write only the audit for a dry run."""
    read = [F.col(f"`{c}`") for c in items.columns if c.lower() in ("content", "title", "source_name", "url")]
    seen = verdicts(items.select(F.struct("*").alias("item"), *read), approved)
    kept = seen.where(~F.col("verdict.is_slop")).select("item.*")
    audit = seen.where("verdict.is_slop").select("url", F.col("verdict.confidence").alias("score"), F.col("verdict.signals").alias("signals"), "source_name", F.lit("purge").alias("stage"))
    return kept, audit
