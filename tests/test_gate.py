"""The content gate: its statistics against plain versions, verdicts worked out by hand, edge rows."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.functions import rowwise as r
from lodestar.operators import gate

FIELDS = "id long, content string, title string, source_name string, url string"


def texts():
    g = random.Random(5)
    made = ["", " ", "a", "!?.", "naïve café 12 ½ 　x", "\n\n".join(["Same words in this long paragraph."] * 4)]
    return made + ["".join(g.choice(["alpha ", "Beta ", "c. ", "d! ", "e ", "\n\n", "7 ", "été? "]) for _ in range(g.randrange(1, 300))) for _ in range(30)]


def cv(lengths):
    mean = sum(lengths) / len(lengths) if lengths else 0
    return math.sqrt(sum((x - mean) ** 2 for x in lengths) / len(lengths)) / mean if mean else None


def plain(t):
    signs = [c for c in t.lower() if c.isalnum()]
    ws = t.lower().split()
    grams = Counter(zip(ws, ws[1:], ws[2:]))
    parts = [s.strip() for s in re.split("[.!?]+", t) if len(s.strip()) > 5]
    spread = cv([len(s.split()) for s in parts])
    return (
        -sum(n / len(signs) * math.log2(n / len(signs)) for n in Counter(signs).values()),
        sum(n > 2 for n in grams.values()) / len(grams) if len(ws) >= 20 else 0,
        len(set(ws)) / len(ws) if len(ws) >= 10 else 0.5,
        max(0, 1 - spread) if len(parts) >= 3 else 0,
        spread if len(parts) >= 4 else 0.5,
        max(Counter(tuple(s.lower().split()[:3]) for s in parts).values()) / len(parts) if len(parts) >= 4 else 0,
        len(zlib.compress(t.encode(), 6)) / len(t.encode()) if len(t.encode()) >= 200 else 0.5,
    )


def test_statistics(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "id long, t string")
    ws, parts = r.words(F.lower("t")), r.pieces(F.col("t"), "[.!?]+", 5)
    got = df.select("t", r.entropy(F.col("t")), r.repetition(ws), r.richness(ws), r.uniformity(parts), r.burstiness(parts), r.same_start(parts), r.compression(F.col("t"))).collect()
    for t, *values in got:
        assert values == pytest.approx(plain(t), abs=1e-9), t


def test_verdicts(spark):
    said = "The river rose in 1931 and fell again. Boats waited! Nobody in the small harbour town had seen such a flood before, or has since; old people still tell of it."
    rows = [
        (1, None, None, None, None), (2, "  short  ", "", "", ""), (3, said, "t", "s", "https://host.example/a"), (4, said, "t", "s", "https://m.facebook.com/a"),
        (5, said + " As an AI, I hope to help.", "t", "s", "https://host.example/a"), (6, said + " As an AI, I hope to help.", "AI-generated", "s", "https://en.wikipedia.org/a"), (7, said, "t", "good", ""),
    ]
    df = spark.createDataFrame([*rows, rows[2]], FIELDS).withColumn("verdict", F.lit("x")).withColumn("text", F.lit(1)).withColumn("score", F.lit(2))
    approved = spark.createDataFrame([("good",), ("good",), (None,)], "name string")
    out = gate.verdicts(df, approved)
    got = {x["id"]: x["verdict"] for x in out.collect()}
    assert out.count() == 8 and out.columns == ["id", "content", "title", "source_name", "url", "text", "score", "verdict"]
    assert [got[i]["confidence"] for i in range(1, 8)] == [0.7, 0.7, 0.05, 0.4, 0.35, round((0.15 * 2 + 0.35 - 0.15) * 0.6, 4), 0.0]
    assert [got[i]["is_slop"] for i in range(1, 8)] == [True, True, False, True, True, False, False]
    assert got[1]["signals"] == ["too short"] and got[5]["signals"] == ["source not approved", "strong phrases"] and got[7]["source_trusted"]
    assert gate.verdicts(df.limit(0)).count() == 0


def test_screen_and_purge(spark):
    df = spark.createDataFrame([(1, "x", "", "", "u"), (2, "Twenty characters or more stand here, in one line.", "", "", "v")], FIELDS).withColumn("author", F.lit("Ann Lee"))
    seen = {x["id"]: x for x in gate.screen(df).collect()}
    assert seen[1]["_slop_verdict"] == "rejected" and seen[1]["_quality_score"] is None and seen[2]["_slop_verdict"] == "pass" and seen[2]["_quality_score"] == 0.95
    kept, audit = gate.purge(df)
    assert kept.columns == df.columns and [x["id"] for x in kept.collect()] == [2] and [x["url"] for x in audit.collect()] == ["u"]


def test_measured(spark):
    """One pass of Python gives what the expressions give, and no pattern is held back where it matches."""
    made = [*texts(), "KİND as İı a ſign, AS AN Aİ I can Know", 'He said [12] (1999) "so" 7 ٧. Moreover, perhaps; thus.'] + [" ".join(["As an AI, let me explain. In today's modern world it's worth noting that", x]) for x in texts()]
    patterns = gate.PATTERNS
    df = spark.createDataFrame(list(enumerate(made)), "id long, t string").select("t", r.strip(F.col("t")).alias("s"))
    s, low = F.col("s"), r.words(F.lower("s"))
    parts = r.pieces(s, "[.!?]+", 5)
    plainly = [F.size(r.words(s)), r.entropy(s), r.uniformity(parts), r.uniformity(r.pieces(s, "\n\n", 20)), r.repetition(low), r.richness(low), r.same_start(r.pieces(s, "[.!?]+", 10))]
    hits = F.array(*[F.regexp_count("s", F.lit(gate.FLAGS + "(?m)" + p)) > 0 for p in patterns])
    rows = df.select("t", r.measured(s, patterns, gate.TRANSITIONS, gate.HEDGES).alias("m"), F.array(*[c.cast("double") for c in [*plainly, r.burstiness(parts), r.compression(s)]]).alias("want"), hits.alias("hits")).collect()
    for t, m, want, found in rows:
        assert [m[k] for k in ("n", "entropy", "sentences", "paragraphs", "repetition", "richness", "syntax", "burstiness", "compression")] == pytest.approx(want, abs=1e-9), t
        assert all(may or not hit for may, hit in zip(m["may"], found, strict=True)), t
    assert sum(map(sum, (x["hits"] for x in rows))) > 50 and sum(map(sum, (x["m"]["may"] for x in rows))) < len(rows) * len(patterns) / 2


def test_purge_measures_once(spark):
    """The filter on the verdict repeats no measure below it."""
    df = spark.createDataFrame([(1, "x", "", "", "u")], FIELDS)
    plan = gate.purge(df)[1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_count") == gate.verdicts(df)._jdf.queryExecution().optimizedPlan().toString().count("regexp_count")
