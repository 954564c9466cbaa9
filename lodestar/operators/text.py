"""Tokens, normalisers, filters and text statistics over the item table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions.rowwise import possible
from lodestar.operators.dialect import Spark, bare_corpus, corpus, micro, one_row_an_item, operator, plan
from lodestar.operators.lexicon import CATEGORY_KEYWORDS, HEDGES, LANGUAGE_WORDS, STOP_WORDS, STRONG, TRANSITIONS, WEAK

WORD = r"[^\s]+"
CONTENT = "content"


def words(d, x: str) -> str:
    return d.all(x, WORD)


def clean(d, x: str) -> str:
    """Tags to spaces, white space to one space, trimmed, lower, 5000 characters."""
    return f"substr(lower(trim({d.replace(d.replace(x, '<[^>]+>', ' '), chr(92) + 's+', ' ')})), 1, 5000)"


def quoted(d, items) -> str:
    return ", ".join(d.s(x) for x in items)


def tokens(d, x: str) -> str:
    """Lower-case letter and digit runs of two or more that are no stop words."""
    return d.where(d.all(f"lower({x})", "[a-z0-9]+"), f"length(x) > 1 AND x NOT IN ({quoted(d, STOP_WORDS)})")


@operator("fil_1")
def validate(d):
    bad = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
    return f"""WITH {corpus(d)}, c AS (SELECT id, {d.replace('content', bad, '')} AS t, greatest(0.0, least(1.0, quality)) AS q, title FROM corpus)
SELECT id, CASE WHEN length(t) <= 5000 THEN length(t) ELSE length({d.replace("substr(t, 1, 5000)", r" [^ ]*$", "")}) END AS kept_chars, {micro('q')} AS quality FROM c WHERE trim(title) <> '' AND trim(t) <> ''"""


@operator("fil_2")
def search_text(d):
    return f"WITH {corpus(d)} SELECT id, md5({clean(d, 'content')}) AS digest, length({clean(d, 'content')}) AS n FROM corpus"


@operator("str_1")
def normalise_keep_dot(d):
    return f"WITH {corpus(d)} SELECT id, {d.replace('lower(title)', chr(91) + '^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_' + chr(92) + 's' + chr(92) + chr(45) + chr(46) + ']', ' ')} AS normal FROM corpus"


@operator("str_2")
def normalise_ascii(d):
    return f"WITH {corpus(d)} SELECT id, {d.replace('lower(title)', r'[^a-z0-9_\s-]', ' ')} AS normal FROM corpus"


@operator("str_3")
def query_tokens(d):
    return f"WITH {corpus(d)} SELECT id, {d.join(tokens(d, 'title'), ',')} AS tokens FROM corpus"


@operator("str_4")
def fingerprint_tokens(d):
    t = d.all("lower(content)", "[a-z0-9]+")
    return f"WITH {corpus(d)} SELECT id, {d.size(t)} AS n, md5({d.join(t)}) AS digest FROM corpus"


@operator("str_5")
def thesaurus_tokens(d):
    t = d.where(d.all("lower(content)", "[a-z][a-z0-9-]{3,}"), f"x NOT IN ({quoted(d, STOP_WORDS)})")
    return f"WITH {corpus(d)} SELECT id, {d.size(t)} AS n, {d.size(d.distinct(t))} AS n_distinct FROM corpus"


@operator("str_6")
def split_tokens(d):
    t = d.where(d.all("lower(title)", r"[\p{L}\p{N}]+"), "octet_length(x) > 1" if d.name == "spark" else "strlen(x) > 1")
    return f"WITH {corpus(d)} SELECT id, {d.join(t, '|')} AS tokens FROM corpus"


@operator("str_7")
def edit_distance(d):
    return f"""WITH n AS (SELECT n_name AS a FROM nation), r AS (SELECT r_name AS b FROM region)
SELECT a, b, cast({d.lev('lower(a)', 'lower(b)')} AS bigint) AS distance FROM n CROSS JOIN r"""


@operator("str_8")
def closest(d):
    """Nearest region name of each nation name: least distance, first by key, under 0.4 of the length or 2."""
    return f"""WITH p AS (SELECT n_nationkey, n_name, r_name, r_regionkey, cast({d.lev('lower(n_name)', 'lower(r_name)')} AS bigint) AS dist FROM nation CROSS JOIN region),
k AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY dist, r_regionkey) AS rn FROM p)
SELECT n_nationkey, CASE WHEN dist <= 2 AND dist < 0.4 * length(n_name) THEN r_name ELSE n_name END AS corrected, dist FROM k WHERE rn = 1"""


@operator("str_13")
def category_votes(d):
    """Category with the most keywords contained anywhere in the text; the first on ties."""
    sums = []
    for name, keys in CATEGORY_KEYWORDS.items():
        sums.append(f"SELECT id, {d.s(name)} AS category, {len(sums)} AS place, " + " + ".join(f"CASE WHEN contains(t, {d.s(k)}) THEN 1 ELSE 0 END" for k in keys) + " AS votes FROM c")
    return f"""WITH {corpus(d)}, c AS (SELECT id, lower(content) AS t FROM corpus), v AS ({' UNION ALL '.join(sums)}),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, place) AS rn FROM v)
SELECT id, CASE WHEN votes > 0 THEN category ELSE '' END AS category, votes FROM k WHERE rn = 1"""


@operator("str_14")
def match_expressions(d):
    t = tokens(d, "title")
    return f"""WITH {corpus(d)}, c AS (SELECT id, {t} AS ts FROM corpus)
SELECT id, {d.join('ts', ' OR ')} AS any_of, concat('"', {d.join('ts', ' ')}, '"') AS phrase FROM c"""


@operator("str_15")
def unsafe_strip(d):
    return f"WITH {corpus(d)} SELECT id, trim({d.replace(d.replace('title', '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + chr(92) + 's]', ' '), ' +', ' ')}) AS safe FROM corpus"


def sentences(d, x: str) -> str:
    """Pieces between runs of . ! ? that are over five characters long when trimmed."""
    mark = chr(1)
    return d.where(d.map(d.split(d.replace(x, "[.!?]+", mark), mark), d.replace("x", r"^\s+|\s+$", "")), "length(x) > 5")


@operator("str_20")
def snippet(d):
    """Three sentences with the most words shared with the title, by score then place, in text order, 300 characters."""
    mark = chr(1)
    parts = d.split(d.replace("content", r"([.!?])\s+", "$1" + mark), mark)
    q = d.distinct(d.all("lower(title)", "[a-z0-9]+"))
    body = d.each("id, qs", "c", "parts", "s", "pos")
    return f"""WITH {corpus(d)}, c AS (SELECT id, {q} AS qs, {parts} AS parts FROM corpus),
s AS ({body}),
k AS (SELECT id, pos, s, {d.size(d.common('qs', d.distinct(d.all('lower(s)', '[a-z0-9]+'))))} AS overlap FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY floor((overlap + 1 / (1 + 0.1 * pos)) * 1000000000) DESC, pos) AS rn FROM k)
SELECT id, substr({d.join(d.gather('s', 'pos'))}, 1, 300) AS snippet FROM r WHERE rn <= 3 GROUP BY id"""


@operator("str_21")
def window_snippet(d):
    """320 characters from 60 before the first word the title gives."""
    w = f"coalesce({d.all('lower(title)', '[a-z]{4,}')}{'[1]' if d.name == 'check' else ''}, '')" if d.name == "check" else f"coalesce(get({d.all('lower(title)', '[a-z]{4,}')}, 0), '')"
    return f"""WITH {corpus(d)}, c AS (SELECT id, content, {w} AS w FROM corpus), k AS (SELECT *, CASE WHEN w = '' THEN 0 ELSE instr(lower(content), w) END AS spot FROM c)
SELECT id, substr(content, cast(greatest(spot - 60, 1) AS int), 320) AS snippet FROM k"""


@operator("str_22")
def highlight(d):
    return f"WITH {corpus(d)} SELECT id, {d.replace('title', d.ascii_word('the|and|der|la'), '<mark>$1</mark>')} AS marked FROM corpus"


@operator("str_23")
def feed_text(d):
    x = d.replace(d.replace("html", "<[^>]+>", " "), r"\s+", " ")
    return f"SELECT page_id, md5(trim({x})) AS digest, length(trim({x})) AS n FROM pages"


@operator("str_26")
def syllables(d):
    x = d.each("id", "c", "ws", "w", "pos")
    groups = d.count("w", "[aeiouy]+")
    return f"""WITH {corpus(d)}, c AS (SELECT id, {d.all('lower(content)', '[a-z]+')} AS ws FROM corpus), w AS ({x})
SELECT id, cast(sum(CASE WHEN length(w) <= 2 THEN 1 ELSE greatest(1, {groups} - CASE WHEN right(w, 1) = 'e' THEN 1 ELSE 0 END) END) AS bigint) AS syllables FROM w GROUP BY id"""


@operator("str_27")
def complexity(d):
    n = d.size(words(d, "content"))
    mean = f"length({d.replace('content', chr(92) + 's', '')}) / cast(greatest({n}, 1) AS double)"
    return f"WITH {corpus(d)} SELECT id, CASE WHEN {mean} < 4 THEN 'simple' WHEN {mean} < 5 THEN 'moderate' WHEN {mean} < 6 THEN 'complex' ELSE 'advanced' END AS bucket FROM corpus"


@operator("str_28")
def language_vote(d):
    """Language with the most distinct function words, over five, in fixed order on ties; else en."""
    sums = [f"SELECT id, {d.s(k)} AS lang, {i} AS place, {d.size(d.common('ws', d.list(*[d.s(x) for x in v])))} AS votes FROM c" for i, (k, v) in enumerate(LANGUAGE_WORDS.items())]
    return f"""WITH {corpus(d)}, c AS (SELECT id, {d.distinct(d.all('lower(content)', WORD))} AS ws FROM corpus), v AS ({' UNION ALL '.join(sums)}),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, place) AS rn FROM v)
SELECT id, CASE WHEN votes > 5 THEN lang ELSE 'en' END AS voted FROM k WHERE rn = 1"""


@operator("str_29")
def url_title(d):
    path = d.replace("url", r"^https?://[^/]+/|[?#].*$|\.[a-z]+$", "")
    return f"SELECT page_id, {d.replace(path, '[-_/]+', ' ')} AS title FROM pages"


@operator("mth_1")
def entropy(d):
    chars = d.each("id", "c", "cs", "ch", "pos")
    return f"""WITH {corpus(d)}, c AS (SELECT id, {d.chars(d.replace('lower(content)', '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]', ''))} AS cs FROM corpus),
f AS (SELECT id, ch, count(*) AS n FROM ({chars}) t GROUP BY id, ch), t AS (SELECT *, cast(sum(n) OVER (PARTITION BY id) AS double) AS total FROM f)
SELECT id, {micro('-sum(n / total * log2(n / total))')} AS entropy FROM t GROUP BY id"""


@operator("mth_2")
def uniformity(d):
    """1 less the coefficient of variation of sentence lengths, 0 below three sentences."""
    s = d.each("id", "c", "ss", "s", "pos")
    return f"""WITH {corpus(d)}, c AS (SELECT id, {sentences(d, 'content')} AS ss FROM corpus),
n AS (SELECT id, {d.size(words(d, 's'))} AS n FROM ({s}) t)
SELECT id, count(*) AS sentences, {micro("CASE WHEN count(*) < 3 THEN 0 ELSE greatest(0, 1 - stddev_pop(n) / avg(n)) END")} AS uniformity, {micro("CASE WHEN count(*) < 3 THEN 0 ELSE stddev_pop(n) / avg(n) END")} AS burstiness FROM n GROUP BY id"""


@operator("mth_6")
def content_hash(d):
    x = f"trim({d.replace('lower(content)', chr(92) + 's+', ' ')})"
    return f"WITH {corpus(d)} SELECT id, {d.sha256(x)} AS content_hash, md5(content) AS page_hash FROM corpus"


@operator("mth_11")
def grade(d):
    groups = d.count("lower(content)", "[aeiouy]+")
    n = f"cast(greatest({d.size(words(d, 'content'))}, 1) AS double)"
    return f"WITH {corpus(d)} SELECT id, {micro(f'0.39 * {n} / greatest({d.size(sentences(d, CONTENT))}, 1) + 11.8 * {groups} / {n} - 15.59')} AS grade FROM corpus"


@operator("rem_16")
def type_token(d):
    w = d.where(d.map(words(d, "content"), "lower(x)"), "length(x) > 2")
    return f"WITH {corpus(d)} SELECT id, {micro(f'{d.size(d.distinct(w))} / cast(greatest({d.size(w)}, 1) AS double)')} AS ratio FROM corpus"


@operator("win_11")
def start_mode(d):
    """Share of the most common three-word sentence start."""
    s = d.each("id", "c", "ss", "s", "pos")
    start = d.join(d.slice(words(d, "lower(s)"), 1, 3))
    return f"""WITH {corpus(d)}, c AS (SELECT id, {sentences(d, 'content')} AS ss FROM corpus),
g AS (SELECT id, {start} AS start, count(*) AS n FROM ({s}) t GROUP BY id, {start})
SELECT id, max(n) AS most, cast(sum(n) AS bigint) AS sentences FROM g GROUP BY id"""


@operator("win_12")
def trigrams(d):
    """Share of distinct three-word runs that occur over twice."""
    w = d.each("id", "c", "ws", "w", "pos")
    return f"""WITH {corpus(d)}, c AS (SELECT id, {words(d, 'lower(content)')} AS ws FROM corpus), w AS ({w}),
g AS (SELECT id, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o) AS g, lead(w, 2) OVER o AS last FROM w WINDOW o AS (PARTITION BY id ORDER BY pos)),
n AS (SELECT id, g, count(*) AS n FROM g WHERE last IS NOT NULL GROUP BY id, g)
SELECT id, count(*) AS distinct_grams, cast(sum(CASE WHEN n > 2 THEN 1 ELSE 0 END) AS bigint) AS repeated FROM n GROUP BY id"""


@operator("ir_14a")
def phrases(d):
    strong = " + ".join(f"CASE WHEN {d.matches('content', '(?i)' + p)} THEN 1 ELSE 0 END" for p in STRONG)
    weak = " + ".join(f"CASE WHEN {d.matches('content', '(?i)' + p)} THEN 1 ELSE 0 END" for p in WEAK)
    n = d.size(words(d, "content"))
    return f"""WITH {corpus(d)}, h AS (SELECT id, {strong} AS strong, {weak} AS weak, {n} AS n FROM corpus)
SELECT id, strong, weak, {_phrase_score('n')} AS score FROM h"""


def _phrase_score(n: str) -> str:
    return micro(f"least(0.15 * strong, 0.5) + CASE WHEN weak >= 4 AND weak / greatest({n} / 1000.0, 0.2) >= 3 THEN least(0.04 * weak, 0.15) ELSE 0 END")


@plan("ir_14a")
def _(spark):
    """An expression runs only on texts that hold what its matches must hold, and words are counted only where that decides."""
    d = Spark()
    items = bare_corpus() if one_row_an_item(spark) else corpus(d)
    spark.sql(f"WITH {items} SELECT id, content FROM corpus").withColumn("may", possible(F.col("content"), [*STRONG, *WEAK])).createOrReplaceTempView("sifted")
    hits = [f"CASE WHEN may[{i}] AND {d.matches('content', '(?i)' + p)} THEN 1 ELSE 0 END" for i, p in enumerate([*STRONG, *WEAK])]
    strong, weak = " + ".join(hits[: len(STRONG)]), " + ".join(hits[len(STRONG) :])
    return spark.sql(f"WITH h AS (SELECT id, content, {strong} AS strong, {weak} AS weak FROM sifted) SELECT id, strong, weak, {_phrase_score(d.size(words(d, 'content')))} AS score FROM h")


@operator("ir_14d")
def densities(d):
    """Factual, transition and hedging densities, 0 below fifty words."""
    w = d.each("id, content, n", "c", "ws", "w", "pos")
    fact = f"CASE WHEN {d.matches('w', '^[0-9]')} THEN 1 WHEN {d.matches('w', chr(94) + chr(92) + '[[0-9]+' + chr(92) + ']')} THEN 2 WHEN {d.matches('w', chr(94) + chr(92) + '([0-9]{4}' + chr(92) + ')')} THEN 2 WHEN substr(w, 1, 1) IN ('\"', '{chr(39) * 2 if d.name == 'check' else chr(92) + chr(39)}') THEN 1 ELSE 0 END"
    trans = f"CASE WHEN {d.replace('lower(w)', '[,.]+$', '')} IN ({quoted(d, TRANSITIONS)}) THEN 1 ELSE 0 END"
    hedge = " + ".join(d.count("lower(content)", h) for h in HEDGES)
    urls = d.count("content", r"https?://\S+")
    return f"""WITH {corpus(d)}, c AS (SELECT id, content, {words(d, 'content')} AS ws, {d.size(words(d, 'content'))} AS n FROM corpus), w AS ({w}),
s AS (SELECT id, n, sum({fact}) AS facts, sum({trans}) AS transitions FROM w GROUP BY id, n),
h AS (SELECT id, {hedge} AS hedges, {urls} AS urls FROM corpus)
SELECT s.id, {micro("CASE WHEN n < 50 THEN 0 ELSE (facts + 3 * urls) / cast(n AS double) END")} AS factual, {micro("CASE WHEN n < 50 THEN 0 ELSE transitions / cast(n AS double) END")} AS transition, {micro("CASE WHEN n < 50 THEN 0 ELSE hedges / cast(n AS double) END")} AS hedging FROM s JOIN h ON s.id = h.id"""


@operator("ir_14e")
def provenance(d):
    cite = d.matches("content", r"\[[0-9]+\]|\([0-9]{4}\)|https?://")
    n = d.size(words(d, "content"))
    return f"""WITH {corpus(d)}, p AS (SELECT id, {n} AS n, (CASE WHEN lower(source_name) NOT IN ('admin', 'editor', 'staff', 'unknown', '') THEN 1 ELSE 0 END + CASE WHEN {cite} THEN 1 ELSE 0 END) / 4.0 AS share FROM corpus)
SELECT id, {micro('share')} AS provenance, CASE WHEN share >= 0.5 THEN -100000 WHEN share = 0 AND n > 200 THEN 60000 ELSE 0 END AS adjust FROM p"""


@operator("jsn_5")
def quality_signals(d):
    return f"""WITH {corpus(d)} SELECT id, {d.size(words(d, 'content'))} AS n_words, {d.size(sentences(d, 'content'))} AS n_sentences, {d.count('content', '[0-9]{4}')} AS years, {d.count('content', r'https?://')} AS links,
{d.size(words(d, 'title'))} AS title_words, language FROM corpus"""


@operator("ir_13")
def content_score(d):
    """Quality ladder of length, sentence length, diversity, title and citations."""
    n, s = d.size(words(d, "content")), d.size(sentences(d, "content"))
    distinct = d.size(d.distinct(d.where(d.map(words(d, "content"), "lower(x)"), "length(x) > 2")))
    sw = f"{d.size(words(d, d.join(sentences(d, 'content'))))}"
    return f"""WITH {corpus(d)}, m AS (SELECT id, {n} AS n, {s} AS s, {sw} AS sw, {distinct} AS u, {d.size(words(d, 'title'))} AS tw, {d.matches('content', '[0-9]{4}')} AS y, {d.matches('content', chr(92) + '[[0-9]+' + chr(92) + ']|' + chr(92) + '([0-9]{4}' + chr(92) + ')')} AS c FROM corpus),
p AS (SELECT *, sw / cast(greatest(s, 1) AS double) AS mean, u / cast(greatest(n, 1) AS double) AS div FROM m)
SELECT id, {micro('''least(1.0, CASE WHEN n > 3000 THEN 0.3 WHEN n > 1000 THEN 0.25 WHEN n > 500 THEN 0.2 WHEN n > 200 THEN 0.15 WHEN n > 50 THEN 0.1 ELSE 0 END
  + CASE WHEN s = 0 THEN 0 WHEN mean BETWEEN 12 AND 25 THEN 0.2 WHEN mean BETWEEN 8 AND 35 THEN 0.1 ELSE 0 END + CASE WHEN div > 0.6 THEN 0.2 WHEN div > 0.4 THEN 0.15 WHEN div > 0.25 THEN 0.1 ELSE 0 END
  + CASE WHEN tw >= 3 THEN 0.1 ELSE 0 END + CASE WHEN y THEN 0.05 ELSE 0 END + CASE WHEN c THEN 0.1 ELSE 0 END)''')} AS score FROM p"""
