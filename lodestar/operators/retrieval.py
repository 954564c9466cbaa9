"""Postings, BM25, phrases, blending, suggestion, thesaurus, evaluation, near duplicates and link graphs."""

from __future__ import annotations

from lodestar.operators import fingerprints as fp
from lodestar.operators import pairs as near_words
from lodestar.operators.dialect import Spark, bare_corpus, corpus, micro, one_row_an_item, operator, plan
from lodestar.operators.lexicon import STOP_WORDS
from lodestar.operators.store import cut
from lodestar.operators.text import quoted
from lodestar.operators.urls import host

K1, B = 1.2, 0.75
#: Field weights of title, source, content.
WEIGHTS = (("title", 3.0), ("source_name", 1.5), ("content", 1.0))
TERM = r"[\p{L}\p{N}]+"


def postings(d, terms: list[str] | None = None) -> str:
    """postings(id, field, term, pos) of all fields; only `terms` where a query is known."""
    keep = f" WHERE term IN ({quoted(d, terms)})" if terms else ""
    parts = [f"SELECT id, '{f}' AS field, term, pos FROM ({d.each('id', 'corpus', d.all(f'lower({f})', TERM), 'term', 'pos')}) t{keep}" for f, _ in WEIGHTS]
    return f"postings AS ({' UNION ALL '.join(parts)})"


def lengths(d) -> str:
    total = " + ".join(d.size(d.all(f"lower({f})", TERM)) for f, _ in WEIGHTS)
    return f"lens AS (SELECT id, cast({total} AS double) AS n FROM corpus), stats AS (SELECT count(*) AS docs, avg(n) AS mean FROM lens)"


def bm25(d, terms: list[str]) -> str:
    """scored(id, score) over the whole item table."""
    weight = "CASE field " + " ".join(f"WHEN '{f}' THEN {w}e0" for f, w in WEIGHTS) + " END"
    return f"""{corpus(d)}, {postings(d, terms)}, {lengths(d)},
tf AS (SELECT id, term, sum({weight}) AS f FROM postings GROUP BY id, term), df AS (SELECT term, count(*) AS n FROM tf GROUP BY term),
idf AS (SELECT term, greatest(ln((docs - n + 0.5) / (n + 0.5)), 1e-6) AS w FROM df CROSS JOIN stats),
scored AS (SELECT tf.id, sum(w * f * {K1 + 1} / (f + {K1} * (1 - {B} + {B} * l.n / mean))) AS score FROM tf JOIN idf ON tf.term = idf.term JOIN lens l ON tf.id = l.id CROSS JOIN stats GROUP BY tf.id)"""


@operator("ir_1")
def index(d):
    return f"WITH {corpus(d)}, {postings(d)} SELECT field, term, count(*) AS postings, count(DISTINCT id) AS docs, cast(sum(pos) AS bigint) AS positions FROM postings GROUP BY field, term"


@plan("ir_1")
def _(spark):
    """Each task counts its own terms first; a row is an item, so no item is counted twice."""
    if not one_row_an_item(spark):
        return spark.sql(index(Spark()))
    terms = ", ".join(f"{Spark().all(f'lower({f})', TERM)} AS {f}" for f, _ in WEIGHTS)
    return near_words.index(spark.sql(f"WITH {bare_corpus()} SELECT {terms} FROM corpus"), [f for f, _ in WEIGHTS])


@operator("ir_2")
def rank(d):
    return f"WITH {bm25(d, ['thing', 'with', 'das'])} SELECT id, {micro('score')} AS score FROM scored"


@operator("ir_3")
def phrase(d):
    return f"""WITH {corpus(d)}, {postings(d, ['of', 'the'])} SELECT a.id, count(*) AS hits FROM postings a JOIN postings b ON a.id = b.id AND a.field = b.field AND b.pos = a.pos + 1
WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.id"""


def blended(d, terms: list[str]) -> str:
    return f"""{bm25(d, terms)}, best AS (SELECT max(score) AS top FROM scored),
final AS (SELECT s.id, url, source_name, 0.50 * score / top + 0.20 * 0.5 + 0.15 * quality + 0.15 * 0.5 AS score FROM scored s JOIN corpus c ON s.id = c.id CROSS JOIN best)"""


@operator("ir_4")
def keyword_search(d, terms=("thing", "with")):
    """Matches of the phrase of two terms if there are any, else of any term; blended and ranked."""
    return f"""WITH {blended(d, list(terms))}, ph AS (SELECT DISTINCT a.id FROM postings a JOIN postings b ON a.id = b.id AND a.field = b.field AND b.pos = a.pos + 1 WHERE a.term = {d.s(terms[0])} AND b.term = {d.s(terms[1])}),
any_ph AS (SELECT count(*) AS n FROM ph), pick AS (SELECT f.id, f.url, {micro('f.score')} AS score FROM final f CROSS JOIN any_ph LEFT JOIN ph ON f.id = ph.id WHERE any_ph.n = 0 OR ph.id IS NOT NULL)
SELECT id, url, score FROM pick ORDER BY score DESC, id LIMIT 20"""


@operator("ir_5")
def serving_search(d):
    """All matches with site and exclusion filters applied after ranking, 20 best."""
    return f"""WITH {blended(d, ['ing', 'of'])}, p AS (SELECT f.id, {micro('f.score')} AS score FROM final f JOIN corpus c ON c.id = f.id WHERE NOT contains(lower(c.content), 'worthless'))
SELECT id, score FROM p ORDER BY score DESC, id LIMIT 20"""


@operator("ir_6")
def browse(d):
    return f"WITH {corpus(d)} SELECT id, {micro('quality')} AS quality FROM corpus WHERE {host(d, 'url')} = 'src2.example' ORDER BY quality DESC, id LIMIT 50"


@operator("ir_10")
def suggest(d):
    return f"WITH {corpus(d)} SELECT id, title FROM corpus WHERE {d.matches('lower(title)', '(^|[^a-z0-9])th[a-z]*[^a-z0-9].*(^|[^a-z0-9])an')} ORDER BY quality DESC, id LIMIT 10"


def kept_words(d) -> str:
    return d.where(d.all("lower(content)", "[a-z][a-z0-9-]{3,}"), f"x NOT IN ({quoted(d, STOP_WORDS)})")


def pairs(d) -> str:
    """Tokens of each text without stop words, with their places; both ends of a window of eight."""
    return f"""{corpus(d)}, c AS (SELECT id, {kept_words(d)} AS ts FROM corpus), t AS ({d.each('id', 'c', 'ts', 'w', 'pos')}),
df AS (SELECT w, count(DISTINCT id) AS df FROM t GROUP BY w),
l AS (SELECT w, {', '.join(f'lead(w, {k}) OVER o AS l{k}' for k in range(1, 9))} FROM t WINDOW o AS (PARTITION BY id ORDER BY pos)),
v AS ({d.each('w', 'l', d.list(*[f'l{k}' for k in range(1, 9)]), 'v', 'k')}),
co AS (SELECT least(w, v) AS x, greatest(w, v) AS y, count(*) AS n FROM v WHERE v <> w GROUP BY least(w, v), greatest(w, v))"""


@operator("agg_20")
def document_frequency(d):
    return f"WITH {pairs(d).split('l AS (SELECT w, lead')[0].rstrip().rstrip(',')} SELECT w, df FROM df"


@operator("jn_13")
def cooccurrence(d):
    return f"WITH {pairs(d)} SELECT x, y, n FROM co WHERE n >= 3"


def associations(d) -> str:
    """k(term, related, ppmi, n, rn): partners of each term in either order by positive mutual information, from 3 joint occurrences on."""
    return f"""{pairs(d)}, tot AS (SELECT cast(sum(n) AS double) AS pairs FROM co), tw AS (SELECT cast(count(*) AS double) AS words FROM t), n AS (SELECT w, count(*) AS n FROM t GROUP BY w),
p AS (SELECT x, y, co.n, greatest(0, log2((co.n / pairs) / ((a.n / words) * (b.n / words)))) AS ppmi FROM co JOIN n a ON a.w = x JOIN n b ON b.w = y JOIN df da ON da.w = x JOIN df db ON db.w = y CROSS JOIN tot CROSS JOIN tw WHERE co.n >= 3 AND da.df >= 2 AND db.df >= 2),
{RANKED}"""


RANKED = f"""both_ways AS (SELECT x AS term, y AS related, n, {micro('ppmi')} AS ppmi FROM p UNION ALL SELECT y, x, n, {micro('ppmi')} FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY ppmi DESC, n DESC, related) AS rn FROM both_ways WHERE ppmi > 0)"""


def _counted(spark) -> tuple[int, int]:
    """Views co (h1, h2, n) of the pairs met three times or more, and words (w, n, df, h); how many words and pairs there are."""
    texts = spark.sql(f"WITH {bare_corpus()} SELECT {kept_words(Spark())} AS ts FROM corpus")
    words, total, all_pairs = near_words.vocabulary(texts, "ts")
    words.createOrReplaceTempView("words")
    near_words.counted(texts, "ts", words, all_pairs, 3).createOrReplaceTempView("co")
    return total, all_pairs


def ranked(build, last: str):
    """The plan of a query on k: the pairs are counted as numbers; the rest is the statement's."""

    def made(spark):
        if not one_row_an_item(spark):
            return spark.sql(build(Spark()))
        total, all_pairs = _counted(spark)
        return spark.sql(f"""WITH p AS (SELECT a.w AS x, b.w AS y, co.n, greatest(0, log2((co.n / {all_pairs}e0) / ((a.n / {total}e0) * (b.n / {total}e0)))) AS ppmi
FROM co JOIN words a ON a.h = h1 JOIN words b ON b.h = h2 WHERE a.df >= 2 AND b.df >= 2), {RANKED} {last}""")

    return made


@plan("jn_13")
def _(spark):
    if not one_row_an_item(spark):
        return spark.sql(cooccurrence(Spark()))
    _counted(spark)
    return spark.sql("SELECT least(a.w, b.w) AS x, greatest(a.w, b.w) AS y, co.n FROM co JOIN words a ON a.h = h1 JOIN words b ON b.h = h2")


@operator("ir_12")
def thesaurus(d):
    """The 15 strongest partners of each term."""
    return f"WITH {associations(d)} {STRONGEST}"


STRONGEST = "SELECT term, related, ppmi, n FROM k WHERE rn <= 15"
plan("ir_12")(ranked(thesaurus, STRONGEST))


@operator("ir_24")
def evaluation(d):
    """NDCG and reciprocal rank of all benchmark queries; a text that holds the passage is relevant."""
    hits = "SELECT b.item_id, d.doc_id FROM b JOIN documents d ON contains(d.text, b.text)"
    return f"""WITH b AS (SELECT item_id, text FROM benchmark), hits AS ({hits}), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rn FROM hits)
SELECT b.item_id, count(r.doc_id) AS hits, {micro('coalesce(sum(CASE WHEN rn <= 10 THEN 1 / log2(rn + 1.0) ELSE 0 END), 0)')} AS dcg, {micro('coalesce(1.0 / min(rn), 0)')} AS rr FROM b LEFT JOIN r ON b.item_id = r.item_id GROUP BY b.item_id"""


def prints(d) -> str:
    """64-bit fingerprints of whole texts, from the first 16 hex digits of md5 over every three words in a row.

    A text of one or two words counts its words; one without words has fingerprint 0.
    """
    ws = d.all("lower(content)", "[a-z0-9']+")
    bits = ", ".join(f"sum(CASE WHEN {d.shift_and('hi' if i > 31 else 'lo', i % 32, 1)} = 1 THEN 1 ELSE -1 END) AS b{i}" for i in range(64))
    low = " + ".join(f"CASE WHEN b{i} > 0 THEN cast({1 << i} AS bigint) ELSE 0 END" for i in range(63))
    return f"""{corpus(d)}, c AS (SELECT id, {ws} AS ws FROM corpus), c2 AS (SELECT id, ws, {d.size('ws')} AS n FROM c), w AS ({d.each('id, n', 'c2', 'ws', 'w', 'pos')}),
g AS (SELECT id, n, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY id ORDER BY pos)),
ms AS (SELECT id, md5(CASE WHEN n < 3 THEN w ELSE concat_ws(' ', w, w1, w2) END) AS m FROM g WHERE n < 3 OR w2 IS NOT NULL),
hs AS (SELECT id, {d.hex_long('m', 8)} AS hi, {d.hex_long('substr(m, 9)', 8)} AS lo FROM ms),
s AS (SELECT id, {bits} FROM hs GROUP BY id), folded AS (SELECT id, CASE WHEN b63 > 0 THEN -9223372036854775807 - 1 ELSE 0 END + {low} AS h FROM s),
prints AS (SELECT c.id, coalesce(h, 0) AS h FROM c LEFT JOIN folded f ON f.id = c.id)"""


@operator("mth_4")
def fingerprints(d):
    return f"WITH {prints(d)} SELECT id, h AS fingerprint FROM prints"


def printed(build, last: str):
    """The plan of a query on prints(id, h), made in one pass over each text; `last` stands behind the views."""

    def made(spark):
        if not one_row_an_item(spark):
            return spark.sql(build(Spark()))
        view_prints(spark)
        return spark.sql(last)

    return made


def view_prints(spark, stored: bool = False) -> None:
    """View prints(id, h) of the item table."""
    made = fp.prints(spark.sql(f"WITH {bare_corpus()} SELECT id, content FROM corpus"))
    (cut(made, "prints") if stored else made).createOrReplaceTempView("prints")


def view_links(spark) -> None:
    """Views prints(id, h), first(h, id, n), the first id of each fingerprint and its items, and links(x, y) of different fingerprints."""
    view_prints(spark, stored=True)
    first = cut(spark.sql("SELECT h, min(id) AS id, count(*) AS n FROM prints GROUP BY h"), "first")
    first.createOrReplaceTempView("first")
    cut(fp.links(first), "links").createOrReplaceTempView("links")


plan("mth_4")(printed(fingerprints, "SELECT id, h AS fingerprint FROM prints"))


def near(d) -> str:
    """All pairs that differ in ten bits or fewer: every two distinct fingerprints are compared, so none is missed."""
    return f"""{prints(d)}, u AS (SELECT DISTINCT h FROM prints),
links AS (SELECT a.h AS x, b.h AS y FROM u a JOIN u b ON a.h <= b.h AND {d.bit_count(d.xor('a.h', 'b.h'))} <= 10),
near AS (SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM links JOIN prints a ON a.h = x JOIN prints b ON b.h = y WHERE x < y OR a.id < b.id)"""


@operator("jn_10")
def near_pairs(d):
    return f"WITH {near(d)} SELECT a, b FROM near"


@plan("jn_10")
def _(spark):
    if not one_row_an_item(spark):
        return spark.sql(near_pairs(Spark()))
    view_links(spark)
    return spark.sql("""WITH l AS (SELECT x, y FROM links UNION ALL SELECT h, h FROM first WHERE n > 1)
SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM l JOIN prints a ON a.h = x JOIN prints b ON b.h = y WHERE x < y OR a.id < b.id""")


@operator("ir_16")
def exact_first(d):
    x = d.sha256(f"trim({d.replace('lower(content)', chr(92) + 's+', ' ')})")
    return f"WITH {corpus(d)}, k AS (SELECT id, row_number() OVER (PARTITION BY {x} ORDER BY id) AS rn FROM corpus) SELECT id FROM k WHERE rn = 1"


@operator("gr_1")
def edges(d):
    return f"WITH {edge_list()} SELECT src, dst FROM edges"


def edge_list() -> str:
    """A link graph: every supplier to part of lineitem, keys as nodes, without self loops or repeats."""
    return "edges AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey <> l_partkey)"


@operator("gr_6")
def first_of_host(d):
    return f"WITH k AS (SELECT url, {host(d, 'url')} AS host, row_number() OVER (PARTITION BY {host(d, 'url')} ORDER BY page_id) AS rn FROM pages) SELECT host, url FROM k WHERE rn = 1"


@operator("gr_7")
def base_urls(d):
    return f"SELECT DISTINCT concat({d.first('url', '^([a-z]+://[^/]+)', 1)}, '/') AS base FROM pages"


@operator("agg_7")
def one_pass_rank(d):
    r = """WITH o AS (SELECT l_suppkey AS s, count(*) AS n FROM lineitem GROUP BY l_suppkey), r AS (SELECT l_partkey AS p, sum(floor(1000000000e0 / n)) AS r FROM lineitem JOIN o ON l_suppkey = s GROUP BY l_partkey)"""
    if d.name == "spark":  # reals where the statement has them, as Spark would take decimals; the maximum as a row, not a window of one task
        return f"{r}\nSELECT p, {micro('100e0 * cast(r AS double) / top')} AS rank FROM r CROSS JOIN (SELECT cast(max(r) AS double) AS top FROM r)"
    return f"""{r}
SELECT p, {micro('100.0 * r / max(r) OVER ()')} AS rank FROM r"""
