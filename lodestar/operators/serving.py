"""Connectors, federation, answer selection, ranking metrics and remaining keyed updates."""

from __future__ import annotations

from lodestar.operators.dialect import Spark, corpus, micro, one_row_an_item, operator, plan
from lodestar.operators.retrieval import associations, bm25, near, printed, prints, ranked, view_links
from lodestar.operators.text import sentences, tokens, words
from lodestar.operators.urls import dated, host, path
from lodestar.operators.warehouse import _fill

Q: dict[str, str] = {
    "jn_17": "WITH s AS (SELECT lower(p_type) AS q, min(p_partkey) AS first FROM part GROUP BY lower(p_type)), t AS (SELECT lower(p_name) AS q, min(p_partkey) AS id FROM part GROUP BY lower(p_name)) SELECT s.q, s.first, coalesce(t.id, -1) AS id FROM s LEFT JOIN t ON s.q = t.q",
    "gr_8": "SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 10 WHEN s_nationkey % 2 = 0 THEN 8 ELSE 5 END AS priority FROM supplier ORDER BY priority DESC, s_nationkey, s_suppkey LIMIT 30",
    "gr_9": "WITH k AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_partkey), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) AS rn FROM k) SELECT l_suppkey, l_partkey FROM r WHERE rn <= 4",
    "rem_7": "SELECT count(*) AS total, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS failed, count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS done FROM lineitem",
    "rem_8": "SELECT o_orderpriority, count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) * 1000 / count(*) >= 900 AS nearly FROM orders GROUP BY o_orderpriority",
    "rem_25": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type HAVING count(*) > 1",
}

for _name, _sql in Q.items():
    operator(_name)(lambda d, sql=_sql: _fill(d, sql))


def hits(d) -> str:
    """Search hits as JSON text, one a document."""
    quote = '\'{"id": \''
    return f"""hits AS (SELECT doc_id AS id, concat({quote}, cast(doc_id AS string), ', "points": ', cast(n_chars AS string), ', "author": "', source, '", "tags": "', lang, '", "epoch": ', cast(1600000000 + doc_id * 86400 AS string), CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat(', "url": "https://x.example/', cast(doc_id AS string), '"') END, '}}') AS j FROM documents)"""


@operator("con_1")
def thread_hits(d):
    return f"""WITH {hits(d)} SELECT id, coalesce({d.json('j', 'url')}, concat('https://threads.example/item?id=', {d.json('j', 'id')})) AS url,
concat_ws(' · ', concat({d.json('j', 'points')}, ' points'), {d.json('j', 'author')}) AS snippet FROM hits"""


@operator("con_2")
def question_hits(d):
    day = "date_add(DATE '1970-01-01', cast(floor(cast(e AS bigint) / 86400) AS int))" if d.name == "spark" else "(DATE '1970-01-01' + (e::BIGINT // 86400)::INT)"
    return f"WITH {hits(d)}, e AS (SELECT id, {d.json('j', 'epoch')} AS e, {d.json('j', 'tags')} AS tags FROM hits) SELECT id, cast({day} AS string) AS published, tags FROM e"


@operator("con_3")
def article_hits(d):
    return f"WITH {corpus(d)} SELECT id, concat('https://wiki.example/', {d.replace('title', ' ', '_')}) AS url, {d.replace('title', '<[^>]+>', '')} AS title FROM corpus"


@operator("con_4")
def index_hits(d):
    last = d.replace(d.first(path(d, "url"), "([^/]+)/?$", 1), r"[-_.]+", " ")
    return f"SELECT page_id, {last} AS title FROM pages"


@operator("con_19")
def truncated(d):
    return f"WITH {corpus(d)}, s AS (SELECT id, trim({d.replace(d.replace('content', '<[^>]+>', ''), '&amp;', '&')}) AS t FROM corpus) SELECT id, CASE WHEN length(t) <= 120 THEN t ELSE concat({d.replace('substr(t, 1, 120)', r'\s+\S*\z', '')}, '…') END AS t FROM s"


@operator("jsn_6")
def abstract_rebuild(d):
    """Word to places and back: the first 400 characters' words again in order."""
    w = d.each("id", "c", "ws", "w", "pos")
    return f"WITH {corpus(d)}, c AS (SELECT id, {words(d, 'substr(content, 1, 400)')} AS ws FROM corpus), w AS ({w}), p AS (SELECT id, w, pos FROM w GROUP BY id, w, pos) SELECT id, {d.join(d.gather('w', 'pos'))} AS abstract FROM p GROUP BY id"


@operator("str_12")
def synonyms(d):
    t = d.values("s", "word, other, place", [["'the'", "'this'", "1"], ["'the'", "'that'", "2"], ["'und'", "'sowie'", "1"], ["'de'", "'du'", "1"]])
    w = d.each("id", "c", "ws", "w", "pos")
    return f"WITH {t}, {corpus(d)}, c AS (SELECT id, {d.all('lower(title)', '[a-z]+')} AS ws FROM corpus), w AS ({w}) SELECT DISTINCT id, other FROM w JOIN s ON word = w WHERE place <= 3"


@operator("str_16")
def processed(d):
    return f"WITH {corpus(d)}, t AS (SELECT id, lower(trim(title)) AS normal, {tokens(d, 'title')} AS ts FROM corpus) SELECT id, normal, {d.size('ts')} AS n_tokens, {d.join('ts', ' OR ')} AS expression FROM t"


@operator("str_30")
def sizes(d):
    return f"SELECT doc_id, CASE WHEN n_chars < 1024 THEN concat(cast(n_chars AS string), ' B') WHEN n_chars < 1048576 THEN concat(cast(cast(floor(n_chars / 1024e0) AS bigint) AS string), ' KB') ELSE 'MB' END AS size FROM documents"


@operator("str_31")
def featured(d):
    """The first result whose title holds the query, else the first with 0.6 of its words and 60 characters of snippet."""
    return f"""WITH {corpus(d)}, r AS (SELECT id, CASE WHEN contains(lower(title), 'the') THEN 1 WHEN (CASE WHEN contains(lower(content), 'the ') THEN 1 ELSE 0 END + CASE WHEN contains(lower(content), 'ing ') THEN 1 ELSE 0 END) >= 1.2 AND length(content) >= 60 THEN 2 END AS tier FROM corpus)
SELECT id, tier FROM r WHERE tier IS NOT NULL ORDER BY tier, id LIMIT 1"""


@operator("str_32")
def also_asked(d):
    """Best answer a question: title hits count 2, body hits 1; at least half, answers of 40 characters or more."""
    q = d.values("q", "qid, a, b", [["1", "'the'", "'and'"], ["2", "'der'", "'und'"], ["3", "'les'", "'des'"]])
    score = " + ".join(f"CASE WHEN contains(lower(title), {x}) THEN 2 WHEN contains(lower(content), {x}) THEN 1 ELSE 0 END" for x in "ab")
    return f"""WITH {q}, {corpus(d)}, r AS (SELECT qid, id, {score} AS score, row_number() OVER (PARTITION BY qid ORDER BY {score} DESC, id) AS rn FROM corpus CROSS JOIN q WHERE length(content) >= 40)
SELECT qid, id, score FROM r WHERE rn = 1 AND score >= 2"""


@operator("ir_8")
def expansion(d):
    return f"WITH {associations(d)} {EXPANDED}"


EXPANDED = "SELECT term, related FROM k WHERE rn <= 3"
plan("ir_8")(ranked(expansion, EXPANDED))


@operator("ir_11")
def related(d):
    """Title words by the sum of 1 / (1 + 0.4 rank), from two titles on."""
    w = d.each("id, rn", "c", "ws", "w", "pos")
    return f"""WITH {corpus(d)}, c AS (SELECT id, row_number() OVER (ORDER BY quality DESC, id) - 1 AS rn, {d.distinct(tokens(d, 'title'))} AS ws FROM (SELECT * FROM corpus ORDER BY quality DESC, id LIMIT 60) t), w AS ({w})
SELECT w, count(*) AS n, cast(sum(floor(1000000000 / (1 + 0.4e0 * rn))) AS bigint) AS score FROM w GROUP BY w HAVING count(*) >= 2"""


@operator("ir_14b")
def structure(d):
    marks = d.count("content", r"(^|\n)#{1,3}\s+[0-9]+[.)]\s+") + " + " + d.count("content", r"(^|\n)[*][*]Step [0-9]+") + " + " + d.count("content", r"(^|\n)-+ Step [0-9]+")
    form = d.count("content", r"(^|\n)\|\s+.*\s+\|\s+.*\s+\|") + " + " + d.count("content", r"(^|\n)#{1,2}\s+(Introduction|Conclusion|Summary|Overview|FAQ)")
    plat = d.matches("content", "(?i)powered by (openai|chatgpt|claude|gemini|copilot)|(ai|artificial intelligence)[ -]generated")
    return f"WITH {corpus(d)}, m AS (SELECT id, {marks} AS marks, {form} AS forms, {plat} AS platform FROM corpus) SELECT id, {micro('least(0.08 * marks, 0.25) + CASE WHEN forms >= 3 THEN 0.15 ELSE 0 END + CASE WHEN platform THEN 0.35 ELSE 0 END')} AS score FROM m"


@operator("ir_14c")
def vocabulary(d):
    w = d.map(words(d, "content"), "lower(x)")
    return f"WITH {corpus(d)}, v AS (SELECT id, {d.size(w)} AS n, {d.size(d.distinct(w))} AS u FROM corpus) SELECT id, CASE WHEN n >= 10 AND u < 0.3 * n THEN 120000 ELSE 0 END AS score FROM v"


@operator("ir_17")
def near_earlier(d):
    return f"WITH {near(d)} SELECT b AS id, min(a) AS first_near FROM near GROUP BY b"


@plan("ir_17")
def _(spark):
    """The first item near one is the first of its own fingerprint's or a linked one's first items, so copies are not paired."""
    if not one_row_an_item(spark):
        return spark.sql(near_earlier(Spark()))
    view_links(spark)
    return spark.sql("""WITH l AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links UNION ALL SELECT h, h FROM first),
m AS (SELECT x AS h, min(id) AS first_near FROM l JOIN first ON h = y GROUP BY x)
SELECT id, first_near FROM prints JOIN m ON prints.h = m.h WHERE first_near < id""")


@operator("mth_5")
def bands(d):
    return f"WITH {prints(d)} {_bands(d)}"


def _bands(d) -> str:
    cols = ", ".join(f"{d.shift_and('h', 8 * i, 255)} AS b{i}" for i in range(8))
    return f"SELECT id, {cols} FROM prints"


plan("mth_5")(printed(bands, _bands(Spark())))


@operator("mth_7")
def blend(d):
    return f"WITH {bm25(d, ['les', 'est'])}, t AS (SELECT max(score) AS top FROM scored) SELECT id, {micro('0.50 * score / top + 0.20 * 0.5 + 0.15 * 0.5 + 0.15 * 0.5')} AS score FROM scored CROSS JOIN t"


@operator("win_5")
def normalised(d):
    return f"WITH {bm25(d, ['que'])} SELECT id, {micro('score / max(score) OVER ()')} AS share FROM scored"


@operator("mth_8")
def overall(d):
    return f"WITH {corpus(d)} SELECT id, {micro('0.35 * quality + 0.25 * 0.5 + 0.15 * 0.5 + 0.15 * least(1.0, length(content) / 5000e0) + 0.10 * 1.0')} AS overall FROM corpus"


@operator("win_6")
def best_sentences(d):
    """The three longest sentences in text order."""
    s = d.each("id", "c", "ss", "s", "pos")
    return f"WITH {corpus(d)}, c AS (SELECT id, {sentences(d, 'content')} AS ss FROM corpus), s AS ({s}), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(s) DESC, pos) AS rn FROM s) SELECT id, md5({d.join(d.gather('s', 'pos'))}) AS digest FROM k WHERE rn <= 3 GROUP BY id"


@operator("win_7")
def discounted(d):
    return f"WITH k AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS rel, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) SELECT conv_id, {micro('sum(rel / log2(rn + 1e0))')} AS dcg FROM k GROUP BY conv_id"


@operator("win_8")
def reciprocal(d):
    return "WITH k AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) SELECT conv_id, coalesce(min(CASE WHEN role = 'assistant' THEN rn END), 0) AS first_hit FROM k GROUP BY conv_id"


@operator("set_4")
def overlap(d):
    a = d.distinct(d.all("lower(title)", "[a-z]+"))
    b = d.distinct(d.all("lower(content)", "[a-z]+"))
    return f"WITH {corpus(d)} SELECT id, {d.size(d.common(a, b))} AS common, {d.size(b)} AS n FROM corpus"


@operator("fed_3")
def lexical(d):
    return f"WITH {corpus(d)} SELECT id, {micro('(CASE WHEN contains(lower(title), ' + d.s('the') + ') THEN 1 ELSE 0 END + CASE WHEN contains(lower(title), ' + d.s('and') + ') THEN 1 ELSE 0 END) / 2e0')} AS title_score FROM corpus"


@operator("fed_5")
def federated(d):
    """Screen, first of each title, score, sort, diversify two a host in the first ten, page of twenty."""
    return f"""WITH {corpus(d)}, s AS (SELECT id, lower(trim(title)) AS t, {host(d, 'url')} AS host, quality * 0.6 + CASE WHEN contains(lower(title), 'the') THEN 0.4e0 ELSE 0 END AS score FROM corpus WHERE {host(d, 'url')} <> 'src5.example'),
u AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY id) AS seen FROM s), r AS (SELECT id, host, row_number() OVER (ORDER BY score DESC, id) - 1 AS idx FROM (SELECT * FROM u WHERE seen = 1 ORDER BY score DESC, id LIMIT 100) x),
k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY idx) AS rn FROM r), o AS (SELECT id, row_number() OVER (ORDER BY CASE WHEN idx < 10 AND rn > 2 THEN 1 ELSE 0 END, idx) AS place FROM k)
SELECT id, place FROM o WHERE place <= 20"""


@operator("fil_27")
def dictionary_query(d):
    return f"WITH {corpus(d)} SELECT id, {d.matches('lower(title)', '^(define |meaning of |what does )?[a-z]{2,24}[.]?$')} AS is_word FROM corpus"


@operator("jn_15")
def lookup(d):
    return f"WITH {associations(d)} {LOOKED_UP}"


LOOKED_UP = "SELECT term AS x, related AS y, n FROM k WHERE term IN ('with', 'eine', 'tion', 'that', 'mente') AND rn <= 8"
plan("jn_15")(ranked(lookup, LOOKED_UP))
