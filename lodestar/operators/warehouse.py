"""Upserts, retention, statistics, ordering, set operations, federation and keyed state over tables."""

from __future__ import annotations

from lodestar.operators.dialect import corpus, micro, operator
from lodestar.operators.lexicon import PROVIDER_WEIGHTS
from lodestar.operators.urls import host

Q: dict[str, str] = {
    # scans and sinks
    # upserts by key
    # filters
    # joins
    "jn_12": "WITH t AS (SELECT conv_id, turn, {bag} AS b FROM conversations) SELECT a.conv_id, a.turn AS t1, b.turn AS t2 FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE {overlap} * 100 >= 20 * greatest({union}, 1)",
    # aggregates
    # windows
    # ordering
    # sets
    "set_6": "SELECT doc_id, CASE WHEN quality = 1 THEN 'human' ELSE 'slop' END AS side FROM labels",
    # registry of remaining functions
    "rem_10": "SELECT max(event_id) AS latest FROM events",
    # keyed state as it stands after all events
}


def _fill(d, sql: str) -> str:
    bag = d.distinct(d.all("lower(text)", "[a-z]{3,}"))
    common = d.size(d.common("a.b", "b.b"))
    parts = {"corpus": corpus(d), "host": host(d, "url"), "bag": bag, "overlap": common, "union": f"({d.size('a.b')} + {d.size('b.b')} - {common})"}
    for k, v in parts.items():
        sql = sql.replace("{" + k + "}", v)
    return sql


for _name, _sql in Q.items():
    operator(_name)(lambda d, sql=_sql: _fill(d, sql))


@operator("fed_4")
def federated_score(d):
    """Provider weight, lexical relevance and freshness of each result."""
    weights = d.values("w", "provider, weight", [[f"'{k}'", f"{v}e0"] for k, v in PROVIDER_WEIGHTS.items()])
    names = list(PROVIDER_WEIGHTS)
    pick = "CASE doc_id % 21 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " ELSE 'other' END"
    return f"""WITH {weights}, r AS (SELECT doc_id AS id, {pick} AS provider, (CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'und') THEN 1 ELSE 0 END) / 2.0 AS lex FROM documents)
SELECT id, {micro('coalesce(weight, 0.7) * (0.60 + 0.40 * least(1.0, lex))')} AS score FROM r LEFT JOIN w ON r.provider = w.provider"""
