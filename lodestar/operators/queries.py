"""The query language as columns: operators, chips, spelling, interpretation.

parse() reads a column of raw queries into a struct; the rest takes its fields. All of it is row-local.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.rowwise import let
from lodestar.operators.lexicon import SERVING_SPELLING, SPELLING

TOKEN = r'-?"[^"]*"|\S+'
KEYED = r"(?i)^(site|filetype|after|before):(.+)$"


def _bare(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, '^"|"$', ""))


def whole_date(value: Column, end: bool) -> Column:
    """A partial date brought to a day, the first or the last; empty where it is none."""
    v = F.trim(value)
    return (
        F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), v)
        .when(v.rlike(r"^\d{4}-\d{2}$"), F.concat(v, F.lit("-31" if end else "-01")))
        .when(v.rlike(r"^\d{4}$"), F.concat(v, F.lit("-12-31" if end else "-01-01")))
        .otherwise("")
    )


def _read(token: Column) -> Column:
    """(kind, value) of a token; kind is empty for what is dropped."""
    pair = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))

    def kinds(t):
        minus, body, inner, key, value, after, before = (t[k] for k in ("minus", "body", "inner", "key", "value", "after", "before"))
        quoted = body.startswith('"') & body.endswith('"') & (F.length(body) >= 2)
        return (
            F.when(minus & (inner != ""), pair("exclude", F.lower(inner)))
            .when((key != "") & (value == ""), pair("", F.lit("")))
            .when(key == "site", pair("site", F.regexp_replace(F.regexp_replace(F.lower(value), r"^www\.", ""), "/+$", "")))
            .when(key == "filetype", pair("filetype", F.regexp_replace(F.lower(value), r"^\.", "")))
            .when((key == "after") & (after != ""), pair("after", after))
            .when((key == "before") & (before != ""), pair("before", before))
            .when(quoted & (inner == ""), pair("", F.lit("")))
            .when(quoted, pair("phrase", inner))
            .otherwise(pair("term", body))
        )

    def parts(t):
        keyed = F.when(F.contains(t["body"], F.lit(":")), F.regexp_extract(t["body"], KEYED, 1)).otherwise("")
        return let(F.struct(t["minus"].alias("minus"), t["body"].alias("body"), F.lower(keyed).alias("key"), F.when(keyed != "", _bare(F.regexp_extract(t["body"], KEYED, 2))).otherwise("").alias("value")), dated)

    def dated(t):
        after = F.when(t["key"] == "after", whole_date(t["value"], False)).otherwise("")
        before = F.when(t["key"] == "before", whole_date(t["value"], True)).otherwise("")
        return let(F.struct(*[t[k].alias(k) for k in ("minus", "body", "key", "value")], _bare(t["body"]).alias("inner"), after.alias("after"), before.alias("before")), kinds)

    minus = token.startswith("-") & (F.length(token) > 1)
    return let(F.struct(minus.alias("minus"), F.when(minus, F.substring(token, 2, 1 << 20)).otherwise(token).alias("body")), parts)


def parse(raw: Column) -> Column:
    """Struct of phrases, exclude, terms, site, filetype, after, before, cleaned and active; of a repeated operator the last holds."""
    read = F.transform(F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(TOKEN), F.lit(0)), _read)

    def fields(r):
        every = lambda kind: F.transform(F.filter(r, lambda x: x["kind"] == kind), lambda x: x["value"])
        last = lambda kind: F.coalesce(F.try_element_at(every(kind), F.lit(-1)), F.lit(""))
        named = {"phrases": every("phrase"), "exclude": every("exclude"), "terms": every("term"), "site": last("site"), "filetype": last("filetype"), "after": last("after"), "before": last("before")}
        cleaned = F.trim(F.array_join(F.concat(named["phrases"], named["terms"]), " "))
        return F.struct(*[v.alias(k) for k, v in named.items()], cleaned.alias("cleaned"), F.exists(r, lambda x: ~x["kind"].isin("", "term")).alias("active"))

    return F.transform(F.array(read), fields)[0]


def chips(ops: Column) -> Column:
    """A label for each operator, in fixed order."""
    return let(ops, _chips)


def _chips(ops: Column) -> Column:
    one = lambda name: F.when(ops[name] != "", F.array(F.concat(F.lit(f"{name}:"), ops[name]))).otherwise(F.array().cast("array<string>"))
    return F.concat(one("site"), one("filetype"), F.transform(ops["phrases"], lambda p: F.concat(F.lit('"'), p, F.lit('"'))), F.transform(ops["exclude"], lambda e: F.concat(F.lit("-"), e)), one("after"), one("before"))


def remove_chip(raw: str, kind: str, value: str) -> str:
    """A raw query without one of its operators."""
    v = re.escape(value)
    pattern = {
        "site": rf'site:\s*"?(?:www\.)?{v}\S*"?', "filetype": rf'filetype:\s*"?\.?{v}"?', "phrase": f'"{v}"',
        "exclude": rf'-\s*"{v}"' if re.search(r"\s", value) else rf"-{v}\b", "after": rf"after:\s*{v}", "before": rf"before:\s*{v}",
    }[kind]
    return " ".join(re.sub(pattern, "", raw, flags=re.I).split())


def _known(table: dict[str, str]) -> Column:
    return F.array(*[F.lit(v) for v in dict.fromkeys(table.values())])


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def closest(word: Column, table: dict[str, str] = SPELLING) -> Column:
    """The nearest known word within two edits and under 0.4 of the length, the first of equals; null if none is."""
    likely = F.filter(_known(table), lambda k: F.abs(F.length(k) - F.length(word)) <= 2)  # each edit changes the length by one at most
    tried = F.transform(likely, lambda k: F.struct(F.levenshtein(word, k, 2).alias("d"), F.array_position(_known(table), k).alias("i"), k.alias("k")))
    return F.array_min(F.filter(tried, lambda x: (x["d"] >= 0) & (x["d"] < F.length(word) * 0.4)))["k"]


def correct_words(words: Column, table: dict[str, str] = SPELLING) -> Column:
    """Each word by the table, else, from four letters on, by the nearest known word."""
    fixed = _map(table)
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(fixed, w), F.when(F.length(w) > 3, closest(w, table)), w))


def exact_correction(query: Column, table: dict[str, str] = SERVING_SPELLING) -> Column:
    """The whole query by the table, else with the first two words in a row that it has replaced; null without a hit."""
    return let(F.trim(F.regexp_replace(F.lower(query), r"\s+", " ")), lambda q: let(F.split(q, " "), lambda words: _exact(q, words, table)))


def _exact(q: Column, words: Column, table: dict[str, str]) -> Column:
    fixed = _map(table)
    hit = lambda x: F.when(F.try_element_at(fixed, x) != x, F.try_element_at(fixed, x))
    n = F.size(words)
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(i.alias("i"), hit(F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1))).alias("to"))))
    rest = lambda a, size: F.array_join(F.slice(words, a, size), " ")
    put = lambda first: F.concat_ws(" ", F.nullif(rest(F.lit(1), first["i"] - 1), F.lit("")), first["to"], F.nullif(rest(first["i"] + 2, F.greatest(n - first["i"] - 1, F.lit(0))), F.lit("")))
    by_pair = let(F.try_element_at(F.filter(pairs, lambda p: p["to"].isNotNull()), F.lit(1)), lambda first: F.when(first.isNotNull(), put(first)))
    return F.when(q == "", None).otherwise(F.coalesce(hit(q), by_pair))


def did_you_mean(query: Column, table: dict[str, str] = SERVING_SPELLING) -> Column:
    """A better query, or null where every word looks right."""

    def by_words(query):
        q = F.trim(F.lower(query))
        words = F.filter(F.split(q, r"\s+"), lambda w: w != "")
        better = let(words, lambda ws: let(F.array_join(correct_words(ws, table), " "), lambda fixed: F.when((F.size(ws) > 0) & (fixed != F.array_join(ws, " ")) & (fixed != q), fixed)))
        return F.coalesce(exact_correction(query, table), better)

    return let(query, by_words)


def interpretation(expanded: Column, tokens: Column) -> Column:
    """What an expansion adds to the query's own words."""
    return F.array_except(expanded, tokens)
