"""Statistics of one text or array as column expressions, without a shuffle; measured() has those of a text in one pass of Python."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.batches import column

#: Fixed value: every character that counts as white space.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def words(text: Column) -> Column:
    """Runs between white space; an empty text has none."""
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def pieces(text: Column, pattern: str, longer_than: int) -> Column:
    """Stripped parts between matches of `pattern` that have more characters than that."""
    return F.filter(F.transform(F.split(text, pattern), strip), lambda x: F.length(x) > longer_than)


def tally(values: Column) -> Column:
    """How often each distinct value occurs, in the values' order; an empty array gives an empty array."""

    def runs(s):
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
        return let(starts, lambda p: F.transform(p, lambda x, k: F.coalesce(F.get(p, k + 1), F.size(s)) - x))

    return let(F.sort_array(values), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(F.array().cast("array<int>")))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def entropy(text: Column) -> Column:
    """Bits a character over the letters and digits, cases joined; 0 without any."""
    signs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]"), F.lit(0))

    def bits(counts):
        return let(total(counts), lambda n: -total(F.transform(counts, lambda c: c / n * F.log2(c / n))))

    return let(tally(signs), lambda c: F.when(F.size(c) > 0, bits(c)).otherwise(0.0))


def variation(lengths: Column) -> Column:
    """Standard deviation over mean; null where the mean is 0 or there is no length."""

    def spread(n, mean):
        return F.sqrt(total(F.transform(n, lambda x: (x - mean) * (x - mean))) / F.size(n)) / mean

    return let(lengths, lambda n: let(F.try_divide(total(n), F.size(n)), lambda m: F.when(m > 0, spread(n, m))))


def uniformity(parts: Column) -> Column:
    """One less the variation of the parts' word counts, at least 0; 0 for fewer than three parts."""
    return let(parts, lambda p: F.when(F.size(p) >= 3, F.greatest(F.lit(0.0), 1 - F.coalesce(variation(F.transform(p, lambda x: F.size(words(x)))), F.lit(1.0)))).otherwise(0.0))


def burstiness(sentences: Column) -> Column:
    """Variation of the sentences' word counts; 0.5 for fewer than four."""
    return let(sentences, lambda p: F.when(F.size(p) >= 4, F.coalesce(variation(F.transform(p, lambda x: F.size(words(x)))), F.lit(0.5))).otherwise(0.5))


def repetition(ws: Column) -> Column:
    """Share of the distinct three-word runs that occur three times or more; 0 below twenty words."""
    grams = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.array_join(F.slice(ws, i + 1, 3), " "))
    return F.when(F.size(ws) >= 20, let(tally(grams), lambda c: F.size(F.filter(c, lambda x: x > 2)) / F.size(c))).otherwise(0.0)


def richness(ws: Column) -> Column:
    """Distinct words over words; 0.5 below ten words."""
    return F.when(F.size(ws) >= 10, F.size(F.array_distinct(ws)) / F.size(ws)).otherwise(0.5)


def same_start(sentences: Column) -> Column:
    """Share of the commonest first three words among sentences; 0 for fewer than four."""
    starts = F.transform(sentences, lambda x: F.array_join(F.slice(words(F.lower(x)), 1, 3), " "))
    return F.when(F.size(sentences) >= 4, F.array_max(tally(starts)) / F.size(sentences)).otherwise(0.0)


def compression(text: Column) -> Column:
    """Bytes of the zlib form at level 6 over bytes of the text; 0.5 below 200 bytes or for null."""

    return column(lambda texts: [_ratio(t) for t in texts], "double")(text)


def needles(pattern: str) -> list[list[str]]:
    """Lower-case strings that a match of `pattern`, letters in either case, must hold: at least one of each list."""
    from re import _constants as k
    from re import _parser

    def of(items) -> list[list[str]]:
        found, run = [], ""
        for op, arg in [*items, (None, None)]:
            if op is k.LITERAL:
                run += chr(arg).lower()
                continue
            found, run = found + [[run]] * bool(run), ""
            if op is k.SUBPATTERN:
                found += of(arg[3])
            elif op in (k.MAX_REPEAT, k.MIN_REPEAT) and arg[0]:
                found += of(arg[2])
            elif op is k.IN and all(kind is k.LITERAL for kind, _ in arg):
                found.append([chr(x).lower() for _, x in arg])
            elif op is k.BRANCH:
                ways = [max(of(way), key=lambda f: min(map(len, f)), default=None) for way in arg[1]]
                found += [sum(ways, [])] if all(ways) else []
        return found

    least = lambda f: min(map(len, f))
    found = sorted(of(_parser.parse(pattern)), key=lambda f: (-least(f), len(f)))
    return [f for f in found if least(f) > 1] or found


def folded(text: str) -> str:
    """Lower case, and a plain letter for each other sign that Java takes for one when cases are joined."""
    low = text.lower()
    return low if low.isascii() else low.replace("i\u0307", "i").replace("\u0131", "i").replace("\u017f", "s")


def _sieve(patterns: list[str]):
    """From a text to a truth value for each pattern: whether it may match, letters in either case; a false one is certain."""
    sets = [needles(p) for p in patterns]

    def may(text: str) -> list[bool]:
        low = folded(text)
        return [all(any(x in low for x in some) for some in every) for every in sets]

    return may


def possible(text: Column, patterns: list[str]) -> Column:
    """The sieve's array for each text."""

    def may(texts):
        sieve = _sieve(patterns)
        return [sieve(t or "") for t in texts]

    return column(may, "array<boolean>")(text)


def _ratio(t: str | None) -> float:
    data = t.encode() if t else b""
    return 0.5 if len(data) < 200 else len(zlib.compress(data, 6)) / len(data)


def _variation(n: list[int]) -> float | None:
    mean = sum(n) / len(n) if n else 0.0
    return math.sqrt(sum((x - mean) * (x - mean) for x in n) / len(n)) / mean if mean > 0 else None


def _even(parts: list[str]) -> float:
    if len(parts) < 3:
        return 0.0
    v = _variation([len(x.split()) for x in parts])
    return max(0.0, 1 - (1.0 if v is None else v))


SENTENCE = re.compile("[.!?]+")
QUOTED_YEAR = re.compile(r"\[\d+\]|\(\d{4}\)")
MEASURED = "n int, entropy double, sentences double, paragraphs double, repetition double, richness double, syntax double, facts int, transitions int, hedges int, burstiness double, compression double"


def _measure(t: str, low: str, transitions: frozenset, hedges: list[str]) -> tuple:
    signs = [c for _, c in sorted((s, c) for s, c in Counter(low).items() if unicodedata.category(s)[0] in "LN")]
    total = sum(signs)
    bits = -sum(c / total * (math.log(c / total) / math.log(2)) for c in signs) if signs else 0.0
    ws, lows = t.split(), low.split()
    pieces = [x for x in map(str.strip, SENTENCE.split(t)) if len(x) > 5]
    spread = _variation([len(x.split()) for x in pieces]) if len(pieces) >= 4 else 0.5
    grams = Counter(zip(lows, lows[1:], lows[2:])).values() if len(lows) >= 20 else ()
    longer = [x for x in pieces if len(x) > 10]
    starts = Counter(tuple(x.lower().split(None, 3)[:3]) for x in longer).values() if len(longer) >= 4 else ()
    facts = sum(1 if w[0].isdecimal() or w[0] in "\"'" else 2 * bool(w[0] in "[(" and QUOTED_YEAR.match(w)) for w in ws)
    return (
        len(ws), bits, _even(pieces), _even([x for x in map(str.strip, t.split("\n\n")) if len(x) > 20]), sum(n > 2 for n in grams) / len(grams) if grams else 0.0,
        len(set(lows)) / len(lows) if len(lows) >= 10 else 0.5, max(starts) / len(longer) if starts else 0.0, facts,
        sum(w.rstrip(",.") in transitions for w in lows), sum(low.count(h) for h in hedges), 0.5 if spread is None else spread, _ratio(t),
    )


def measured(text: Column, patterns: list[str], transitions: list[str], hedges: list[str]) -> Column:
    """Struct MEASURED of a stripped text, and `may`, an array with a truth value for each pattern that may match; a false one is certain."""

    names, linking = [x.split()[0] for x in MEASURED.split(", ")], frozenset(transitions)

    def read(texts):
        sieve = _sieve(patterns)
        return [dict(zip([*names, "may"], (*_measure(t, t.lower(), linking, hedges), sieve(t)), strict=True)) for t in texts]

    kinds = ", ".join(x.replace(" ", ": ", 1) for x in (MEASURED + ", may array<boolean>").split(", "))
    return column(read, f"struct<{kinds}>")(text)
