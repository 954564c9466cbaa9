"""Secret scan: base patterns plus a linear-chain conditional random field.

Tokens (runs of letters, digits, _ + / -, and single other characters) are tagged B, I or O from
their shape, the neighbouring words and features of the file, decoded by Viterbi over the whole text. The field
is fitted on the driver to templates with known spans, alone and inside prose, and to a bounded sample of the
corpus (`train`), above all to places where a first fit finds spans. What the base patterns don't mark in the
sample counts as no secret. Spans that the field finds beside the base ones are added.

Decoding is exact: a token can only be tagged B or I if some run of tokens around it could gain over O by an
upper bound of its emissions and transitions. Running sums give that bound for all tokens at once; Viterbi then
works on the runs that remain, with O on either side.

Defined cases: null and empty texts have no spans; overlapping kinds are all reported; repeated rows are
reported each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import annotate, fresh

KINDS = ("assign", "access", "hex", "crf")
#: Fixed patterns of the contract, with the least length of what must be long.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
FIELDS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

#: Word classes by a part of the lower-cased token.
HINTS = (
    (b"passw", 1), (b"passphrase", 1), (b"pwd", 1), (b"secret", 2), (b"token", 2), (b"apikey", 3), (b"api_key", 3), (b"access_key", 3), (b"private_key", 3),
    (b"bearer", 4), (b"authorization", 4), (b"credential", 4), (b"akia", 5), (b"ghp_", 5), (b"sk_live", 5), (b"xox", 5), (b"eyj", 5),
    (b"sha256", 6), (b"sha1", 6), (b"md5", 6), (b"checksum", 6), (b"commit", 6), (b"digest", 6), (b"uuid", 6), (b"phone", 6), (b"order", 6),
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping within a kind."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(m.start(), m.end(), 2) for m in HEX_LONG.finditer(text)]


#: The runs of HEX that are long enough: a run is matched whole or not at all.
HEX_LONG = re.compile("[0-9a-f]{32,}")

# character classes: 0 space, 1 lower, 2 upper, 3 digit, 4 symbol inside tokens, 5 beyond ASCII, 6 punctuation, 7 line end
CLASS = np.full(256, 6, np.uint8)
CLASS[[32, *range(9, 14)]] = 0
CLASS[10] = 7
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 1, 2, 3, 5
CLASS[[ord(c) for c in "_+/-"]] = 4
HEX_BYTE = np.isin(np.arange(256), [ord(c) for c in "0123456789abcdefABCDEF"])
PUNCT = {c: i + 1 for i, c in enumerate(b"\"'=:.,@<>()\n")}

N_SHAPE, N_SWITCH, N_HINT, N_NEAR, N_FILE = 7 * 64 + 16, 4, 7, 12, 6
GROUPS = {"shape": N_SHAPE, "switch": N_SWITCH, "own": N_HINT, "p1": N_HINT, "p2": N_HINT, "p3": N_HINT, "p4": N_HINT, "n1": N_NEAR, "b1": N_NEAR, "b2": N_NEAR, "file": N_FILE}
TAGS = 3  # O, B, I
MARKS = np.array([PUNCT.get(b, 0) for b in range(256)])


@lru_cache(1)
def _hints():
    import ahocorasick

    found = ahocorasick.Automaton()
    for h, k in HINTS:
        found.add_word(h.decode(), (len(h), k))
    found.make_automaton()
    return found


class Tokens:
    """Tokens of some texts (UTF-8 bytes) laid end to end, with their feature numbers."""

    def __init__(self, texts: list[bytes]):
        joined = b" ".join(texts) + b" "
        self.text_starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
        data = np.frombuffer(joined, np.uint8)
        c = CLASS[data]
        inside = (c >= 1) & (c <= 5)
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[:1].any():
            edge = np.append(0, edge)
        alone = np.flatnonzero(c >= 6)
        self.start = np.concatenate([edge[0::2], alone])
        order = np.argsort(self.start, kind="stable")
        self.start, self.end = self.start[order], np.concatenate([edge[1::2], alone + 1])[order]
        self.n = n = len(self.start)
        self.doc = np.searchsorted(self.text_starts, self.start, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))  # each text's first token, and the end
        if not n:
            return
        size = self.end - self.start

        def count(mask):
            total = np.zeros(len(data) + 1, np.int32)
            np.cumsum(mask, out=total[1:])
            return total[self.end] - total[self.start]

        digits, lower, upper, symbol, other = (count(c == k) for k in (3, 1, 2, 4, 5))
        is_punct = c[self.start] >= 6
        is_hex = (size >= 8) & (count(HEX_BYTE[data]) == size)
        shape = np.searchsorted([1, 3, 7, 15, 23, 39], size) * 64 + (lower > 0) * 32 + (upper > 1) * 16 + (digits > 0) * 8 + (symbol > 0) * 4 + (other > 0) * 2 + is_hex
        mark = MARKS[data[self.start]]
        self.shape = np.where(is_punct, 7 * 64 + mark, shape)
        switch = count(np.append(False, (c[1:] != c[:-1]) & inside[1:] & inside[:-1]))
        self.switch = np.searchsorted([1, 3, 8], np.where(is_punct, 0, switch), "right")
        self.near = np.where(is_punct, np.minimum(mark, 6), np.where(digits == 0, 7, np.where(size < 8, 8, np.where(is_hex, 9, 10))))
        self.hint = np.zeros(n, np.int64)
        for last, (length, k) in _hints().iter(joined.lower().decode("latin-1")):
            at = np.searchsorted(self.start, last - length + 1, "right") - 1
            self.hint[at] = k
        texts_n = np.diff(self.first)
        odd = np.bincount(self.doc, (digits > 0) & (size >= 8), len(texts)) / np.maximum(texts_n, 1)
        hinted = np.bincount(self.doc, self.hint > 0, len(texts)) > 0
        self.file = ((odd > 0.01).astype(np.int64) + (odd > 0.1) + 3 * hinted)[self.doc]

    def _moved(self, values: np.ndarray, by: int, empty: int) -> np.ndarray:
        """Each token's neighbour `by` tokens on, `empty` beyond its text."""
        out = np.full(self.n, empty, values.dtype)
        if by < 0 and -by < self.n:
            out[-by:] = np.where(self.doc[:by] == self.doc[-by:], values[:by], empty)
        elif 0 < by < self.n:
            out[:-by] = np.where(self.doc[by:] == self.doc[:-by], values[by:], empty)
        return out

    def features(self) -> np.ndarray:
        """Feature numbers (one a group) of all tokens."""
        cols = [self.shape, self.switch, self.hint, *[self._moved(self.hint, -k, 0) for k in (1, 2, 3, 4)]]
        cols += [self._moved(self.near, k, N_NEAR - 1) for k in (1, -1, -2)] + [self.file]
        return np.stack(cols, axis=1) + OFFSETS

    def emissions(self, w: np.ndarray) -> np.ndarray:
        """Sums of the features' weights; groups are put together first, so a token takes few look-ups."""
        g = dict(zip(GROUPS, np.split(w, OFFSETS[1:]), strict=True))
        own = (g["own"][:, None] + g["switch"][None]).reshape(-1, TAGS)
        near = (g["n1"][:, None, None] + g["b1"][None, :, None] + g["b2"][None, None]).reshape(-1, TAGS)
        before = (g["p1"][:, None, None, None] + g["p2"][None, :, None, None] + g["p3"][None, None, :, None] + g["p4"]).reshape(-1, TAGS)
        out = g["shape"][self.shape] + own[self.hint * N_SWITCH + self.switch]
        out += near[(self._moved(self.near, 1, 11) * N_NEAR + self._moved(self.near, -1, 11)) * N_NEAR + self._moved(self.near, -2, 11)]
        h = [self._moved(self.hint, -k, 0) for k in (1, 2, 3, 4)]
        out += before[((h[0] * N_HINT + h[1]) * N_HINT + h[2]) * N_HINT + h[3]]
        return out + g["file"][self.file]


OFFSETS = np.cumsum([0, *GROUPS.values()])[:-1]
TOTAL = sum(GROUPS.values())


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class ChainField:
    """Weights of features by tag, and of neighbouring tags. `caution` is taken off every span's score."""

    def __init__(self, caution: float = 1.0):
        self.w, self.t, self.caution = np.zeros((TOTAL, TAGS)), np.zeros((TAGS, TAGS)), caution

    def transitions(self) -> np.ndarray:
        t = self.t.copy()
        t[0, 2] = -1e6  # I never follows O
        return t

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.w[features].sum(axis=-2)

    def possible(self, e: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Tokens that some run of B and I could hold and score no less than O throughout."""
        t = self.transitions()
        step = max(0.0, max(t[0, 1], t[1:, 1:].max()) - t[0, 0])
        leave = max(0.0, t[1:, 0].max() - t[0, 0])
        gain = (e[:, 1:].max(axis=1) - e[:, 0] + step).astype(np.float64)
        # a drop between texts that no gain makes up for
        ends = np.cumsum(gain) - doc * (np.maximum(gain, 0).sum() + leave + 1)
        low = np.minimum.accumulate(ends - gain)
        high = np.maximum.accumulate(ends[::-1])[::-1]
        return high - low + leave >= 0

    def decode(self, e: np.ndarray, first: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Best tags of all tokens of texts laid end to end, all runs a step at a time."""
        tags = np.zeros(len(e), np.int64)
        if not len(e):
            return tags
        e = e.copy()
        e[:, 1] -= self.caution
        at = np.flatnonzero(self.possible(e, doc))
        if not len(at):
            return tags
        t = self.transitions()
        new = np.append(True, (np.diff(at) != 1) | (np.diff(doc[at]) != 0))
        begin = np.flatnonzero(new)
        lengths = np.diff(np.append(begin, len(at)))
        order = np.argsort(-lengths, kind="stable")
        begin, lengths = begin[order], lengths[order]
        flat, head, tail = e[at], at[begin], at[begin + lengths - 1]
        at_start, at_end = first[doc[head]] == head, first[doc[tail] + 1] - 1 == tail
        best = flat[begin] + np.where(at_start[:, None], 0.0, t[0])
        best[:, 2] = -1e6
        back: list[np.ndarray] = []
        for k in range(1, lengths[0]):
            live = int(np.searchsorted(-lengths, -k, "left"))  # runs longer than k
            through = best[:live, :, None] + t
            back.append(through.argmax(axis=1))
            best[:live] = through.max(axis=1) + flat[begin[:live] + k]
        y = (best + np.where(at_end[:, None], 0.0, t[:, 0])).argmax(axis=1)
        for k in range(lengths[0] - 1, -1, -1):
            live = int(np.searchsorted(-lengths, -k, "left"))
            tags[at[begin[:live] + k]] = y[:live]
            if k:
                y[:live] = back[k - 1][np.arange(live), y[:live]]
        return tags

    def gradient(self, features: np.ndarray, gold: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected minus observed counts over padded sequences (rows x steps x groups)."""
        rows, steps = gold.shape
        e, t = self.emissions(features), self.transitions()
        e[:, 0, 2] = -1e6
        live = np.arange(steps)[None, :] < lengths[:, None]
        alpha = np.zeros((rows, steps, TAGS))
        alpha[:, 0] = e[:, 0]
        for k in range(1, steps):
            new = _logsum(alpha[:, k - 1, :, None] + t, 1) + e[:, k]
            alpha[:, k] = np.where(live[:, k, None], new, alpha[:, k - 1])
        norm = _logsum(alpha[:, -1], 1)
        beta = np.zeros((rows, steps, TAGS))
        gw, gt = np.zeros_like(self.w), np.zeros_like(self.t)
        for k in range(steps - 2, -1, -1):
            step = t + (e[:, k + 1] + beta[:, k + 1])[:, None, :]
            beta[:, k] = np.where(live[:, k + 1, None], _logsum(step, 2), 0)
            pair = np.exp(alpha[:, k, :, None] + step - norm[:, None, None]) * live[:, k + 1, None, None]
            gt += pair.sum(0)
        p = np.exp(alpha + beta - norm[:, None, None]) * live[..., None]
        p[np.arange(rows)[:, None], np.arange(steps)[None, :], gold] -= live
        for y in range(TAGS):
            gw[:, y] = np.bincount(features.reshape(-1), np.repeat(p[..., y].ravel(), features.shape[-1]), TOTAL)
        both = live[:, 1:]
        np.add.at(gt, (gold[:, :-1][both], gold[:, 1:][both]), -1)
        return gw, gt

    def fit(self, features: list[np.ndarray], gold: list[np.ndarray], epochs: int = 40, rate: float = 0.1, ridge: float = 0.02) -> ChainField:
        steps = max(len(g) for g in gold)
        lengths = np.array([len(g) for g in gold])
        x = np.zeros((len(gold), steps, len(GROUPS)), np.int64)
        y = np.zeros((len(gold), steps), np.int64)
        for i, (f, g) in enumerate(zip(features, gold, strict=True)):
            x[i, : len(g)], y[i, : len(g)] = f, g
        x[np.arange(steps)[None, :] >= lengths[:, None]] = OFFSETS
        square = [np.zeros_like(self.w), np.zeros_like(self.t)]
        mean = [np.zeros_like(self.w), np.zeros_like(self.t)]
        for k in range(1, epochs + 1):
            for i, (p, g) in enumerate(zip((self.w, self.t), self.gradient(x, y, lengths), strict=True)):
                g = g / len(gold) + ridge / len(gold) * p
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.99 * square[i] + 0.01 * g * g
                p -= rate * (mean[i] / (1 - 0.9**k)) / (np.sqrt(square[i] / (1 - 0.99**k)) + 1e-8)
        return self

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int]]]:
        """Byte spans of the tagged secrets in each text."""
        tokens = Tokens(texts)
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not tokens.n:
            return out
        y = self.decode(tokens.emissions(self.w), tokens.first, tokens.doc)
        for b in np.flatnonzero(y == 1).tolist():
            e, doc = b, tokens.doc[b]
            while e + 1 < len(y) and y[e + 1] == 2 and tokens.doc[e + 1] == doc:
                e += 1
            out[doc].append((int(tokens.start[b] - tokens.text_starts[doc]), int(tokens.end[e] - tokens.text_starts[doc])))
        return out


def templates(n: int = 700, seed: int = 5) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Made lines with known secret spans, and lines whose numbers and digests are none."""
    r = np.random.default_rng(seed)
    pick = lambda letters, size: "".join(letters[i] for i in r.integers(0, len(letters), size))
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    word = lambda: pick("etaoinshrdlu", int(r.integers(2, 9)))
    key = lambda: pick(alnum, int(r.integers(16, 44)))
    secret = (
        lambda: ("password = ", key()), lambda: ('token: "', key()), lambda: ("the password is ", pick(alnum, int(r.integers(10, 16))) + "7"), lambda: ("Authorization: Bearer ", key()),
        lambda: ("secret ", pick("0123456789abcdef", 40)), lambda: ("", "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)), lambda: ("", "ghp_" + pick(alnum, 36)), lambda: ("key ", "sk_live_" + pick(alnum, 24)),
        lambda: ("the passphrase is \"", " ".join(word() for _ in range(4))), lambda: ("passphrase: \"", " ".join(word() for _ in range(int(r.integers(3, 6))))),
        lambda: ("api_key=", key()), lambda: ("credential ", key()), lambda: ("", "eyJ" + pick(alnum, 20) + "." + pick(alnum, 30) + "." + pick(alnum, 24)), lambda: ("", pick("0123456789abcdef", 40)),
    )
    clean = (
        lambda: "order " + pick("0123456789", int(r.integers(6, 17))), lambda: "phone +1 (" + pick("0123456789", 3) + ") " + pick("0123456789", 3) + "-" + pick("0123456789", 4), lambda: word() + pick("0123456789", 2) + "@mail.example.com",
        lambda: pick("0123456789", 16), lambda: "in 2024-01-15 at 10:30", lambda: "https://www.example.com/" + word() + "/" + pick("0123456789", 5), lambda: "the token was " + word(), lambda: "a secret of " + word(), lambda: "password " + word() + " " + word(),
        lambda: word().upper() + " " + word().upper() + "!!", lambda: pick("etaoinshrdlu", 26), lambda: "192.168.0." + pick("0123456789", 2), lambda: word() + "-" + word() + "-" + word(), lambda: word() + "###" + word() + "$$$", lambda: "<div class=" + word() + ">" + word() + "</div>",
        lambda: pick("0123456789", 3) + "-" + pick("0123456789", 2) + "-" + pick("0123456789", 4), lambda: word() + " | " + word() + " | " + word(),
    )
    out = []
    for _ in range(n):
        line, spans = " ".join(word() for _ in range(int(r.integers(2, 8)))) + " ", []
        if r.random() < 0.5:
            lead, value = secret[int(r.integers(len(secret)))]()
            spans.append((len(line) + len(lead), len(line) + len(lead) + len(value)))
            line += lead + value + ('"' if lead.endswith('"') else "") + " "
        else:
            line += clean[int(r.integers(len(clean)))]() + " "
        line += " ".join(word() for _ in range(int(r.integers(1, 7))))
        out.append((line.encode(), spans))
    return out


def _gold(tokens: Tokens, spans: list[tuple[int, int]]) -> np.ndarray:
    tags = np.zeros(tokens.n, np.int64)
    for a, b in spans:
        own = np.flatnonzero((tokens.start >= a) & (tokens.end <= b))
        tags[own] = 2
        tags[own[:1]] = 1
    return tags


def _known(text: str) -> tuple[bytes, list[tuple[int, int]]]:
    """A piece of the corpus with the byte spans of what the base patterns hold for secret."""
    value = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    value += [(a, b) for a, b, k in base_spans(text) if k and not any(a < y and x < b for x, y in value)]
    return text.encode(), [(len(text[:a].encode()), len(text[:b].encode())) for a, b in value]


def fit_field(data: list[tuple[bytes, list[tuple[int, int]], int, int]], **options) -> ChainField:
    """A field fitted to the bytes from `a` to `b` of texts with their spans."""
    features, gold = [], []
    for text, spans, a, b in data:
        tokens = Tokens([text])
        own = (tokens.start >= a) & (tokens.end <= b)
        if own.any():
            features.append(tokens.features()[own])
            gold.append(_gold(tokens, spans)[own])
    return ChainField(**options).fit(features, gold)


def _planted(lines, pieces: list[bytes]) -> list[tuple[bytes, list[tuple[int, int]], int, int]]:
    """Each line inside a piece of prose, to be fitted with some of the prose around it."""
    out = []
    for k, (line, spans) in enumerate(lines):
        text = pieces[k % len(pieces)] if pieces else b""
        at = text[: len(text) // 2].rfind(b" ") + 1
        out.append((text[:at] + line + b" " + text[at:], [(a + at, b + at) for a, b in spans], max(0, at - 60), at + len(line) + 60))
    return out


def _drawn(rows: DataFrame, n: int) -> list[str]:
    """The pieces `s` of the n lowest distinct `h`: only hashes are ordered, and the driver gets n pieces at most."""
    top = rows.select("h").distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]
    if top is None:
        return []
    return [r["s"] for r in rows.where(F.col("h") <= top).groupBy("h").agg(F.min("s").alias("s")).orderBy("h").collect()]


def train(docs: DataFrame, text_col: str = "text", snippets: int = 300, pieces: int = 1500, rounds: int = 2, **options) -> ChainField:
    """A field fitted to the templates, alone and planted in prose, and to a bounded sample of the corpus.

    `snippets` pieces of 200 characters around words of the base patterns, and `pieces` pieces of 3000 characters from a hashed
    place: a part of some of them, and in all of them the surroundings of what the field of the round before tags
    beside the base patterns.
    """
    text = F.col(f"`{text_col}`")
    h = F.xxhash64(F.lit(3), text).alias("h")
    hint = F.regexp_instr(text, F.lit("(?i)(?:password|secret|token|api_?key|AKIA)"))
    place = F.pmod(F.xxhash64(text), F.greatest(F.length(text) - 3000, F.lit(1))).cast("int") + 1
    near = _drawn(docs.where(hint > 0).select(h, F.substring(text, F.greatest(hint - 60, F.lit(1)), F.lit(200)).alias("s")), snippets)
    long = list(map(_known, _drawn(docs.where(text.isNotNull()).select(h, F.substring(text, place, F.lit(3000)).alias("s")), pieces)))
    lines = templates(1000)
    data = [(t, s, 0, len(t)) for t, s in lines[:300]] + _planted(lines[300:], [t for t, s in long if not s])
    data += [(t, s, 0, len(t)) for t, s in map(_known, near)] + [(t, s, at, at + 300) for t, s in long[:300] if (at := len(t) // 3) >= 0]
    field = fit_field(data, **options)
    for _ in range(rounds):
        hard = []
        for (t, known), added in zip(long, field.spans([t for t, _ in long]), strict=True):
            hard += [(t, known, a - 60, b + 60) for a, b in added if not any(a < y and x < b for x, y in known)]
        if not hard:
            break
        data += hard[:snippets]
        field = fit_field(data, **options)
    return field


def find_spans(field: ChainField, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """(start, end, kind) in code points, by start and kind: base spans and those that the field adds."""
    out = []
    for raw, added in zip(texts, field.spans(texts), strict=True):
        text = raw.decode("utf-8", "replace")
        spans = base_spans(text)
        if added and len(text) != len(raw):
            added = [(len(raw[:a].decode("utf-8", "replace")), len(raw[:b].decode("utf-8", "replace"))) for a, b in added]
        spans += [(a, b, 3) for a, b in added if b - a >= 8 and not any(a < y and x < b for x, y, _ in spans)]
        out.append(sorted(spans, key=lambda s: (s[0], s[2], s[1])))
    return out


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, field: ChainField, keep: list[str]) -> DataFrame:
    """`keep` columns and FIELDS of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        import pyarrow as pa

        def work(texts):
            found = find_spans(shared.value, texts)
            base = [[s for s in spans if s[2] < 3] for spans in found]
            counts = [pa.array([sum(k == kind for _, _, k in b) for b in base], pa.int64()) for kind in range(3)]
            return [*counts, pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b in base]), pa.array([listed(s) for s in found])]

        return work

    return annotate(docs, "text", FIELDS, make, keep, slice_bytes=1 << 20)


def redact(docs: DataFrame, mask: str = "[SECRET]", count_col: str | None = "n_chars") -> DataFrame:
    """`docs` with every span replaced by `mask`; same columns, `count_col` brought up to date."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    name = fresh(docs, "redacted")

    def make():
        import pyarrow as pa

        def work(texts):
            out = []
            for raw, spans in zip(texts, find_spans(shared.value, texts), strict=True):
                if not spans:
                    out.append(None)
                    continue
                text, parts, at = raw.decode("utf-8", "replace"), [], 0
                for a, b, _ in spans:
                    if a >= at:
                        parts += [text[at:a], mask]
                    at = max(at, b)
                out.append("".join([*parts, text[at:]]))
            return [pa.array(out, pa.string())]

        return work

    made = annotate(docs, "text", f"`{name}` string", make, docs.columns, slice_bytes=1 << 20)
    new = {"text": F.coalesce(F.col(name), F.col("text"))}
    if count_col in docs.columns:
        new[count_col] = F.when(F.col(name).isNull(), F.col(count_col)).otherwise(F.length(name)).cast(docs.schema[count_col].dataType)
    return made.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def op9_secrets(spark, sf_dir):
    """Every document of `documents`, base spans and added ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, train(docs), ["doc_id"])
