"""Interpolated modified Kneser-Ney trigram model, counted in Spark and memory-mapped by workers.

Counting: tasks count words, and reducers write each hash range of the vocabulary as a sorted
array of 64-bit hashes with counts. A word's number is its place in these arrays. Tasks then count
triples of numbers, dealt to parts by their middle word, so that a part has all of a middle word's pairs and contexts:
the triples give the pairs' numbers of contexts (their Kneser-Ney counts), and these the words' own. A part is one file of
sorted hash arrays of contexts, triples and pairs, and counts in a byte each with a list of the larger ones. Middle words that would fill half a part alone are spread over all parts by
their last word too; statistics of contexts that end in one are summed in files of their own. Scoring workers
map the files and look up hashes; nothing is loaded whole and no count is dropped.
Two begin marks precede each text.

Words are told apart by 64-bit hashes: among n distinct words two coincide with odds of n * n / 2**65. More than
MOST_WORDS distinct words are refused. Each part is written by one reducer of its own.

The files lie in the shared folder. Where that is no file system a worker can map, it keeps
a copy in memory of the files that it meets.

Defined cases: a null or empty text is the end token alone; a null id counts as the empty text in the fold; words
outside the training folds share the uniform mass; with no training documents every token has the uniform
probability; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import annotate, cut, local_path, open_fs, scratch, slices
from lodestar.llm.quality_cnn import id_bucket

END = b"\n"  # no word holds it
#: Numbers of words take 32 bits of a code; the last two stand for a text's begin and an unknown word.
MOST_WORDS = (1 << 32) - 2
FIELDS = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def split_words(text: bytes) -> list[bytes]:
    return text.lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, bytes of equal weight together, compressed."""
    import zstandard

    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays]
    return zstandard.compress(b"".join(planes), 1)


def unsqueeze(data: bytes, n: int, *dtypes: str) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.decompress(data), 0, []
    for d in dtypes:
        width = np.dtype(d).itemsize
        plane = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(plane.T).view(d).ravel())
        at += n * width
    return out


def sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys with the sums of their values."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], *[np.add.reduceat(v[order], first) for v in values]


def narrow(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values in a byte each, and place and value of those that a byte cannot hold: (bytes, [places, values])."""
    big = np.flatnonzero(values >= 255)
    return np.minimum(values, 255).astype(np.uint8), np.concatenate([big, values[big]]).astype("<u8")


def widen(small: np.ndarray, big: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The values at `at` of what narrow() made."""
    out = small[at].astype(np.int64)
    rows = np.flatnonzero(out == 255)
    if len(rows):
        places, values = big.reshape(2, -1)
        out[rows] = values[np.searchsorted(places, at[rows].astype(np.uint64))]
    return out


def lookup(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of `wanted` in the sorted `known`, and whether each is there."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def pack(name: str, hashes: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of distinct hashes and their sorted array: the leading bits as starts of buckets of about four, then 32 bits each."""
    order = np.argsort(hashes)
    hashes = hashes[order]
    bits = max(1, (len(hashes) >> 2).bit_length())
    starts = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return order, {f"{name}_at": starts, name: hashes << np.uint64(bits) >> np.uint64(32)}


def seek(arrays: dict[str, np.ndarray], name: str, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes in an array made by pack(), and whether each is there."""
    starts, known = arrays[f"{name}_at"], arrays[name]
    if not len(known):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    bits = (len(starts) - 1).bit_length() - 1
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    wanted = (hashes << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)
    low, high = starts[bucket], starts[bucket + 1]
    end, widest, one, most = high, int((high - low).max(initial=0)), np.uint32(1), np.uint32(len(known) - 1)
    while widest:
        half = low + (high - low >> one)
        less = (known[np.minimum(half, most)] < wanted) & (low < high)
        low, high = np.where(less, half + one, low), np.where(less, high, half)
        widest >>= 1
    at = np.minimum(low, most)
    return at.astype(np.int64), (known[at] == wanted) & (low < end)


def pair_hash(code: np.ndarray) -> np.ndarray:
    return mix(code)


def triple_hash(code: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mix(pair_hash(code) ^ mix(last))


#: Arrays of each kind of file: name and type.
CONTEXTS = (("contexts_at", "<u4"), ("contexts", "<u4"), ("stats", "u1"), ("stats_big", "<u8"))
LAYOUT = {
    "words": (("hashes", "<u8"), ("totals", "u1"), ("totals_big", "<u8")),
    "lower": (("follows", "u1"), ("follows_big", "<u8"), ("heads", "u1"), ("heads_big", "<u8")),
    "grams": (
        ("pairs_at", "<u4"), ("pairs", "<u4"), ("kinds", "u1"), ("kinds_big", "<u8"), *CONTEXTS,
        ("triples_at", "<u4"), ("triples", "<u4"), ("counts", "u1"), ("counts_big", "<u8"),
    ),
    "spread": CONTEXTS,
}


@dataclass
class Store:
    """Files of arrays in the shared folder: sizes in bytes, then each array on a multiple of eight bytes."""

    folder: str

    def write(self, kind: str, part: int, **arrays: np.ndarray) -> None:
        from pyspark import TaskContext

        store, base = open_fs(self.folder)
        store.create_dir(base, recursive=True)
        own = f"{base}/.{kind}-{part}-{TaskContext.get().taskAttemptId()}"
        data = [np.ascontiguousarray(arrays[name].astype(d, copy=False)) for name, d in LAYOUT[kind]]
        with store.open_output_stream(own) as sink:
            sink.write(np.array([x.nbytes for x in data], "<u8").tobytes())
            for x in data:
                if x.nbytes:
                    sink.write(memoryview(x).cast("B"))
                    sink.write(bytes(-x.nbytes % 8))
        store.move(own, f"{base}/{kind}-{part}")

    def map(self, kind: str, part: int) -> dict[str, np.ndarray]:
        path = local_path(f"{self.folder}/{kind}-{part}")
        if path:
            import mmap
            import sys

            free = {"trackfd": False} if sys.version_info >= (3, 13) else {}  # no open file for each part
            with open(path, "rb") as source:
                data = mmap.mmap(source.fileno(), 0, access=mmap.ACCESS_READ, **free)
        else:
            store, base = open_fs(self.folder)
            with store.open_input_stream(f"{base}/{kind}-{part}") as source:
                data = source.read()
        sizes = np.frombuffer(data, "<u8", len(LAYOUT[kind])).tolist()
        out, at = {}, 8 * len(sizes)
        for (name, d), size in zip(LAYOUT[kind], sizes, strict=True):
            out[name] = np.frombuffer(data, d, size // np.dtype(d).itemsize, at)
            at += size + -size % 8
        return out


@dataclass
class Model:
    """What every worker gets: sizes and discounts; the arrays stay in files."""

    store: Store
    bits: int = 0
    firsts: list[int] = field(default_factory=list)  # number of the first word of each vocabulary part
    vocabulary: int = 0
    tokens: int = 0
    types: int = 0  # distinct pairs
    present: dict[str, set] = field(default_factory=dict)  # parts that have a file, by kind
    hot: np.ndarray | None = None  # middle words spread over all parts, sorted
    triple_discount: tuple = (0.0, 0.0, 0.0, 0.0)
    pair_discount: tuple = (0.0, 0.0, 0.0, 0.0)
    word_discount: tuple = (0.0, 0.0, 0.0, 0.0)
    word_mass: float = 1.0

    def top(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.uint16 if self.bits <= 16 else np.int64)

    def part(self, middle: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Parts of triples: by the middle word, by the last two where that is hot."""
        h = mix(middle)
        hot = self.is_hot(middle)
        h[hot] = mix(h[hot] ^ mix(last[hot]))
        return self.top(h)

    def is_hot(self, word: np.ndarray) -> np.ndarray:
        return lookup(self.hot, word)[1]


def by_part(part: np.ndarray):
    """(part, its rows)."""
    order = np.argsort(part, kind="stable")
    ordered = part[order]
    ends = [*(np.flatnonzero(ordered[1:] != ordered[:-1]) + 1).tolist(), len(order)] if len(order) else []
    for at, to in zip([0, *ends], ends, strict=False):
        yield int(ordered[at]), order[at:to]


class Places(dict):
    """The place of each word; one not met before gets the next."""

    def __init__(self, known: dict):
        super().__init__(known)
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        place = self[word] = len(self)
        return place


class Reader:
    """A worker's view of the files. Words met get places of their own, under which their number and statistics are kept."""

    def __init__(self, model: Model, limit: int = 500_000):
        self.m, self.files, self.limit = model, {}, limit
        self.none = {kind: {name: np.zeros(0, d) for name, d in arrays} for kind, arrays in LAYOUT.items()}
        self.forget()

    def forget(self) -> None:
        """Places 0 and 1 are the begin mark and the end of a text."""
        self.memo = Places({None: 0})
        self.number, self.total = np.array([self.m.vocabulary]), np.zeros(1, np.int64)
        self.low, self.freed, self.seen = self._lower(self.number)
        self.memo[END]
        self.learn()

    def file(self, kind: str, part: int) -> dict[str, np.ndarray]:
        if part not in self.m.present.get(kind, ()):
            return self.none[kind]
        if (kind, part) not in self.files:
            self.files[kind, part] = self.m.store.map(kind, part)
        return self.files[kind, part]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words by hash, -1 for unknown ones, and their counts."""
        out, total = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for p, rows in by_part(self.m.top(hashes)) if self.m.vocabulary else ():
            a = self.file("words", p)
            at, found = lookup(a["hashes"], hashes[rows])
            rows, at = rows[found], at[found]
            out[rows], total[rows] = at + self.m.firsts[p], widen(a["totals"], a["totals_big"], at)
        return out, total

    def _lower(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability without context, and as a middle word: share of the mass freed, and sum of the pairs' numbers of contexts."""
        m = self.m
        low = np.full(len(number), m.word_mass / (m.vocabulary + 1))
        freed, seen = np.zeros(len(number)), np.zeros(len(number), np.int64)
        rows = np.flatnonzero(number >= 0)
        if "lower" in m.present:
            for p, own in by_part(np.searchsorted(m.firsts, number[rows], "right") - 1):
                own, a = rows[own], self.file("lower", p)
                at = number[own] - m.firsts[p]
                follows, stats = widen(a["follows"], a["follows_big"], at), four(a["heads"], a["heads_big"], at)
                low[own] += np.maximum(follows - _by_count(m.word_discount, follows), 0) / max(1, m.types)
                freed[own], seen[own] = share(stats, m.pair_discount), stats[:, 3]
        return low, freed, seen

    def learn(self) -> None:
        words, self.memo.new = self.memo.new, []
        number, total = self.find(np.array([word_hash(w) for w in words], np.uint64))
        for name, new in zip(("number", "total", "low", "freed", "seen"), (number, total, *self._lower(number)), strict=True):
            setattr(self, name, np.concatenate([getattr(self, name), new]))

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts' lengths with their end, and the places of each token and of the two before it; two begin marks precede a text."""
        if len(self.memo) > self.limit:
            self.forget()
        split = [split_words(t) for t in texts]
        for w in split:
            w.append(END)
        n = np.array([len(w) for w in split], np.int64)
        last = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(split)), np.int64, n.sum())
        if self.memo.new:
            self.learn()
        starts = np.cumsum(n) - n
        middle = np.append(0, last[:-1])
        middle[starts] = 0
        first = np.append(0, middle[:-1])
        first[starts] = 0
        return n, first, middle, last

    def grams(self, first: np.ndarray, middle: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """For numbers of three words each, of which the middle one is known: in how many contexts the last two are seen, the
        count of all three, and the sum and the share freed of the triples that begin with the first two. Unknown words are -1."""
        m, n = self.m, len(last)
        kinds, counts, seen, freed = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        before, after, hot = first >= 0, last >= 0, m.is_hot(middle)
        high = middle.astype(np.uint64) << np.uint64(32)
        last = last.astype(np.uint32).astype(np.uint64)
        code = high | first.astype(np.uint32).astype(np.uint64)
        pair, context, triple = pair_hash(high | last), pair_hash(code), triple_hash(code, last)
        for p, rows in by_part(m.part(middle, last)):
            a = self.file("grams", p)
            at, found = seek(a, "pairs", pair[rows])
            found &= after[rows]
            kinds[rows[found]] = widen(a["kinds"], a["kinds_big"], at[found])
            at, found = seek(a, "triples", triple[rows])
            found &= after[rows] & before[rows]
            counts[rows[found]] = widen(a["counts"], a["counts_big"], at[found])
            rows = rows[~hot[rows] & before[rows]]
            at, found = seek(a, "contexts", context[rows])
            stats, rows = four(a["stats"], a["stats_big"], at[found]), rows[found]
            seen[rows], freed[rows] = stats[:, 3], share(stats, m.triple_discount)
        own = np.flatnonzero(hot & before)
        for p, rows in by_part(m.top(context[own])):
            a = self.file("spread", p)
            at, found = seek(a, "contexts", context[own[rows]] << np.uint64(m.bits))
            stats, rows = four(a["stats"], a["stats_big"], at[found]), own[rows[found]]
            seen[rows], freed[rows] = stats[:, 3], share(stats, m.triple_discount)
        return kinds, counts, seen, freed


def four(small: np.ndarray, big: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows `at` of four statistics each of what narrow() made."""
    out = small.reshape(-1, 4)[at]
    rows, columns = np.nonzero(out == 255)
    out = out.astype(np.int64)
    if len(rows):
        places, values = big.reshape(2, -1)
        out[rows, columns] = values[np.searchsorted(places, (at[rows] * 4 + columns).astype(np.uint64))]
    return out


def share(stats: np.ndarray, discount: tuple) -> np.ndarray:
    """The share of a context's mass that its discounts free."""
    return stats[:, :3] @ np.array(discount[1:]) / np.maximum(stats[:, 3], 1)


def statistics(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(n1, n2, n3+, sum) of the counts from each start to the next."""
    return np.stack([np.add.reduceat(x.astype(np.int64), starts) for x in (n == 1, n == 2, n > 2, n)], axis=1)


def discounts(n: list[int]) -> tuple[float, float, float, float]:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, 3+ from the counts of counts 1 to 4."""
    if not n[0]:
        return 0.0, 0.0, 0.0, 0.0
    y = n[0] / (n[0] + 2 * n[1])
    own = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * 0.5 for k in (1, 2, 3)]
    return 0.0, *[min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), own, strict=True)]


def _count_words(docs: DataFrame, parts: int) -> DataFrame:
    def run(batches):
        from collections import Counter

        import pyarrow as pa

        def emit(counts):
            hashes = np.array([word_hash(w) for w in counts], np.uint64)
            n = np.fromiter(counts.values(), np.int64, len(counts))
            order = np.argsort(hashes)
            hashes, n = hashes[order], n[order]
            cuts = np.searchsorted(hashes >> np.uint64(64 - parts) if parts else np.zeros(len(hashes), np.uint64), np.arange((1 << parts) + 1, dtype=np.uint64))
            for p in range(1 << parts):
                a, b = cuts[p], cuts[p + 1]
                if b > a:
                    yield p, b - a, squeeze(hashes[a:b], n[a:b])

        def flush(counts):
            rows = list(zip(*emit(counts), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], names=["part", "n", "data"])

        counts = Counter()
        for batch in batches:
            for piece in slices(batch, 4 << 20):
                texts = piece.column(0).to_pylist()
                for t in texts:
                    counts.update(split_words(t))
                counts[END] += len(texts)
                if len(counts) > 1_000_000:
                    yield flush(counts)
                    counts = Counter()
        if counts:
            yield flush(counts)

    return docs.mapInArrow(run, "part int, n long, data binary")


def _gathered(batches, *dtypes):
    """part -> concatenated arrays of the blobs of one reducer."""
    found: dict[int, list] = {}
    for batch in batches:
        for p, n, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            found.setdefault(p, []).append(unsqueeze(data, n, *dtypes))
    return {p: [np.concatenate(c) for c in zip(*blobs, strict=True)] for p, blobs in found.items()}


def _of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def fit(docs: DataFrame, store: Store, part_bytes: int = 16 << 20) -> Model:
    """Counts of every text of `docs`, written to the store."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(text.cast("binary").alias("text"))
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(3, math.ceil(math.log2(max(1, size / part_bytes))))
    meta = "part int, n long, total long, c1 long, c2 long, c3 long, c4 long"

    def write_words(batches):
        import pyarrow as pa

        for p, (hashes, n) in _gathered(batches, "<u8", "<i8").items():
            hashes, n = sum_by(hashes, n)
            totals, totals_big = narrow(n)
            store.write("words", p, hashes=hashes, totals=totals, totals_big=totals_big)
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "n": [len(n)], "total": [int(n.sum())], **{f"c{k}": [0] for k in (1, 2, 3, 4)}})

    made = {r["part"]: r for r in _count_words(docs, bits).repartitionById(1 << bits, "part").mapInArrow(write_words, meta).collect()}
    sizes = [made[p]["n"] if p in made else 0 for p in range(1 << bits)]
    model = Model(store, bits, (np.cumsum(sizes) - sizes).tolist(), sum(sizes), sum(r["total"] for r in made.values()), present={"words": set(made)}, hot=np.zeros(0, np.int64))
    if not model.vocabulary:
        return model
    if model.vocabulary >= MOST_WORDS:
        raise ValueError(f"{model.vocabulary} distinct words; codes hold {MOST_WORDS}")
    begin = model.vocabulary  # stands twice before a text's first word
    least = max(1, model.tokens >> bits >> 1)

    def find_hot(batches):
        import pyarrow as pa

        for batch in batches:
            for p in batch.column(0).to_pylist():
                a = store.map("words", p) if sizes[p] else {}
                n = widen(a["totals"], a["totals_big"], np.arange(sizes[p])) if a else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n > least) + model.firsts[p])], names=["word"])

    parts = spark.range(0, 1 << bits, 1, min(1 << bits, spark.sparkContext.defaultParallelism * 4))
    hot = [r["word"] for r in parts.mapInArrow(find_hot, "word long").collect()]
    model.hot = np.array(sorted([*hot, begin]), np.int64)
    shared = spark.sparkContext.broadcast(model)

    def count_triples(batches):
        import pyarrow as pa

        reader, held, size = Reader(shared.value), [], 0

        def flush():
            code, last = [np.concatenate(c) for c in zip(*held, strict=True)]
            code, last, n = distinct(code, last)
            middle = (code >> np.uint64(32)).astype(np.int64)
            part = shared.value.part(middle, last.astype(np.uint64))
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange((1 << bits) + 1))
            rows = []
            for p in range(1 << bits):
                own = order[cuts[p] : cuts[p + 1]]
                if len(own):
                    step = np.diff(middle[own], prepend=0).astype("<u4")
                    rows.append((p, len(own), squeeze(step, code[own].astype("<u4"), last[own], n[own].astype("<u4"))))
            rows = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], names=["part", "n", "data"])

        for batch in batches:
            for piece in slices(batch, 4 << 20):
                _, *places = reader.tokens(piece.column(0).to_pylist())
                first, middle, last = [reader.number[x] for x in places]
                held.append((middle.astype(np.uint64) << np.uint64(32) | first.astype(np.uint64), last.astype("<u4")))
                size += len(last)
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    # one output for five things: sums of a part's pairs (0) and triples (4), statistics of middle words (1) and
    # continuation counts (2) by word range, partial statistics of the contexts that end in a hot word (3)
    wide = "kind int, part int, n long, a long, b long, c long, d long, data binary"

    def write_grams(batches):
        import pyarrow as pa

        m = shared.value
        found: dict[int, list] = {}
        for batch in batches:
            for p, n, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                step, first, last, k = unsqueeze(data, n, "<u4", "<u4", "<u4", "<u4")
                found.setdefault(p, []).append((np.cumsum(step, dtype=np.uint64) << np.uint64(32) | first, last, k.astype(np.int64)))
        rows = []
        for p in list(found):
            code, last, n = distinct(*[np.concatenate(c) for c in zip(*found.pop(p), strict=True)])
            rows.append((4, p, len(n), *_of_counts(n), None))
            starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            contexts, stats = code[starts], statistics(starts, n)
            pairs, kinds = np.unique(code >> np.uint64(32) << np.uint64(32) | last, return_counts=True)
            rows.append((0, p, len(pairs), *_of_counts(kinds), None))
            middle = (pairs >> np.uint64(32)).astype(np.int64)
            heads = np.flatnonzero(np.append(True, middle[1:] != middle[:-1]))
            head_stats, heads = statistics(heads, kinds), middle[heads]
            words, k = np.unique((pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), return_counts=True)
            for kind, own, values in ((1, heads, head_stats.T), (2, words, k[None])):
                cuts = np.searchsorted(own, [*m.firsts, begin + 1])
                rows += [(kind, q, int(b - a), 0, 0, 0, 0, squeeze(own[a:b], *[np.ascontiguousarray(x[a:b]) for x in values])) for q, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            away = m.is_hot((contexts >> np.uint64(32)).astype(np.int64))
            far, far_stats = contexts[away], stats[away]
            for q, own in by_part(m.top(pair_hash(far))):
                rows.append((3, q, len(own), 0, 0, 0, 0, squeeze(np.diff(far[own], prepend=np.uint64(0)), *[np.ascontiguousarray(x) for x in far_stats[own].T])))
            order, made = pack("triples", triple_hash(code, last))
            made["counts"], made["counts_big"] = narrow(n[order])
            order, more = pack("pairs", pair_hash(pairs))
            made |= more
            made["kinds"], made["kinds_big"] = narrow(kinds[order])
            order, more = pack("contexts", pair_hash(contexts[~away]))
            made |= more
            made["stats"], made["stats_big"] = narrow(stats[~away][order].ravel())
            store.write("grams", p, **made)
        if rows:
            types = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in wide.split(", ")])

    out = cut(docs.mapInArrow(count_triples, "part int, n long, data binary").repartitionById(1 << bits, "part").mapInArrow(write_grams, wide), "op6-parts")
    sums = {r["kind"]: r for r in out.where("kind in (0, 4)").groupBy("kind").agg(*[F.sum(c).alias(c) for c in "nabcd"]).collect()}
    model.types = sums[0]["n"]
    model.pair_discount, model.triple_discount = [discounts([sums[kind][c] for c in "abcd"]) for kind in (0, 4)]
    model.present["grams"] = {r["part"] for r in out.where("kind = 0").select("part").collect()}

    def write_spread(batches):
        import pyarrow as pa

        found: dict[int, list] = {}
        for batch in batches:
            for p, n, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                step, *stats = unsqueeze(data, n, "<u8", *["<i8"] * 4)
                found.setdefault(p, []).append((np.cumsum(step, dtype=np.uint64), *stats))
        for p, blobs in found.items():
            contexts, *stats = sum_by(*[np.concatenate(c) for c in zip(*blobs, strict=True)])
            order, made = pack("contexts", pair_hash(contexts) << np.uint64(bits))
            made["stats"], made["stats_big"] = narrow(np.stack(stats, axis=1)[order].ravel())
            store.write("spread", p, **made)
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32())})

    own = out.where("kind = 3").select("part", "n", "data").repartitionById(1 << bits, "part").mapInArrow(write_spread, "part int").collect()
    model.present["spread"] = {r["part"] for r in own}

    def write_lower(batches):
        import pyarrow as pa

        found: dict[int, tuple] = {}
        for batch in batches:
            for kind, p, n, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if p not in found:  # the last part has the begin mark too
                    size = sizes[p] + (p == (1 << bits) - 1)
                    found[p] = np.zeros((size, 4), np.int64), np.zeros((size, 1), np.int64)
                words, *values = unsqueeze(data, n, *["<i8"] * (5 if kind == 1 else 2))
                found[p][kind - 1][words - model.firsts[p]] += np.stack(values, axis=1)
        for p, (heads, follows) in found.items():
            n = follows.ravel()
            made = dict(zip(("follows", "follows_big", "heads", "heads_big"), (*narrow(n), *narrow(heads.ravel())), strict=True))
            store.write("lower", p, **made)
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "n": [int((n > 2).sum())], "total": [int(n.sum())], **{f"c{k + 1}": [x] for k, x in enumerate(_of_counts(n))}})

    own = out.where("kind in (1, 2)").select("kind", "part", "n", "data").repartitionById(1 << bits, "part").mapInArrow(write_lower, meta).collect()
    model.present["lower"] = {r["part"] for r in own}
    c = [sum(r[f"c{k}"] for r in own) for k in (1, 2, 3, 4)]
    model.word_discount = discounts(c)
    model.word_mass = sum(d * n for d, n in zip(model.word_discount[1:], (c[0], c[1], sum(r["n"] for r in own)), strict=True)) / max(1, model.types)
    return model


def distinct(code: np.ndarray, last: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (code, last) in order, with the sums of n, or how often each occurs."""
    order = np.argsort(code)
    code = code[order]
    new = np.append(True, code[1:] != code[:-1])
    key = (np.cumsum(new) - 1).astype(np.uint64) << np.uint64(32) | last[order]
    if n is None:
        key.sort()
    else:
        again = np.argsort(key)
        key, n = key[again], n[order][again]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    n = np.diff(first, append=len(key)) if n is None else np.add.reduceat(n, first)
    return code[new][(key[first] >> np.uint64(32)).astype(np.int64)], key[first].astype("<u4"), n


def _by_count(values: tuple, counts: np.ndarray) -> np.ndarray:
    return np.array(values)[np.minimum(counts, 3)]


def interpolate(counts: np.ndarray, seen: np.ndarray, freed: np.ndarray, discount: tuple, low: np.ndarray) -> np.ndarray:
    """Discounted share of each count and the freed mass on the lower order; the lower order alone after an unseen context."""
    own = np.maximum(counts - _by_count(discount, counts), 0) / np.maximum(seen, 1)
    return np.where(seen > 0, own + freed * low, low)


def token_log10(reader: Reader, first: np.ndarray, middle: np.ndarray, last: np.ndarray) -> np.ndarray:
    """log10 probability of each last token after the two before it, all given by their places in the reader."""
    m, p = reader.m, reader.low[last]
    rows = np.flatnonzero(reader.seen[middle])
    if len(rows):
        kinds, counts, seen, freed = reader.grams(*[reader.number[x[rows]] for x in (first, middle, last)])
        low = interpolate(kinds, reader.seen[middle[rows]], reader.freed[middle[rows]], m.pair_discount, p[rows])
        p[rows] = interpolate(counts, seen, freed, m.triple_discount, low)
    return np.log10(p)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """`keep` columns and FIELDS of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        import pyarrow as pa

        m = shared.value
        reader = Reader(m)

        def work(texts):
            n, first, middle, last = reader.tokens(texts)
            starts = np.cumsum(n) - n
            log, total = token_log10(reader, first, middle, last), reader.total[last]
            base = np.log10((total + 0.1) / (m.tokens + 0.1 * (m.vocabulary + 1)))
            sums = [np.add.reduceat(x, starts) for x in ((total > 0).astype(np.int64), base, log)]
            return [pa.array(n), pa.array(sums[0]), pa.array(np.full(len(n), m.tokens, np.int64)), pa.array(sums[1]), pa.array(sums[2])]

        return work

    return annotate(docs, "text", FIELDS, make, keep, 2 << 20)


def score_corpus(docs: DataFrame, folds: int = 10, held: int = 0) -> DataFrame:
    """doc_id, held_out and FIELDS: a model of the other folds applied to all documents."""
    bucket = id_bucket("doc_id", folds) == held
    model = fit(docs.where(~bucket), Store(scratch(docs.sparkSession, "lm")))
    return score(docs.withColumn("held_out", bucket).select("doc_id", "held_out", "text"), model, ["doc_id", "held_out"])


def op6_kneser_ney(spark, sf_dir):
    """All of `documents` scored by a model of nine tenths of them."""
    return score_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))
