"""Benchmark decontamination by sharded suffix arrays.

Each slice of documents is a shard. Its words become numbers of the benchmark's
vocabulary (0 for any other word) and all its suffixes that begin with a known word are sorted, by doubling
the number of words compared until it covers a window. Every benchmark suffix is found by binary search: the
training suffixes that begin with its window are one range of the array, and the benchmark suffixes next to a
training suffix in order give its longest verbatim match. Matches over a window are chains of hits one
word apart in text and item alike.

The benchmark is a stated query set. Tasks cut it into blocks of `block_bytes` and write these to the shared
folder; a worker opens one block at a time, so its memory does not follow the benchmark.

Defined cases: null and word-less texts have no words and are never contaminated; a null
item_id is reported as "null"; repeated items with one id count once; an empty
benchmark finds nothing; empty tables give empty results; extra columns are ignored. Of equally long
matches the leftmost is reported; without any the length is 0 and the place -1.
"""

from __future__ import annotations

import hashlib
import math
import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import annotate, fresh, open_fs, scratch

WINDOW = 10
FIELDS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_at long"


def _fold() -> bytes:
    """A-Z to a-z, and every ASCII character that is no letter or digit to a space."""
    table = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalnum() else 32
    return bytes(table)


FOLD = _fold()


def split_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of known words in the order of the `depth` words or more from there on; an unknown word ends a suffix."""
    at = np.flatnonzero(ids)
    rank = ids.astype(np.uint64)
    span, order = 1, np.argsort(rank[at], kind="stable")
    while span < depth and len(at):
        behind = at + span
        key = rank[at] << np.uint64(32) | np.where(behind < len(ids), rank[np.minimum(behind, len(ids) - 1)], np.uint64(0))
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank[at[order]] = np.cumsum(np.append(True, ordered[1:] != ordered[:-1])).astype(np.uint64)
        span *= 2
    return at[order]


class Block:
    """Some benchmark items: vocabulary, words end to end, and their suffixes in order."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        words, owner, lengths = [], [], []
        for k, (_, text) in enumerate(items):
            own = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in split_words(text)]
            n, size = len(own), min(window, len(own))
            words += [*own, 0]
            owner += [k] * (n + 1)
            lengths += [*[size] * (n - size + 1 if n else 0), *[0] * (size - 1 if n else 0), 0]
        self.words, self.owner = np.array(words, np.uint32), np.array(owner, np.int64)
        self.window, self.order = window, suffix_array(self.words, window)
        #: Words of the window that begins here, 0 where none does; by the order of suffixes.
        self.lengths = np.array(lengths, np.int64)[self.order]

    def _below(self, ids: np.ndarray, array: np.ndarray, at: np.ndarray, size: np.ndarray, ties: bool) -> np.ndarray:
        """How many training suffixes come before each benchmark suffix, compared by `size` words; with ties, equal ones too."""
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(array), np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less, live = np.full(len(open_), ties), np.arange(len(open_))
            for k in range(int(size[open_].max())):
                live = live[size[open_[live]] > k]
                a = ids[np.minimum(array[mid[live]] + k, len(ids) - 1)]
                b = self.words[np.minimum(at[open_[live]] + k, len(self.words) - 1)]
                less[live[a < b]], less[live[a > b]] = True, False
                live = live[(a == b) & (a > 0)]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        return lo

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of windows in a shard (training position, place in the block's order), and every known word's position with its longest match up to a window."""
        none = np.zeros(0, np.int64)
        array = suffix_array(ids, self.window)
        if not len(self.order) or not len(array):
            return none, none, none, none
        deep = np.full(len(self.order), self.window, np.int64)
        before = self._below(ids, array, self.order, deep, False)
        windows = np.flatnonzero(self.lengths)
        lo = self._below(ids, array, self.order[windows], self.lengths[windows], False)
        count = self._below(ids, array, self.order[windows], self.lengths[windows], True) - lo
        which = np.repeat(windows, count)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        next_ = np.searchsorted(before, np.arange(len(array)), "right")
        longest = np.maximum(*(self._common(ids, array, np.clip(next_ + d, 0, len(self.order) - 1)) for d in (-1, 0)))
        return array[np.repeat(lo, count) + inside], which, array, longest

    def _common(self, ids: np.ndarray, array: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Words that training suffixes share with benchmark suffixes, a window at most."""
        out, live = np.zeros(len(array), np.int64), np.arange(len(array))
        for k in range(self.window):
            p, q = array[live] + k, self.order[near[live]] + k
            ok = (p < len(ids)) & (q < len(self.words))
            live, p, q = live[ok], p[ok], q[ok]
            live = live[(ids[p] == self.words[q]) & (ids[p] > 0)]
            out[live] = k + 1
        return out


def _chains(pos: np.ndarray, which: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Chains of occurrences one word apart in text and item alike: where they begin and how many words they have."""
    place = block.order[which]
    order = np.lexsort((pos, pos - place))
    pos, place, which = pos[order], place[order], which[order]
    new = np.ones(len(pos), bool)
    new[1:] = (np.diff(pos - place) != 0) | (np.diff(pos) != 1) | (np.diff(block.owner[place]) != 0)
    first = np.flatnonzero(new)
    return pos[first], np.diff(np.append(first, len(pos))) - 1 + block.lengths[which[first]]


def shard_report(texts: list[bytes], blocks) -> list:
    """Columns of FIELDS for the texts of one shard."""
    import pyarrow as pa

    split = [split_words(t) for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    starts = np.cumsum(n + 1) - n - 1
    total = int((n + 1).sum())
    hit = np.zeros(total, bool)
    items: list[set[str]] = [set() for _ in texts]
    longest = np.zeros(total, np.int64)  # of the matches that begin at a word
    for block in blocks:
        ids = np.zeros(total, np.uint32)
        get = block.vocab.get
        for s, w in zip(starts.tolist(), split, strict=True):
            if w:
                ids[s : s + len(w)] = [get(x, 0) for x in w]
        pos, which, at, shared = block.search(ids)
        longest[at] = np.maximum(longest[at], shared)
        if not len(pos):
            continue
        edge = np.bincount(pos, minlength=total + 1).astype(np.int64)
        edge -= np.bincount(pos + block.lengths[which], minlength=total + 1)
        hit |= np.cumsum(edge[:total]) > 0
        doc = np.searchsorted(starts, pos, "right") - 1
        for d, k in np.unique(np.stack([doc, block.owner[block.order[which]]]), axis=1).T.tolist():
            items[d].add(block.names[k])
        begin, size = _chains(pos, which, block)
        np.maximum.at(longest, begin, size)
    hits = np.concatenate([[0], np.cumsum(hit)])
    n_hit = hits[starts + n] - hits[starts] if len(texts) else n
    top = np.maximum.reduceat(longest, starts) if len(texts) else n
    best = np.flatnonzero((longest == np.repeat(top, n + 1)) & (longest > 0))
    where = np.full(len(texts), -1, np.int64)
    doc = np.searchsorted(starts, best, "right") - 1
    where[doc[::-1]] = (best - starts[doc])[::-1]  # the leftmost is written last
    digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
    return [pa.array(x) for x in (n, n_hit, [len(x) for x in items], digest, n_hit > 0, top, where)]


def write_blocks(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = 16 << 20) -> list[str]:
    """Files of the benchmark's items in the shared folder, each of about block_bytes of text (or one longer item)."""
    folder = scratch(bench.sparkSession, "benchmark")
    rows = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("name"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        items, held, made = [], 0, []
        store, base = open_fs(folder)
        store.create_dir(base, recursive=True)

        def flush():
            path = f"{base}/block-{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}-{len(made)}"
            with store.open_output_stream(path) as sink:
                sink.write(pickle.dumps(Block(items)))
            made.append(path)

        for batch in batches:
            for name, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if items and held + len(text) > block_bytes:
                    flush()
                    items, held = [], 0
                items.append((name, text))
                held += len(text)
        if items:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["path"])

    dealt = rows.repartition(max(1, math.ceil(size / block_bytes)), F.xxhash64("name", "text"))
    return sorted(f"{folder}|{r['path']}" for r in dealt.mapInArrow(run, "path string").collect())


_OPEN: dict[str, Block] = {}


def opened(blocks: list[str]):
    """The blocks one after another; a worker keeps the last one that it met."""
    for name in blocks:
        if name not in _OPEN:
            _OPEN.clear()
            folder, path = name.split("|")
            with open_fs(folder)[0].open_input_stream(path) as source:
                _OPEN[name] = pickle.loads(source.read())
        yield _OPEN[name]


def _slice_bytes(blocks: list[str]) -> int:
    """More text a shard where many blocks must be opened for each."""
    return min(16, 2 * max(1, len(blocks))) << 20


def find_contamination(docs: DataFrame, bench: DataFrame, keep: list[str] | None = None, **options) -> DataFrame:
    """FIELDS for every document, beside its `keep` columns."""
    blocks = write_blocks(bench, **options)
    return annotate(docs, "text", FIELDS, lambda: lambda texts: shard_report(texts, opened(blocks)), keep or ["doc_id"], _slice_bytes(blocks))


def remove_contaminated(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """`docs` without the documents that hold a benchmark window; same columns."""
    blocks = write_blocks(bench, **options)
    flag = fresh(docs, "contaminated")
    found = annotate(docs, "text", f"`{flag}` boolean", lambda: lambda texts: [shard_report(texts, opened(blocks))[4]], docs.columns, _slice_bytes(blocks))
    return found.where(~F.col(flag)).select(*docs.columns)


def op4_decontaminate(spark, sf_dir):
    """Every document of `documents` against every item of `benchmark`."""
    return find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
