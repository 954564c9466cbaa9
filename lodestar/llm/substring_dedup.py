"""Removal of word windows that occur more than once, with a count-min prefilter.

Every window has an anchor: the smallest hash among its 8-word grams. Equal windows have equal
anchors at different places, so an anchor is counted at least as often as any window it stands for,
at a fourteenth of the cost. Partitions' anchor counts go into a count-min sketch, which is
merged by cell; it overestimates, so a window with an estimate below two is unique. The second pass
groups exactly the windows estimated repeated, by 96-bit hashes of their words. None is lost.

What reaches driver and workers is one bit a cell (estimate of two or more), with a width that
follows the input up to 2**max_bits cells a row; a fuller sketch sends more windows to the second pass
and changes no result. Within a task a window met twice is settled there and sent once, so a passage in a
third of all documents costs a row a task.

Defined cases: null and word-less texts have no words; texts under 35 words lose none; equal texts
repeat all their windows; positions are judged on the input; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.llm.common import slices

WINDOW, GRAM = 35, 8
BASES = (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F)
MIX = 0xD6E8FEB86659FD93
BLOCK = 1 << 20  # cells of a row that travel together
SLICE = 1 << 20  # bytes of text hashed at once


#: 64 random bits for each byte; all white space counts as one space.
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
VALUE = np.random.default_rng(20240607).integers(0, 1 << 64, 256, np.uint64)
VALUE[SPACE] = VALUE[32]


class Windows:
    """Rolling hashes over the words of some texts (UTF-8 bytes) laid end to end.

    White space is brought to one space a word, so the hash of words i to j is that of a byte range: the
    sum of VALUE times powers of a base, modulo 2**64, moved to power 0.
    """

    powers: dict[int, np.ndarray] = {}

    def __init__(self, texts: list[bytes], width: int = WINDOW):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = SPACE[raw]
        before = np.append(True, space[:-1])
        ends = np.flatnonzero(space & ~before)  # the sign behind each word
        self.data = raw[~space | ~before]
        self.stop = np.flatnonzero(SPACE[self.data])
        self.begin = np.append(0, self.stop[:-1] + 1)[: len(self.stop)]
        closed = np.searchsorted(ends, np.cumsum([len(t) + 1 for t in texts]) - 1, "right")
        self.starts = np.append(0, closed[:-1])
        self.n = closed - self.starts
        self.width, total = width, len(self.stop)
        self.sums: dict[int, np.ndarray] = {}
        self.grams, self.anchor_at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if total >= width:
            self.grams = self.roll(0, GRAM)
            self.anchor_at = self._argmin(self.grams, width - GRAM + 1)
        room = np.repeat(closed, self.n) - np.arange(total)
        self.valid = (room >= width)[: len(self.anchor_at)]  # a window begins here

    @classmethod
    def _power(cls, base: int, n: int) -> np.ndarray:
        have = cls.powers.get(base)
        if have is None or len(have) < n:
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            cls.powers[base] = have = np.multiply.accumulate(steps)
        return have[:n]

    def roll(self, which: int, size: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of `size` words from each word (or those `at`) on."""
        base = BASES[which]
        if which not in self.sums:
            own = VALUE[self.data] * self._power(base, len(self.data))
            self.sums[which] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own, out=own)])
        total, n = self.sums[which], len(self.stop) - size + 1
        first, last = (self.begin[:n], self.stop[size - 1 :]) if at is None else (self.begin[at], self.stop[at + size - 1])
        out = (total[last] - total[first]) * self._power(pow(base, -1, 1 << 64), len(self.data))[first]
        out ^= out >> np.uint64(29)
        out *= np.uint64(MIX)
        return out ^ (out >> np.uint64(32))

    def plain(self) -> list[bytes]:
        """Each text's words joined by one space."""
        data = np.where(SPACE[self.data], np.uint8(32), self.data).tobytes()
        return [data[self.begin[a] : self.stop[a + n - 1]] if n else b"" for a, n in zip(self.starts.tolist(), self.n.tolist(), strict=True)]

    @staticmethod
    def _argmin(values: np.ndarray, size: int) -> np.ndarray:
        """Place of the leftmost smallest value in every `size` values in a row."""
        at, v, span = np.arange(len(values)), values, 1
        while span < size:
            step = min(span, size - span)
            right = v[step:] < v[: len(v) - step]
            at = np.where(right, at[step:], at[: len(at) - step])
            v = np.where(right, v[step:], v[: len(v) - step])
            span += step
        return at

    def anchors(self) -> np.ndarray:
        """Hashes of all anchors, once for each place."""
        chosen = np.zeros(len(self.grams), bool)
        chosen[self.anchor_at[self.valid]] = True
        return self.grams[chosen]

    def estimated(self, sketch: Sketch) -> np.ndarray:
        """Window starts whose anchor is estimated to occur twice."""
        starts = np.flatnonzero(self.valid)
        at = self.anchor_at[starts]
        chosen = np.zeros(len(self.grams), bool)
        chosen[at] = True
        places = np.flatnonzero(chosen)
        chosen[places] = sketch.repeated(self.grams[places])
        return starts[chosen[at]]


def cells(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each hash in either row of a sketch."""
    shift = np.uint64(64 - bits)
    return [(hashes >> shift).astype(np.int64), ((hashes * np.uint64(BASES[1])) >> shift).astype(np.int64)]


class Sketch:
    """Two rows of cells; here only the bit `counted twice or more` of each."""

    def __init__(self, bits: int, blocks: dict[int, bytes] | None = None):
        self.bits, self.rows = bits, []
        for row in range(2):
            own = np.zeros(max(1, 1 << bits >> 3), np.uint8)
            for block, data in (blocks or {}).items():
                if block * BLOCK >> bits == row:
                    at = (block * BLOCK & ((1 << bits) - 1)) >> 3
                    own[at : at + len(data)] = np.frombuffer(data, np.uint8)
            self.rows.append(own)

    def repeated(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for row, cell in zip(self.rows, cells(hashes, self.bits), strict=True):
            out &= (row[cell >> 3] >> (cell & 7) & 1).astype(bool)
        return out


def build_sketch(docs: DataFrame, width: int, max_bits: int) -> Sketch:
    """The merged sketch of all documents' anchors."""
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(max_bits, max(20, math.ceil(math.log2(max(1, size / 6 / 14 * 8)))))

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, SLICE):
                rows = cells(Windows(part.column(0).to_pylist(), width).anchors(), bits)
                met, n = np.unique(np.concatenate([rows[0], rows[1] + (1 << bits)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n.astype(np.int64))], names=["cell", "n"])

    def pack(group):
        import pandas as pd

        bitmap = np.zeros(BLOCK, np.uint8)
        bitmap[group["cell"].to_numpy() % BLOCK] = 1
        return pd.DataFrame({"block": [int(group["cell"].iloc[0] // BLOCK)], "bits": [np.packbits(bitmap, bitorder="little").tobytes()]})

    twice = docs.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1").select("cell")
    blocks = twice.groupBy(F.floor(F.col("cell") / BLOCK).alias("of")).applyInPandas(pack, "block long, bits binary")
    return Sketch(bits, {r["block"]: bytes(r["bits"]) for r in blocks.collect()})


def _window_rows(docs: DataFrame, sketch, width: int, flush: int = 2_000_000) -> DataFrame:
    """Windows estimated repeated, by the 96 leading bits of their hashes.

    n = 0: the only occurrence in its task, or with `at` null a window that occurs several times there.
    n > 0: a run of n window starts from `at` on whose windows repeat within the task; its hash is of its own.
    """

    def scan(batches):
        import pyarrow as pa

        held, size = [], 0
        names = ["h1", "h2", "t1", "t2", "at", "n"]

        def emit():
            h1, h2, t1, t2, at, doc = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((h2, h1))
            same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
            head = np.append(True, ~same)
            twice = np.zeros(len(h1), bool)
            twice[order] = ~head | np.append(same, False)
            first = order[head & np.append(same, False)]
            once = ~twice
            yield pa.RecordBatch.from_arrays([pa.array(x[once]) for x in (h1, h2, t1, t2, at)] + [pa.array(np.zeros(once.sum(), np.int32))], names=names)
            k = len(first)
            yield pa.RecordBatch.from_arrays([pa.array(h1[first]), pa.array(h2[first]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.array(np.zeros(k, np.int32))], names=names)
            place = np.flatnonzero(twice)
            if len(place):
                new = np.append(True, (np.diff(at[place]) != 1) | (np.diff(doc[place]) != 0))
                begin = np.flatnonzero(new)
                runs = np.diff(np.append(begin, len(place)))
                p = place[begin]
                own = [t1[p] ^ at[p], t2[p], t1[p], t2[p], at[p], runs.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in own], names=names)

        number = 0
        for batch in batches:
            for part in slices(batch, SLICE):
                w = Windows(part.column(2).to_pylist(), width)
                starts = w.estimated(sketch.value)
                if len(starts):
                    doc = np.searchsorted(w.starts + w.n, starts, "right")
                    t = [part.column(k).to_numpy()[doc] for k in (0, 1)]
                    second = (w.roll(1, width, starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    held.append((w.roll(0, width, starts).view(np.int64), second, *t, (starts - w.starts[doc]).astype(np.int32), doc + number))
                    size += len(starts)
                number += part.num_rows
                if size > flush:
                    yield from emit()
                    held, size = [], 0
        if held:
            yield from emit()

    return docs.select("t1", "t2", "text").mapInArrow(scan, "h1 long, h2 int, t1 long, t2 int, at int, n int")


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col("`doc_id`").alias("doc_id"), F.xxhash64(text).alias("t1"), F.hash(F.lit(1), text).alias("t2"), text.cast("binary").alias("text"))


def repeated_runs(docs: DataFrame, width: int = WINDOW, max_bits: int = 29) -> tuple[DataFrame, object]:
    """(t1, t2, gone) of every text with repeated windows, gone as intervals of words, and the broadcast sketch."""
    sketch = docs.sparkSession.sparkContext.broadcast(build_sketch(docs, width, max_bits))
    rows = _window_rows(docs, sketch, width).repartition("h1", "h2")
    # copies of a text count for their windows, then one row for each place in the text goes on
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("h1", "h2", "t1", "t2", "at").orderBy(F.desc("n"))))
    rows = rows.withColumn("met", F.count("*").over(Window.partitionBy("h1", "h2")))
    runs = rows.where("at is not null and copy = 1 and (n > 0 or met > 1)").select("t1", "t2", "at", F.greatest("n", F.lit(1)).alias("n"))
    # runs whose words touch become one interval of words, so what is joined to a text is short
    along = Window.partitionBy("t1", "t2").orderBy("at")
    last = F.max(F.col("at") + F.col("n") - 1).over(along.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("gap", (last.isNull() | (F.col("at") > last + width)).cast("int"))
    runs = runs.withColumn("island", F.sum("gap").over(along))
    runs = runs.groupBy("t1", "t2", "island").agg(F.min("at").alias("a"), (F.max(F.col("at") + F.col("n")) - 1 + width).alias("b"))
    return runs.groupBy("t1", "t2").agg(F.collect_list(F.struct("a", "b")).alias("gone")), sketch


def _kept(words: list[bytes], begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    """The words outside all intervals."""
    gone = np.bincount(begin, minlength=len(words) + 1) - np.bincount(end, minlength=len(words) + 1)
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def remove_repeats(docs: DataFrame, text_col: str = "text", width: int = WINDOW, with_text: bool = False, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept words as `kept_text`) of every document.

    Texts without a window estimated repeated are settled where they are read; only the others are shuffled.
    """
    keyed = _keyed(docs, text_col)
    runs, sketch = repeated_runs(keyed, width, **options)
    out = keyed.schema["doc_id"].dataType.simpleString()
    middle = f"doc_id {out}, t1 long, t2 int, text binary, n_words long"

    def settle(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, SLICE):
                raw = part.column(3).to_pylist()
                w = Windows(raw, width)
                open_ = np.zeros(len(raw), bool)
                open_[np.searchsorted(w.starts + w.n, w.estimated(sketch.value), "right")] = True
                texts = [t if o else (p if with_text else hashlib.sha256(p).hexdigest().encode()) for t, o, p in zip(raw, open_, w.plain(), strict=True)]
                n = pa.array([None if o else k for o, k in zip(open_, w.n.tolist(), strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(texts, pa.binary()), n], names=["doc_id", "t1", "t2", "text", "n_words"])

    def finish(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, SLICE):
                gone_lists = part.column(2)
                sizes = np.nan_to_num(gone_lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                ends = np.cumsum(sizes)
                begin, end = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in gone_lists.flatten().flatten())
                n_words, removed, digest, kept_text = [], [], [], []
                for text, n, a, b in zip(part.column(3).to_pylist(), part.column(1).to_pylist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                    gone, kept = 0, text
                    if n is None:
                        words = text.split()
                        stay = _kept(words, begin[a:b], end[a:b]) if b > a else words
                        n, gone, kept = len(words), len(words) - len(stay), b" ".join(stay)
                        digest.append(hashlib.sha256(kept).hexdigest())
                    else:
                        digest.append(hashlib.sha256(text).hexdigest() if with_text else text.decode())
                    n_words.append(n)
                    removed.append(gone)
                    kept_text.append(kept)
                arrays = [part.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
                arrays += [pa.array([k.decode("utf-8", "replace") for k in kept_text], pa.string())] if with_text else []
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])

    settled = keyed.mapInArrow(settle, middle).join(runs, ["t1", "t2"], "left").select("doc_id", "n_words", "gone", "text")
    return settled.mapInArrow(finish, f"doc_id {out}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def op8_substring_dedup(spark, sf_dir):
    """All of `documents` without words in repeated 35-word windows."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
