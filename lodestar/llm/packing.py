"""Packing of token pieces into sequences by swap-based local search.

The search works on the histogram of piece lengths, not on pieces: bins with the same
contents are one group with a multiplicity, so the driver's work follows the number of distinct
lengths and not the corpus. It begins with every piece in a bin of its own. Local search then moves pieces and
exchanges one for one or two for one between underfull bins, always from an emptier bin to a
fuller one, which raises the sum of squared fill, until bins empty and nothing improves. Pieces then
get seats by their rank within their length.

Defined cases: a null or empty text is the end id alone; equal ids and repeated rows are separate
pieces; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.llm.common import cut, fresh, slices
from lodestar.llm.tokens import encoder, public_path

NONE = 1 << 40  # a fill that no bin has
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row a piece: the first piece of a document takes what whole pieces leave over."""
    schema = PIECE_SCHEMA + (", ids binary" if with_ids else "")
    end = np.array([end_id], "<u4")

    def run(batches):
        import pyarrow as pa

        tokens = encoder(tokenizer, keeps_space=True)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for part in slices(batch, 2 << 20):
                cols: list[list] = [[] for _ in range(5 + with_ids)]
                ids, starts = tokens.encode(part.column(1).cast(pa.string()))
                for doc, a, b in zip(part.column(0).to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    n = b - a + 1
                    own = memoryview(np.concatenate([ids[a:b], end])).cast("B")
                    at, piece, step = 0, 0, n % capacity or capacity
                    while at < n:
                        data = own[at * 4 : (at + step) * 4]
                        for c, v in zip(cols, (doc, piece, at, step, zlib.crc32(data), data), strict=False):
                            c.append(v)
                        at, piece, step = at + step, piece + 1, capacity
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names=[x.split()[0] for x in schema.split(", ")])

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text")).mapInArrow(run, schema)


class Bins:
    """Bins in groups: contents (lengths, longest first) -> how many bins hold just that."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.full: Counter = Counter()
        self.open: dict[tuple[int, ...], int] = {}
        #: Accepted steps by kind, each counted once a bin.
        self.steps: Counter = Counter()
        self.total = 0
        self._holders: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(capacity + 1)]
        #: The lowest fill of an open bin that holds a piece of this length.
        self.lowest = np.full(capacity + 1, NONE, np.int64)
        self._sums: dict[tuple[int, ...], list[int]] = {}

    def add(self, contents: tuple[int, ...], times: int = 1) -> None:
        fill = sum(contents)
        if not times or not contents:
            return
        self.total += times
        if fill == self.capacity:
            self.full[contents] += times
            return
        if contents not in self.open:
            for a in set(contents):
                heappush(self._holders[a], (fill, contents))
                self.lowest[a] = min(self.lowest[a], fill)
        self.open[contents] = self.open.get(contents, 0) + times

    def take(self, contents: tuple[int, ...], times: int) -> None:
        """Take out `times` open bins with these contents."""
        self.total -= times
        self.open[contents] -= times
        if not self.open[contents]:
            del self.open[contents]
            self._sums.pop(contents, None)
            for a in set(contents):
                self._settle(a)

    def _settle(self, length: int) -> None:
        heap = self._holders[length]
        while heap and heap[0][1] not in self.open:
            heappop(heap)
        self.lowest[length] = heap[0][0] if heap else NONE

    def holder(self, length: int, bin_: tuple[int, ...], fill: int) -> tuple[int, ...] | None:
        """The emptiest open bin of at most `fill` with a piece of `length`, other than a bin_ that is the only one of its kind."""
        heap = self._holders[length]
        top = heap[0][1]
        if top != bin_ or self.open[bin_] > 1:
            return top
        return min((x for x in heap if x[0] <= fill and x[1] != bin_ and x[1] in self.open), default=(0, None))[1]

    def pair_sums(self, contents: tuple[int, ...]) -> list[int]:
        """What two pieces of the bin make together, in order."""
        if contents not in self._sums:
            own = Counter(contents)
            kinds = sorted(own)
            self._sums[contents] = sorted({a + b for i, a in enumerate(kinds) for b in kinds[i:] if a != b or own[a] > 1})
        return self._sums[contents]

    def groups(self):
        """(contents, how many bins), full ones first, then from the fullest to the emptiest."""
        yield from self.full.items()
        yield from sorted(self.open.items(), key=lambda g: (-sum(g[0]), g[0]))

    def count(self) -> int:
        return self.total

    def least(self) -> int:
        """The lower bound: total length over capacity."""
        return -(-sum(sum(c) * n for c, n in self.groups()) // self.capacity)


def one_each(histogram: dict[int, int], capacity: int) -> Bins:
    """Every piece in a bin of its own."""
    bins = Bins(capacity)
    for length, n in histogram.items():
        bins.add((length,), n)
    return bins


def _swapped(contents: tuple[int, ...], out: tuple[int, ...], into: tuple[int, ...]) -> tuple[int, ...]:
    rest = list(contents)
    for x in out:
        rest.remove(x)
    return tuple(sorted([*rest, *into], reverse=True))


def _split(contents: tuple[int, ...], total: int) -> tuple[int, int]:
    """Two pieces of the bin that make `total`."""
    own = Counter(contents)
    return next((a, total - a) for a in own if total - a in own and (2 * a != total or own[a] > 1))


def best_step(bins: Bins, bin_: tuple[int, ...], failed: set) -> tuple | None:
    """(donor, given, got): the step that fills an open bin most, taking from bins that are no fuller.

    A move gives one piece for none; exchanges give one for one, one for two or two for one. The first
    kind that fills the bin to the brim is taken, else the one that gains most. `failed` holds bins and
    donors without a two-for-one step, which depends on their contents alone.
    """
    fill = sum(bin_)
    room, best, gain = bins.capacity - fill, None, 0
    backs = [(0, ()), *[(x, (x,)) for x in sorted(set(bin_))]]
    for kind in (backs[:1], backs[1:], [(x, None) for x in bins.pair_sums(bin_)] if len(bin_) > 1 else []):
        for back, got in kind:
            low = back + gain + 1
            for a in (np.flatnonzero(bins.lowest[low : back + room + 1] <= fill)[::-1] + low).tolist():
                donor = bins.holder(a, bin_, fill)
                if donor:
                    best, gain = (donor, (a,), _split(bin_, back) if got is None else got), a - back
                    break
            if gain == room:
                return best
    for donor in bins.open:
        if len(donor) < 2 or sum(donor) > fill or (bin_, donor) in failed or (donor == bin_ and bins.open[bin_] < 2):
            continue
        sums, found = bins.pair_sums(donor), False
        for back, got in backs[1:]:
            k = bisect_right(sums, back + room) - 1
            if k >= 0 and sums[k] > back:
                found = True
                if sums[k] - back > gain:
                    best, gain = (donor, _split(donor, sums[k]), got), sums[k] - back
        if gain == room:
            return best
        if not found:
            failed.add((bin_, donor))
    return best


def apply_step(bins: Bins, bin_: tuple[int, ...], donor: tuple[int, ...], given: tuple[int, ...], got: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Make the step in as many bins of both groups as go together; lone pieces move in as often as they fit. Returns the new contents."""
    m, n = bins.open[bin_], bins.open[donor]
    if donor == given and not got:
        k = min((bins.capacity - sum(bin_)) // given[0], n - 1 if donor == bin_ else n)
        times = n // (k + 1) if donor == bin_ else min(m, n // k)
        bins.take(bin_, times)
        bins.take(donor, times * k)
        made = [tuple(sorted([*bin_, *given * k], reverse=True))]
        bins.steps["move"] += times * k
    else:
        times = n // 2 if donor == bin_ else min(m, n)
        bins.take(bin_, times)
        bins.take(donor, times)
        made = [_swapped(bin_, got, given), _swapped(donor, given, got)]
        bins.steps["move" if not got else "one for one" if len(given) == len(got) else "two for one"] += times
    for contents in made:
        bins.add(contents, times)
    return made


def local_search(bins: Bins, tolerance: float = 1e-5) -> Bins:
    """Fill the fullest open bins from emptier ones by moves and exchanges until bins empty.

    A pass goes through all open bins and fills each as far as any step goes. Every step takes from a bin that is
    no fuller and so raises the sum of squared fill. Passes end at the lower bound, when one makes no step, or when two
    in a row empty no bin or, of very many, less than a share of `tolerance`.
    """
    least, quiet = bins.least(), 0
    failed: set = set()
    while bins.count() > least and quiet < 2:
        before, made = bins.count(), bins.steps.total()
        queue = [(-sum(c), c) for c in bins.open]
        heapify(queue)
        while queue and bins.count() > least:
            _, bin_ = heappop(queue)
            while bin_ in bins.open and bins.count() > least and (step := best_step(bins, bin_, failed)):
                fuller = apply_step(bins, bin_, *step)[0]
                if fuller in bins.open:
                    heappush(queue, (-sum(fuller), fuller))
        quiet = 2 if bins.steps.total() == made else quiet + 1 if before - bins.count() <= tolerance * before else 0
    return bins


def seats(bins: Bins) -> dict[str, np.ndarray]:
    """Interval table: pieces of a length, by rank, to sequences and offsets.

    Row: pieces of `length` with ranks from `rank` on sit `each` to a bin, from bin `first` and from `offset` on.
    """
    rows, used, first = [], Counter(), 0
    for contents, times in bins.groups():
        offset = 0
        for length, each in sorted(Counter(contents).items(), reverse=True):
            rows.append((length, used[length], each, first, offset))
            used[length] += each * times
            offset += length * each
        first += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "first", "offset"), table.T, strict=True))


def pack(pieces: DataFrame, capacity: int = 2048, cell_rows: int = 20_000) -> DataFrame:
    """`pieces` (any columns with a `length` of 1 to capacity) plus sequence_id and offset.

    Ranks within a length are numbered in cells by hash, of about `cell_rows` rows each, and moved up by the cells'
    running counts, so no window holds a whole length. The driver gets one count for each length.
    """
    pieces = cut(pieces, "pieces")
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = spark.sparkContext.broadcast(seats(local_search(one_each(histogram, capacity))))
    names = [c for c in pieces.columns if c != "ids"]
    cell, rank, many, n, start = (fresh(pieces, x) for x in ("cell", "rank", "cells", "cell_n", "cell_start"))
    sizes = spark.createDataFrame([(k, v // cell_rows + 1) for k, v in histogram.items()], f"length long, `{many}` long")  # at most `capacity` rows
    row = pieces.join(F.broadcast(sizes), "length").withColumn(cell, F.pmod(F.xxhash64(*names), F.col(many)))
    counts = row.groupBy("length", cell).agg(F.count("*").alias(n))
    before = Window.partitionBy("length").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", cell, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    within = Window.partitionBy("length", cell).orderBy(*names)
    ranked = row.withColumn(rank, F.row_number().over(within) - 1).join(starts, ["length", cell])
    ranked = ranked.select(*pieces.columns, (F.col(start) + F.col(rank)).alias(rank))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"

    def seat(batches):
        import pyarrow as pa

        t = table.value
        keys = t["length"] << 44 | t["rank"]
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.num_columns - 1).to_numpy().astype(np.int64)
            k = np.searchsorted(keys, length.astype(np.int64) << 44 | rank, "right") - 1
            inner = rank - t["rank"][k]
            bin_id = t["first"][k] + inner // t["each"][k]
            offset = t["offset"][k] + inner % t["each"][k] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bin_id), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(seat, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids themselves: one row a sequence, from pieces made with_ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op5_packing(spark, sf_dir):
    """All of `documents` in sequences of at most 2048 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(token_pieces(docs, public_path("byte_bpe_50k.json")))
