"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints within 4 bits differ in at most 4 of their 8 bytes, so they share 4 positional
bytes or more: the guaranteed minimum. Posting lists of single positional bytes would grow with the
square of the corpus, so the index has lists for three positions together: 20 of the 56 triples, chosen so that
any 4 positions hold one of them. A pair with the minimum meets in a list for certain; pairs with three shared
bytes meet too. Within a list the shared positional bytes of a pair are tallied, pairs that reach
4 are retained and verified bit by bit. A list yields a spanning forest of its links, never all pairs. Equal
fingerprints are one entry with their smallest doc_id.

A list longer than `list_rows` is passed on as it streams by and split by a fourth position (5 lists: a pair
that counts shares one more byte). Where these are long still, members differ in at most 4 of the 8
half-bytes left, so 4 half-bytes are equal, which makes 70 shorter lists of at most 65,536 distinct
members each. No pair is lost.

Defined cases: null, empty and word-less texts have fingerprint 0 and link like any other;
null ids take part but are never a component's smallest id unless all ids are null; repeated rows are
linked as equal; where one document of a group stays, it is the one with the smallest id and, of rows that share it, the smallest fingerprint; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import annotate, cut, fresh

BITS, LINK, SEED, LEAST = 64, 4, 42, 4
#: Positions in three classes; triples within a class, or two of one class and one of the next.
CLASSES = ((0, 1, 2), (3, 4, 5), (6, 7))
TRIPLES = [t for t in combinations(range(8), 3) if any(len(set(t) & set(c)) == 3 or (len(set(t) & set(c)) == 2 and set(t) & set(CLASSES[(k + 1) % 3])) for k, c in enumerate(CLASSES))]


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64 bits, each set if it is set in over half of the shingles' XXH64."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(gaps[: n - 1] + 1).tolist()]
    ends = [*gaps[shingle - 1 : shingle - 1 + n - 1].tolist(), len(joined)] if len(words) > shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 14):
        block = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keep: list[str], name: str = "fp", shingle: int = 4) -> DataFrame:
    """`keep` columns and the fingerprint as a signed long."""

    def make():
        import pyarrow as pa

        def work(texts):
            return [pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))]

        return work

    return annotate(docs, "text", f"`{name}` long", make, keep)


def _distance(a, b):
    return np.bitwise_count((a ^ b).view(np.uint64))


def _shared(a, b):
    """How many of the 8 positional bytes are equal."""
    x = np.atleast_1d(np.bitwise_xor(a, b)).view(np.uint8).reshape(-1, 8)
    return (x == 0).sum(axis=1)


def near(a, b):
    """The count filter, then the verification."""
    ok = _shared(a, b) >= LEAST
    return ok & (np.atleast_1d(_distance(a, b)) <= LINK)


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct values: breadth first, each value met once."""
    rest, out = values, []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            linked = near(rest, x)
            if linked.any():
                found = rest[linked]
                out += [(int(x), int(y)) for y in found]
                queue += list(found)
                rest = rest[~linked]
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bytes_mask(positions) -> int:
    return sum(0xFF << (8 * p) for p in positions)


def _listed(rows: DataFrame, masks: list[list[int]], chosen) -> DataFrame:
    """`rows` (fp, ...) once for each mask of the row's set: `pick` and what the fingerprint shows through the mask."""
    table = F.array(*[F.array(*[F.lit(_signed(m)).cast("long") for m in own]) for own in masks])
    out = rows.select("*", F.posexplode(F.get(table, chosen)).alias("pick", "mask"))
    return out.withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).drop("mask")


def _run_forests(rows: DataFrame, most: int) -> DataFrame:
    """Links of each posting list (which, key, fp). The members of a list over `most` are passed on instead (b null) as they stream by."""
    ordered = rows.select("which", "key", "fp").repartition("which", "key").sortWithinPartitions("which", "key", "fp")

    def run(batches):
        import pyarrow as pa

        names = ["which", "key", "a", "b"]

        def passed(which, key, fps):
            return pa.RecordBatch.from_arrays([pa.array(which), pa.array(key), pa.array(fps), pa.nulls(len(fps), pa.int64())], names=names)

        def emit(which, key, fps):
            """Links of whole lists, and those too long."""
            first = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (key[1:] != key[:-1])))
            sizes = np.diff(np.append(first, len(fps)))
            two = first[sizes == 2]
            two = two[near(fps[two], fps[two + 1])] if len(two) else two
            a, b = [fps[two]], [fps[two + 1]]
            for s, n in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                if n > most:
                    yield passed(which[s : s + n], key[s : s + n], fps[s : s + n])
                    continue
                links = np.array(forest(fps[s : s + n]), np.int64).reshape(-1, 2)
                a.append(links[:, 0])
                b.append(links[:, 1])
            a, b = np.concatenate(a), np.concatenate(b)
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            if len(lo):
                lo, hi = np.unique(np.stack([lo, hi]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(lo), pa.int64()), pa.nulls(len(lo), pa.int64()), pa.array(lo), pa.array(hi)], names=names)

        held: list = []  # parts of the list at the end of the last batch
        held_n, passing = 0, False
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            if not len(cols[0]):
                continue
            if held and (held[0][0][0], held[0][1][0]) != (cols[0][0], cols[1][0]):
                if not passing:
                    yield from emit(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held, held_n, passing = [], 0, False
            change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            tail = int(change[-1]) if len(change) else 0
            if tail:  # lists that end in this batch
                if passing:
                    yield passed(*(c[: change[0]] for c in cols))
                    done = [c[change[0] : tail] for c in cols]
                else:
                    done = [np.concatenate(c) for c in zip(*held, [c[:tail] for c in cols], strict=True)]
                held, held_n, passing = [], 0, False
                if len(done[0]):
                    yield from emit(*done)
            rest = [c[tail:] for c in cols]
            if passing:
                yield passed(*rest)
                held = [[c[-1:] for c in rest]]
                continue
            held.append(rest)
            held_n += len(rest[0])
            if held_n > most:
                for part in held:
                    yield passed(*part)
                held, held_n, passing = [[c[-1:] for c in rest]], 0, True
        if held and not passing:
            yield from emit(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return ordered.mapInArrow(run, "which long, key long, a long, b long")


def links(fps: DataFrame, list_rows: int = 20_000) -> DataFrame:
    """(a, b) pairs of distinct fingerprints that span every component of the link graph."""
    lists = _listed(fps.select("fp"), [[_bytes_mask(t) for t in TRIPLES]], F.lit(0)).select("fp", F.col("pick").cast("long").alias("which"), "key")
    found = cut(_run_forests(lists, list_rows), "op2-lists")
    pairs = found.where("b is not null").select("a", "b")
    large = found.where("b is null").select(F.col("a").alias("fp"), F.col("which").alias("list"))
    if large.limit(1).count():
        fours = [[_bytes_mask({*t, p}) for p in range(8) if p not in t] for t in TRIPLES]
        split = _listed(large, fours, F.col("list").cast("int")).select("fp", (F.col("list") * 5 + F.col("pick")).alias("which"), "key")
        found = cut(_run_forests(split, list_rows), "op2-fours")
        pairs = pairs.unionByName(found.where("b is not null").select("a", "b"))
        large = found.where("b is null").select(F.col("a").alias("fp"), F.col("which").alias("list"))
        if large.limit(1).count():
            halves = []
            for t in TRIPLES:
                for p in (p for p in range(8) if p not in t):
                    free = [8 * q + h for q in range(8) if q not in t and q != p for h in (0, 4)]
                    halves.append([_bytes_mask({*t, p}) | sum(0xF << h for h in pick) for pick in combinations(free, 4)])
            split = _listed(large, halves, F.col("list").cast("int")).select("fp", (F.col("list") * 70 + F.col("pick")).alias("which"), "key")
            pairs = pairs.unionByName(_run_forests(split, 1 << 62).where("b is not null").select("a", "b"))
    return pairs.distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component, by large-star and small-star steps.

    Each step is a group-by with partial minima and one join; it is written to the shared folder, and steps end when
    no edge changes. Chains halve with every pair of steps.
    """
    e = cut(edges.select("a", "b"), "edges")
    last = None
    for _ in range(rounds):
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours go to the smallest; small star: smaller ones and the node itself
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        large = cut(large.where("x <> y").distinct(), "large")
        low = large.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        m = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(m, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        small = small.unionByName(m.select(F.col("a").alias("x"), F.col("m").alias("y")))
        e = cut(small.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "small")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def group_documents(prints: DataFrame, with_root: bool = False) -> DataFrame:
    """`prints` (id, fp) with component_id, the smallest id reachable by links, or with the component's root."""
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("least")), "op2-nodes")
    # the node with the smallest value is the root; the smallest id of the component is taken afterwards
    roots = components(links(nodes))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    if with_root:
        return prints.join(named.select("fp", "root"), "fp")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every document."""
    prints = cut(fingerprints(docs, [id_col]).withColumnRenamed(id_col, "id"), "op2-prints")
    grouped = group_documents(prints)
    return grouped.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One document of each component, the one with the smallest id (nulls last); same columns.

    Documents are told apart by id and fingerprint together: two texts under one id, or without any, are two
    documents unless they are linked.
    """
    fp, only, its = fresh(docs, "fp"), fresh(docs, "keep_id"), fresh(docs, "keep_fp")
    marked = cut(fingerprints(docs, docs.columns, fp), "op2-marked")
    prints = marked.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{fp}`").alias("fp"))
    grouped = group_documents(prints, with_root=True)
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "fp")).alias("k"))
    keep = first.select(F.col("k.id").alias(only), F.col("k.fp").alias(its))
    kept = marked.join(keep, F.col(f"`{id_col}`").eqNullSafe(F.col(only)) & (F.col(f"`{fp}`") == F.col(its)), "left_semi")
    repeated = prints.groupBy("id", "fp").count().where("count > 1").limit(1).count()
    return (kept.dropDuplicates([id_col, fp]) if repeated else kept).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_simhash(spark, sf_dir):
    """All of `documents` grouped by linked fingerprints."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
