"""Words, and the pairs of words that stand near each other, counted in arrays of numbers.

A slice of texts is counted within its task. A word is known by its place in the order of frequency, found by its 64-bit hash, so a pair is one
number, small for common words; pairs leave a task as a few packed blocks, dealt out by their hash, and meet in groups of bounded size. No word is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.store import cut

#: Words that follow a word within its window, words of a slice, pairs that meet in a group at most, about.
SPAN, SLICE, GROUP = 8, 400_000, 4_000_000
SPREAD = 0x9E3779B97F4A7C15


def _slices(batches, column: str):
    """Flat values, and the document of each, of about SLICE values at a time; a document is never cut."""
    import numpy as np

    for batch in batches:
        lists = batch.column(batch.schema.get_field_index(column))
        ends = lists.offsets.to_numpy().astype(np.int64)
        at, flat = 0, lists.values
        while at < len(lists):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
            yield flat.slice(ends[at], ends[to] - ends[at]), np.repeat(np.arange(to - at, dtype=np.int64), np.diff(ends[at : to + 1]))
            at = to


def _near(codes, docs):
    """The two sides of all pairs of different words in a window, one distance at a time."""
    for k in range(1, SPAN + 1):
        keep = (docs[:-k] == docs[k:]) & (codes[:-k] != codes[k:])
        yield codes[:-k][keep], codes[k:][keep]


def index(texts: DataFrame, fields: list[str]) -> DataFrame:
    """field, term, postings, docs, positions: how often a term stands in a field's arrays, in how many rows, and the sum of its places from 0."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for field in fields:
                for flat, docs in _slices([batch], field):
                    coded = flat.dictionary_encode()
                    codes, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
                    place = np.arange(len(docs)) - np.searchsorted(docs, docs)
                    rows = np.unique(docs * size + codes) % max(size, 1)
                    n = [np.bincount(codes, minlength=size), np.bincount(rows, minlength=size), np.bincount(codes, place, size).astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array([field] * size, pa.string()), coded.dictionary, *map(pa.array, n)], names=["field", "term", "postings", "docs", "positions"])

    parts = texts.select(*fields).mapInArrow(count, "field string, term string, postings long, docs long, positions long")
    return parts.groupBy("field", "term").agg(*[F.sum(c).alias(c) for c in ("postings", "docs", "positions")])


def vocabulary(texts: DataFrame, words: str) -> tuple[DataFrame, int, int]:
    """Table w, n, df, h of the words of each row's array, h a hash that no two share; how many words and pairs there are."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for flat, docs in _slices(batches, words):
            coded = flat.dictionary_encode()
            codes, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            seen = np.unique(docs * size + codes) % max(size, 1)
            pairs = sum(len(a) for a, _ in _near(codes, docs))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([coded.dictionary, pa.nulls(1, pa.string())]), pa.array(np.append(np.bincount(codes, minlength=size), pairs)), pa.array(np.append(np.bincount(seen, minlength=size), 0))], names=["w", "n", "df"])

    parts = texts.select(words).mapInArrow(count, "w string, n long, df long")
    found = cut(parts.groupBy("w").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "words")
    pairs = found.where("w is null").first()
    found = found.where("w is not null")
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    for salt in range(64):
        hashed = found.withColumn("h", F.xxhash64("w", F.lit(salt)))
        if not hashed.groupBy("h").count().where("count > 1").limit(1).count():
            break
    return hashed.withColumn("salt", F.lit(salt)), total, pairs["n"] if pairs else 0


def counted(texts: DataFrame, words: str, vocabulary: DataFrame, pairs: int, least: int) -> DataFrame:
    """h1, h2, n of each pair of different words that stand within SPAN words of each other `least` times or more, once for both orders."""
    import numpy as np

    spark = texts.sparkSession
    counts = vocabulary.select("h", "n").toArrow()
    by_n = counts.column("h").to_numpy()[np.argsort(-counts.column("n").to_numpy(), kind="stable")]
    order = np.argsort(by_n)
    known, place, size = by_n[order], order.astype(np.uint32), np.uint64(len(by_n))
    salt = vocabulary.select("salt").limit(1).collect()
    salt = salt[0][0] if salt else 0
    groups = max(1, -(-pairs // GROUP))
    held, named = spark.sparkContext.broadcast((known, place)), spark.sparkContext.broadcast(by_n)

    def pack(batches):
        import pyarrow as pa

        for flat, docs in _slices(batches, "hs"):
            known, place = held.value
            codes = place[np.searchsorted(known, flat.to_numpy(zero_copy_only=False))].astype(np.uint64)
            keys = [np.minimum(a, b) * size + np.maximum(a, b) for a, b in _near(codes, docs)]
            keys, n = np.unique(np.concatenate(keys), return_counts=True)
            if not len(keys):
                continue
            to = ((keys * np.uint64(SPREAD)) >> np.uint64(32)) % np.uint64(groups)
            order = np.argsort(to, kind="stable")
            keys, n, to = keys[order], n[order].astype("<u4"), to[order]
            first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            ends = np.append(first[1:], len(to))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(to[first].astype(np.int32)),
                    pa.array(ends - first),
                    pa.array([_planes(np.diff(keys[a:b], prepend=np.uint64(0)).astype("<u8")) for a, b in zip(first, ends, strict=True)], pa.binary()),
                    pa.array([_planes(n[a:b]) for a, b in zip(first, ends, strict=True)], pa.binary()),
                ],
                names=["part", "size", "keys", "ns"],
            )

    def merge(table):
        import pyarrow as pa

        blocks = table.column("size").to_pylist()
        keys = np.concatenate([np.cumsum(_whole(x, k, "<u8"), dtype=np.uint64) for x, k in zip(table.column("keys"), blocks, strict=True)])
        n = np.concatenate([_whole(x, k, "<u4") for x, k in zip(table.column("ns"), blocks, strict=True)])
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        n = np.add.reduceat(n.astype(np.int64), first)
        keys, n = keys[first[n >= least]], n[n >= least]
        h = named.value
        return pa.table({"h1": h[(keys // size).astype(np.int64)], "h2": h[(keys % size).astype(np.int64)], "n": n})

    hashed = texts.select(F.transform(words, lambda x: F.xxhash64(x, F.lit(salt))).alias("hs"))
    blocks = hashed.mapInArrow(pack, "part int, size long, keys binary, ns binary")
    return blocks.groupBy("part").applyInArrow(merge, "h1 long, h2 long, n long")


def _planes(values) -> bytes:
    """The first bytes of all numbers, then the second ones, ...: alike bytes side by side, compressed."""
    import pyarrow as pa

    return pa.compress(values.view("u1").reshape(len(values), -1).T.tobytes(), codec="zstd", asbytes=True)


def _whole(block, size: int, kind: str):
    import numpy as np
    import pyarrow as pa

    data = np.frombuffer(pa.decompress(block.as_buffer(), size * np.dtype(kind).itemsize, codec="zstd"), "u1")
    return np.ascontiguousarray(data.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
