"""64-bit fingerprints of texts, and all pairs of them that differ in few bits.

Two fingerprints that differ in ten bits at most differ in two at most in one of their four 16-bit blocks. So each is compared with those
whose block is within two bits of its own: at 16 bits 1 in 120 of all others, and none within ten bits is missed. The comparisons still grow with
the square of the number of distinct fingerprints, but as a few nanoseconds each, dealt out evenly; every worker holds 16 bytes a fingerprint.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.batches import annotate

WORD = re.compile("[a-z0-9']+")
BLOCKS, BLOCK, INNER = 4, 16, 2
#: Fingerprints of a bucket that the width of blocks aims at, comparisons made at once, fingerprints of a task.
FILL, AT_ONCE, TASK = 48, 1 << 21, 20_000


def fingerprint(text: str) -> int:
    """From the first 64 bits of md5 over every three words in a row, or over the words of a shorter text; 0 without words. Signed."""
    ws = WORD.findall(text.lower())
    grams = [" ".join(x) for x in zip(ws, ws[1:], ws[2:])] if len(ws) > 2 else ws
    if not grams:
        return 0
    digests = np.frombuffer(b"".join(hashlib.md5(g.encode()).digest()[:8] for g in grams), np.uint8).reshape(-1, 8)
    bits = 2 * np.unpackbits(digests, axis=1).sum(axis=0, dtype=np.int64) > len(grams)
    return int(np.packbits(bits).view(">i8")[0])


def prints(items: DataFrame) -> DataFrame:
    """id, h of items (id, content)."""

    def make():
        import pyarrow as pa

        return lambda texts: [pa.array([fingerprint(t.decode()) for t in texts], pa.int64())]

    return annotate(items, "content", "h long", make, ["id"])


def within(values: np.ndarray, width: int, block: int, lo: int, hi: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different values (unsigned) within `most` bits that `block` is the first to show, of its rows `lo` to `hi` with those behind them."""
    inner = np.uint64((1 << width) - 1)
    key = ((values >> np.uint64(BLOCK * block)) & inner).astype(np.int64)
    order = np.argsort(key, kind="stable")
    v, key = values[order], key[order]
    start = np.searchsorted(key, np.arange((1 << width) + 1))
    flips = np.array(sorted({(1 << i) | (1 << j) for i in range(width) for j in range(width)}), np.int64)
    xs, ys = [v[:0]], [v[:0]]
    while lo < hi:
        own = int(key[lo])
        end, near = int(start[own + 1]), own ^ flips
        others = np.concatenate([v[lo:end], *[v[start[o] : start[o + 1]] for o in near[near > own].tolist() if start[o] < start[o + 1]]])
        to = min(hi, end, lo + max(1, AT_ONCE // len(others)))
        i, j = np.nonzero(np.bitwise_count(v[lo:to, None] ^ others) <= most)
        i, j = i[j > i], j[j > i]
        x, y = v[lo:to][i], others[j]
        first = np.ones(len(x), bool)
        for b in range(block):
            first &= np.bitwise_count((x ^ y) & (inner << np.uint64(BLOCK * b))) > INNER
        xs.append(x[first])
        ys.append(y[first])
        lo = to
    return np.concatenate(xs), np.concatenate(ys)


def links(distinct: DataFrame, most: int = 10) -> DataFrame:
    """x, y: all pairs of distinct fingerprints (column h) that differ in up to `most` bits, once each with x < y."""
    if most >= BLOCKS * (INNER + 1):
        raise ValueError(f"at most {BLOCKS * (INNER + 1) - 1} bits")
    spark = distinct.sparkSession
    values = distinct.select("h").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)
    n = len(values)
    width = min(BLOCK, max(0, (n // FILL).bit_length() - 1))
    each = max(1, -(-n // TASK)) if width else 1
    held = spark.sparkContext.broadcast(values)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for task in batch.column(0).to_pylist():
                block, part = divmod(task, each)
                x, y = within(held.value, width, block, n * part // each, n * (part + 1) // each, most)
                x, y = x.view(np.int64), y.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["x", "y"])

    tasks = (BLOCKS if width else 1) * each
    return spark.range(0, tasks, 1, min(tasks, 4096)).mapInArrow(run, "x long, y long")
