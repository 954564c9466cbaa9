"""Hierarchical weighted hash tree (native: DataFrame functions only).

A document descends region, rack and shard. At each level every child draws
ln(u) / weight with u a hash of (doc_id, child) in (0, 1), and the largest draw wins,
which picks children in proportion to weight. A child's draw rests on its own weight
alone, so a change of weight moves rows only into or out of the subtrees that change.

A shard added to a full tree is hung below a new region of its own; only the new
region's draw is new, so rows move into the new shard and nowhere else.

Defined cases: a null text counts as empty (size 1, crc32 0); null ids hash as the text
"null"; equal ids go to one shard and get distinct slots; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

Tree = dict[str, dict[str, dict[int, float]]]


def build_tree(shards: int, per_rack: int = 4, racks_per_region: int = 2, added: int = 0, weights: dict[int, float] | None = None) -> Tree:
    """region -> rack -> shard -> weight (1 unless named); each of the `added` last shards has a region of its own."""
    weight = (weights or {}).get
    tree: Tree = {}
    for s in range(shards):
        rack, region = s // per_rack, s // (per_rack * racks_per_region)
        tree.setdefault(f"g{region}", {}).setdefault(f"r{rack}", {})[s] = weight(s, 1.0)
    for s in range(shards, shards + added):
        tree[f"x{s}"] = {f"x{s}": {s: weight(s, 1.0)}}
    return tree


def _draw(key: Column, node: str, weight: float) -> Column:
    """ln(u) / weight, u from the first 52 bits of an md5."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{node}"))), 1, 13), 16, 10).cast("double")
    return F.log((bits + 0.5) / float(2**52)) / weight


def _pick(key: Column, children: dict[str, tuple[float, Column]]) -> Column:
    """The value of the child with the largest draw; ties go to the first."""
    if len(children) == 1:
        return next(iter(children.values()))[1]
    drawn = [F.struct(_draw(key, name, weight).alias("d"), F.lit(-i).alias("i")) for i, (name, (weight, _)) in enumerate(children.items())]
    best = F.greatest(*drawn)["i"]
    return reduce(lambda rest, iv: F.when(best == -iv[0], iv[1]).otherwise(rest), list(enumerate(v for _, v in children.values()))[:-1], list(children.values())[-1][1])


def tree_shard(key: Column, tree: Tree) -> Column:
    """The shard of `key` (a string) by descent through `tree`."""
    regions = {}
    for region, racks in tree.items():
        below = {}
        for rack, shards in racks.items():
            leaf = {f"{region}/{rack}/{s}": (w, F.lit(s)) for s, w in shards.items()}
            below[f"{region}/{rack}"] = (sum(shards.values()), _pick(key, leaf))
        regions[region] = (sum(w for w, _ in below.values()), _pick(key, below))
    return _pick(key, regions).cast("int")


def assign_shards(docs: DataFrame, shards: int = 16, slots_in: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, gapless slot and the shard after one more is added, for every document.

    Slots are numbered within (shard, cell), `slots_in` cells by hash of the id, and moved
    up by a running sum of the cells' counts. No window holds a whole shard, and the
    table of counts has shards x slots_in rows at most, whatever the input.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    cell = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % slots_in
    placed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        tree_shard(key, build_tree(shards)).alias("shard"),
        cell.alias("cell"),
        tree_shard(key, build_tree(shards, added=1)).alias("grown_shard"),
    )
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "cell").orderBy("doc_id", "size", "text_crc32")
    numbered = placed.withColumn("rank", F.row_number().over(within) - 1)
    return numbered.join(starts, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"), "grown_shard"
    )


def op3_sharding(spark, sf_dir):
    """All of `documents` into shards 0 to 15 under the law `key`."""
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
