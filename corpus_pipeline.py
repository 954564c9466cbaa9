"""Five stages from raw documents to packed training sequences."""

from __future__ import annotations

from lodestar.llm.common import cut
from lodestar.llm.decontaminate import remove_contaminated
from lodestar.llm.packing import pack, token_pieces
from lodestar.llm.quality_cnn import keep_good
from lodestar.llm.secrets import redact
from lodestar.llm.simhash import drop_near_duplicates
from lodestar.llm.tokens import public_path


def quality(spark, docs, sf_dir):
    """Documents that the classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of linked fingerprints stays."""
    return drop_near_duplicates(docs)


def decontamination(spark, docs, sf_dir):
    """Documents with a benchmark window go."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark, docs, sf_dir):
    """Secrets in the texts are masked; every document stays."""
    return redact(docs)


def packing(spark, docs, sf_dir):
    """Token pieces with their sequence and offset."""
    return pack(token_pieces(docs, public_path("byte_bpe_50k.json")))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: A fitted network and field, and a search for few sequences: tested against plain versions instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over `documents`, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
