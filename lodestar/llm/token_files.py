"""Token files with directly addressable codes.

An id is split into 8-bit chunks, lowest first. Level 0 holds the first chunk of every id,
level k the k-th chunk of the ids that have one. A bitmap at each level but the last says
which ids go on, and a rank directory (set bits before every 512) finds their place on the
next level, so any token is read without decoding its block.

A range of tokens is a range of chunks on every level: its place on the next level is the rank of its first token.

File: blocks of up to BLOCK ids, then the document index (id, first token), then the block index, then a
fixed footer. A document may cross blocks. Files hold consecutive ranges of doc_id. Documents are read back
range by range through the ranks; no block is decoded.

Defined cases: a null or empty text is the end id alone; null ids come first and are counted in the footer; equal ids are
ordered by the hash of their text; an empty table writes no documents; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import open_fs, scratch, slices
from lodestar.llm.tokens import encoder, public_path

MAGIC, BLOCK, SPAN = b"DACS0002", 1 << 20, 512
#: documents, those without id, ids, ids a block, blocks, place of document index, place of block index, magic
FOOTER = struct.Struct("<QQQQQQQ8s")


def encode_block(ids: np.ndarray) -> bytes:
    """Number of levels and the size of each, then for each level: chunks, bitmap, rank directory (the last has chunks only)."""
    ids = ids.astype(np.uint32)
    levels, rest = [], ids
    while True:
        more = rest >> 8 > 0
        levels.append((rest.astype(np.uint8), more))
        if not more.any():
            break
        rest = rest[more] >> 8
    out = [struct.pack("<B", len(levels)), np.array([len(c) for c, _ in levels], "<u4").tobytes()]
    for k, (chunk, more) in enumerate(levels):
        out.append(chunk.tobytes())
        if k + 1 < len(levels):
            ranks = np.concatenate([[0], np.cumsum(more)])[0 : len(chunk) + 1 : SPAN].astype("<u4")
            out += [np.packbits(more, bitorder="little").tobytes(), ranks.tobytes()]
    return b"".join(out)


class BlockReader:
    """Access to one encoded block by read(place, bytes): a token or a range costs a few reads a level."""

    def __init__(self, read):
        self.read = read
        (count,) = read(0, 1)
        self.sizes = np.frombuffer(read(1, 4 * count), "<u4").tolist()
        at, self.places = 1 + 4 * count, []
        for k, n in enumerate(self.sizes):
            bits = at + n
            ranks = bits + -(-n // 8)
            self.places.append((at, bits, ranks))
            at = ranks + 4 * (n // SPAN + 1) if k + 1 < count else bits

    @staticmethod
    def of(data: bytes) -> BlockReader:
        return BlockReader(lambda at, n: data[at : at + n])

    def _rank(self, level: int, i: int) -> int:
        """Tokens before i of a level that go on."""
        _, bits, ranks = self.places[level]
        span = i // SPAN
        (before,) = struct.unpack("<I", self.read(ranks + 4 * span, 4))
        head = self.read(bits + span * SPAN // 8, (i >> 3) + 1 - span * SPAN // 8)
        inside = int.from_bytes(head, "little") & ((1 << (i - span * SPAN)) - 1)
        return before + inside.bit_count()

    def get(self, i: int) -> int:
        """Token i, by one step a level."""
        value = 0
        for k, (chunks, bits, _) in enumerate(self.places):
            value |= self.read(chunks + i, 1)[0] << (8 * k)
            if k + 1 == len(self.places) or not self.read(bits + (i >> 3), 1)[0] >> (i & 7) & 1:
                return value
            i = self._rank(k, i)
        return value

    def range(self, a: int, b: int, level: int = 0) -> np.ndarray:
        """Tokens a to b."""
        if a >= b:
            return np.zeros(0, np.uint32)
        chunks, bits, _ = self.places[level]
        own = np.frombuffer(self.read(chunks + a, b - a), np.uint8).astype(np.uint32)
        if level + 1 < len(self.places):
            data = np.frombuffer(self.read(bits + (a >> 3), ((b - 1) >> 3) + 1 - (a >> 3)), np.uint8)
            more = np.flatnonzero(np.unpackbits(data, bitorder="little")[a & 7 : (a & 7) + b - a])
            if len(more):
                first = self._rank(level, a)
                own[more] |= self.range(first, first + len(more), level + 1) << 8
        return own


class FileWriter:
    """Streams documents into one file; memory holds one block and the indexes."""

    def __init__(self, sink, block: int = BLOCK):
        self.sink, self.at, self.ids, self.open, self.open_n, self.block = sink, 0, 0, [], 0, block
        self.docs: list[tuple[int | None, int]] = []
        self.blocks: list[tuple[int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.ids))
        self.ids += len(ids)
        self.open.append(ids)
        self.open_n += len(ids)
        if self.open_n >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        rest = np.concatenate(self.open) if self.open else np.zeros(0, "<u4")
        while len(rest) >= self.block or (last and len(rest)):
            data = encode_block(rest[: self.block])
            self.sink.write(data)
            self.blocks.append((self.at, len(data)))
            self.at += len(data)
            rest = rest[self.block :]
        self.open, self.open_n = [rest], len(rest)

    def close(self) -> None:
        self._flush(True)
        nulls = sum(d is None for d, _ in self.docs)
        names = np.array([d or 0 for d, _ in self.docs], "<i8")
        firsts = np.array([s for _, s in self.docs], "<u8")
        blocks = np.array(self.blocks, "<u8").reshape(-1, 2)
        index = names.tobytes() + firsts.tobytes()
        self.sink.write(index + blocks.tobytes() + FOOTER.pack(len(names), nulls, self.ids, self.block, len(blocks), self.at, self.at + len(index), MAGIC))
        self.sink.close()


class FileReader:
    """Documents of one file in order, or any token by number."""

    def __init__(self, source):
        self.source = source
        source.seek(source.size() - FOOTER.size)
        self.n_docs, self.nulls, self.n_ids, self.size, self.n_blocks, docs, blocks, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(docs)
        self.names = np.frombuffer(source.read(8 * self.n_docs), "<i8")
        self.firsts = np.frombuffer(source.read(8 * self.n_docs), "<u8").astype(np.int64)
        source.seek(blocks)
        self.blocks = np.frombuffer(source.read(16 * self.n_blocks), "<u8").reshape(-1, 2).tolist()

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def token(self, i: int) -> int:
        """Any token, read from the file by single seeks."""
        at, _ = self.blocks[i // self.size]
        return BlockReader(lambda place, n: self._read(at + place, n)).get(i % self.size)

    def documents(self):
        """(doc_id, first token, number of tokens, crc32 of the ids), each by its range; the bytes of one block are held."""
        ends = np.append(self.firsts[1:], self.n_ids)
        held, block = -1, None
        for k, (name, first, end) in enumerate(zip(self.names.tolist(), self.firsts.tolist(), ends.tolist(), strict=True)):
            crc, at = 0, first
            while at < end:
                b = at // self.size
                if b != held:
                    held, block = b, BlockReader.of(self._read(*self.blocks[b]))
                to = min(end, (b + 1) * self.size)
                crc = zlib.crc32(block.range(at - b * self.size, to - b * self.size).astype("<u4").tobytes(), crc)
                at = to
            yield None if k < self.nulls else name, first, end - first, crc


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2) -> list[tuple[str, int, int]]:
    """Files of `docs` in ascending doc_id order: (path, documents, ids) of each, in that order.

    One range shuffle of the texts; each task writes one file below a temporary name and
    renames it, so a task that runs again replaces its own file with the same bytes.
    """
    end = np.array([end_id], "<u4")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        store, base = open_fs(folder)
        store.create_dir(base, recursive=True)
        pid, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        path, part = f"{base}/part-{pid:06d}.dac", f"{base}/.part-{pid:06d}-{attempt}"
        writer = None
        for batch in batches:
            for rows in slices(batch, 2 << 20):
                writer = writer or FileWriter(store.open_output_stream(part))
                ids, starts = encoder(tokenizer, keeps_space=False).encode(rows.column(1).cast(pa.string()))
                for doc, a, b in zip(rows.column(0).to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    writer.add(doc, np.concatenate([ids[a:b], end]))
        if writer:
            writer.close()
            store.move(part, path)
            yield pa.RecordBatch.from_pydict({"pid": [pid], "path": [path], "docs": [len(writer.docs)], "ids": [writer.ids]})

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    placed = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    made = placed.mapInArrow(run, "pid long, path string, docs long, ids long").collect()
    return [(r["path"], r["docs"], r["ids"]) for r in sorted(made, key=lambda r: r["pid"])]


def read_token_files(spark, folder: str, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files."""
    starts = np.concatenate([[0], np.cumsum([n for _, _, n in files])]).tolist()
    plan = [(path, start) for (path, _, _), start in zip(files, starts, strict=False)]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches):
        import pyarrow as pa

        store, _ = open_fs(folder)
        for batch in batches:
            for path, start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found = [(d, start + s, n, crc) for d, s, n, crc in FileReader(store.open_input_file(path)).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    frame = spark.createDataFrame(plan, "path string, start long")
    return frame.repartition(max(1, len(plan))).mapInArrow(run, schema)


def op10_token_files(spark, sf_dir):
    """All of `documents` written as token files and read back."""
    folder = scratch(spark, "tokens")
    files = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_path("word_bpe_49k.json"), folder)
    return read_token_files(spark, folder, files)
