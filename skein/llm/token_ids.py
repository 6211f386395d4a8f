"""Token ids as directly addressable codes.

Documents are spread over shards by ranges of their id and sorted inside a shard; each shard
becomes one file. An id is cut into 8-bit chunks, lowest first. Level k holds the k-th chunk of
every id that has one, and a continuation bitmap tells which of its entries go on to level
k + 1. A rank directory counts the bitmap's ones before each 512-bit block, so the place of an
entry on the next level is one directory read plus the ones of one block: any id can be read
without decoding others.

File: 8 bytes magic, 6 little-endian int64 (levels, tokens, documents, offset of the document
directory, 0, 0), then per level 2 int64 (entries, offset); levels (chunk bytes, bitmap bytes,
uint32 directory, each padded to 8 bytes); last the directory: document ids (int64, a null id
as the smallest int64), document starts (int64, one more than documents).

A task writes under a name of its own and then moves the file to its place; a repeated task
writes the same bytes again, so lost executors and second attempts do no harm. Null texts are
empty and hold the end id alone; equal document ids stand next to each other in text order.
"""

from __future__ import annotations

import uuid
import zlib
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import byte_slices, col, share, shared_path, shared_table
from skein.llm.units import IdEncoder, id_tables
from skein.schema import SEED

MAGIC = b"DACIDS01"
NULL_ID = np.iinfo(np.int64).min
BLOCK = 512
SHARD_BYTES = 12 << 20
BATCH_BYTES = 3 << 20
#: Text from which the driver takes common pretokens, about these bytes in all and at most these
#: characters of a document, and their number.
COMMON_BYTES, COMMON_CHARS, COMMON = 10 << 20, 4096, 150_000

#: Names of object stores in Spark's paths and in pyarrow's, fixed values.
STORES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss", "hdfs": "hdfs", "viewfs": "viewfs"}


def open_store(folder: str):
    """The file system of a folder as Spark names it, and the folder's path there; blanks allowed."""
    from pyarrow import fs

    scheme, colon, rest = folder.partition(":")
    if not colon or scheme == "file":
        local = rest if colon else folder
        return fs.LocalFileSystem(), "/" + local.lstrip("/") if local.startswith("/") else local
    if scheme not in STORES:
        raise ValueError(f"no file system known for {folder}")
    return fs.FileSystem.from_uri(STORES[scheme] + ":" + quote(rest))


def _rank_directory(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed bitmap, padded to whole blocks, and the ones before each block."""
    packed = np.packbits(bits, bitorder="little")
    packed = np.concatenate([packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8)])
    ones = np.bitwise_count(packed.reshape(-1, BLOCK // 8)).sum(1, dtype=np.int64)
    return packed, np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)


def pack(ids: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The pieces of a file; ``starts`` has one entry more than ``doc_ids``."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        bits = rest > 255
        levels.append((len(rest), [(rest & 255).astype(np.uint8), *_rank_directory(bits)]))
        if not bits.any():
            break
        rest = rest[bits] >> 8
    head = len(MAGIC) + 8 * (6 + 2 * len(levels))
    table, body, at = [], [], head
    for entries, arrays in levels:
        table += [entries, at]
        for array in arrays:
            data = array.astype(array.dtype.newbyteorder("<")).tobytes()
            data += bytes(-len(data) % 8)
            body.append(data)
            at += len(data)
    fixed = np.array([len(levels), len(ids), len(doc_ids), at, 0, 0, *table], "<i8").tobytes()
    return [MAGIC, fixed, *body, doc_ids.astype("<i8").tobytes(), starts.astype("<i8").tobytes()]


class TokenFile:
    """Random access to the ids of one file held as bytes (or mapped)."""

    def __init__(self, data):
        self.data = memoryview(data)
        if bytes(self.data[:8]) != MAGIC:
            raise ValueError("not a token id file")
        n_levels, self.n_tokens, self.n_docs, docs = np.frombuffer(self.data, "<i8", 4, 8)
        table = np.frombuffer(self.data, "<i8", 2 * n_levels, 8 + 48).reshape(-1, 2)
        self.levels = []
        for entries, at in table:
            n_bits = -(-int(entries) // BLOCK) * (BLOCK // 8)
            chunks = np.frombuffer(self.data, np.uint8, int(entries), int(at))
            at += entries + -entries % 8
            bitmap = np.frombuffer(self.data, np.uint8, n_bits, int(at))
            ranks = np.frombuffer(self.data, "<u4", n_bits * 8 // BLOCK + 1, int(at) + n_bits)
            self.levels.append((chunks, bitmap, ranks))
        self.doc_ids = np.frombuffer(self.data, "<i8", int(self.n_docs), int(docs))
        self.starts = np.frombuffer(self.data, "<i8", int(self.n_docs) + 1, int(docs) + 8 * int(self.n_docs))

    @staticmethod
    def _rank(bitmap: np.ndarray, ranks: np.ndarray, at: int) -> int:
        """Ones before bit ``at``: one directory entry and the ones of a part of one block."""
        block = at // BLOCK
        byte, bit = divmod(at, 8)
        ones = int(ranks[block]) + int(np.bitwise_count(bitmap[block * (BLOCK // 8) : byte]).sum())
        return ones + (int(bitmap[byte]) & ((1 << bit) - 1)).bit_count() if bit else ones

    def token(self, at: int) -> int:
        """The id at one place, without reading any other id."""
        if not 0 <= at < self.n_tokens:
            raise IndexError(at)
        value, shift = 0, 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[at]) << shift
            if not bitmap[at // 8] >> (at % 8) & 1:
                break
            at, shift = self._rank(bitmap, ranks, at), shift + 8
        return value

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids of a range; ranks are taken at its start alone."""
        out = np.zeros(stop - start, np.uint32)
        places, at, n, shift = None, start, stop - start, 0
        for chunks, bitmap, ranks in self.levels:
            part = chunks[at : at + n].astype(np.uint32) << np.uint32(shift)
            if places is None:
                out |= part
            else:
                out[places] |= part
            byte = at // 8
            bits = np.unpackbits(bitmap[byte : (at + n + 7) // 8], bitorder="little")[at % 8 :][:n].astype(bool)
            if not bits.any():
                break
            places = np.flatnonzero(bits) if places is None else places[bits]
            at, n, shift = self._rank(bitmap, ranks, at), len(places), shift + 8
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


_SHARDS = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("path", T.StringType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_docs", T.LongType()),
    ]
)


def write_token_ids(
    docs: DataFrame,
    vocabulary: str,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    end_id: int = 0,
    folder: str | None = None,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Encode every whole text, append ``end_id`` to each document and write the files into
    ``folder`` (default: a new one in the shared folder). Returns the manifest: shard, path,
    n_tokens, n_docs and first_token (ids in all shards before it); shards ascend with the id."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "token-ids")
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    spread = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    tables = id_tables(vocabulary)
    # some texts tell which pretokens are worth encoding once for all tasks; others are encoded where they occur
    some = rows.sample(min(1.0, COMMON_BYTES / max(1, total)), SEED).select(F.substring("text", 1, COMMON_CHARS).alias("text")).toArrow()
    common = IdEncoder(vocabulary, tables).common_pretokens(pa.concat_arrays(some.column(0).chunks or [pa.array([], pa.string())]), COMMON)
    tables = share(spark, (tables, common))

    def write(batches):
        encoder, ids, doc_ids, counts = None, [], [], []
        for batch in batches:
            if encoder is None:
                made, common = tables()
                encoder = IdEncoder(vocabulary, made, True, common)
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for start, n in byte_slices(sizes, BATCH_BYTES):
                part = batch.slice(start, n)
                found, lengths = encoder.encode(pa.concat_arrays([part.column(1)]))
                ids.append(np.insert(found, np.cumsum(lengths), end_id).astype(np.uint32))
                counts.append(lengths + 1)
                doc_ids.append(pc.fill_null(part.column(0), NULL_ID).to_numpy(zero_copy_only=False))
        if encoder is None:
            return
        starts = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        pieces = pack(np.concatenate(ids), np.concatenate(doc_ids), starts)
        store, base = open_store(folder)
        shard = TaskContext.get().partitionId()
        store.create_dir(base, recursive=True)
        name = f"{base}/part-{shard:06d}.dac"
        own = f"{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(own) as out:
            for piece in pieces:
                out.write(piece)
        store.move(own, name)
        yield pa.RecordBatch.from_pydict(
            {"shard": [shard], "path": [name], "n_tokens": [int(starts[-1])], "n_docs": [len(starts) - 1]},
            schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())]),
        )

    # one row a shard from here on
    manifest = shared_table(spread.mapInArrow(write, _SHARDS), "token-manifest")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    first = manifest.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return first.withColumn("folder", F.lit(folder))


_READ = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def read_token_ids(manifest: DataFrame) -> DataFrame:
    """Read every document back from the files: doc_id, start (ids of all documents before it),
    n_tokens and ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""
    shards = manifest.repartitionByRange(max(1, manifest.agg(F.count("*")).first()[0]), "shard")

    def read(batches):
        for batch in batches:
            for folder, path, first in zip(*(batch.column(c).to_pylist() for c in ("folder", "path", "first_token"))):
                store, _ = open_store(folder)
                with store.open_input_stream(path) as stream:
                    held = TokenFile(stream.read())
                crc = [zlib.crc32(held.document(k).astype("<u4").tobytes()) for k in range(int(held.n_docs))]
                ids = pa.array(held.doc_ids, mask=held.doc_ids == NULL_ID)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(held.starts[:-1] + first), pa.array(np.diff(held.starts)), pa.array(crc, pa.int64())],
                    names=_READ.names,
                )

    return shards.mapInArrow(read, _READ)
