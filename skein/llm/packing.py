"""Best-fit packing of documents into sequences of several permitted lengths.

A document has one token per word ``[^\\x20\\x09-\\x0D]+`` and one end token (or the length that a
column gives). Documents longer than the longest sequence are cut: full pieces fill sequences of
their own, the rest is packed like any other piece. No token is dropped.

Documents are dealt to shards in turn, about ``shard_pieces`` to a shard, and each shard is
packed on its own, so bins hold pieces of one shard and a shard wastes its own few last bins.
Inside a shard pieces go by falling length into the open bin with the
least room that takes them (best fit; equal rooms: the bin opened first). Where none does, a bin
is opened: of the permitted sizes that take the piece the one with the least net cost, which is
its cost less what the tokens still to come are worth in it. They are worth what a token costs in
the cheapest size per token, and no more of them are counted than are left. So long sequences are
opened while short pieces can still fill them, and shorter ones towards the end. At last every
bin is downsized to the shortest permitted length that holds its contents.

A null or empty text is one end token. A null length counts as 0 and, like a negative one, raises
no error: the piece takes no room and joins any bin. Repeated rows are packed as often as they
occur. Bins are named shard:number.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import col, free_name, map_texts, shared_table, split_words


@dataclass(frozen=True)
class PackingSettings:
    #: Permitted sequence lengths, and what one sequence costs besides its tokens.
    sizes: tuple[int, ...] = (256, 512, 1024, 2048)
    overhead: float = 24.0
    shard_pieces: int = 20_000

    def cost(self, size: int) -> float:
        return size + self.overhead


def pack_pieces(lengths: Sequence[int], settings: PackingSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin and the place inside it of each piece, and the final size of each bin."""
    sizes = sorted(settings.sizes)
    worth = min(settings.cost(s) / s for s in sizes)
    order = np.argsort(-np.asarray(lengths, np.int64), kind="stable")
    left = int(np.sum(lengths))
    rooms: list[int] = []  # of open bins, ascending
    bins_by_room: dict[int, list[int]] = {}
    filled: list[int] = []
    room_of: list[int] = []
    bin_of, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order:
        length = int(lengths[i])
        left -= length
        at = bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms[at]
            waiting = bins_by_room[room]
            number = waiting.pop(0)
            if not waiting:
                rooms.pop(at)
                del bins_by_room[room]
        else:
            size = min(
                (s for s in sizes if s >= length),
                key=lambda s: (settings.cost(s) - worth * min(s - length, left), s),
            )
            number = len(filled)
            filled.append(0)
            room_of.append(size)
        bin_of[i], place[i] = number, filled[number]
        filled[number] += length
        room_of[number] -= length
        room = room_of[number]
        if room not in bins_by_room:
            bins_by_room[room] = []
            insort(rooms, room)
        insort(bins_by_room[room], number)
    held = np.array(filled, np.int64)
    return bin_of, place, np.array(sizes, np.int64)[np.searchsorted(sizes, held)]


_PACKED = [
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("bin", T.StringType()),
    T.StructField("offset", T.LongType()),
    T.StructField("bin_size", T.IntegerType()),
]


def with_lengths(docs: DataFrame, text: str, keep: list[str], name: str) -> DataFrame:
    """Words and one end token of every whole text."""

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            return [pa.array(split_words(texts)[1] + 1)]

        return work

    return map_texts(docs, text, keep, make, [T.StructField(name, T.LongType())])


def pack_documents(
    docs: DataFrame,
    *,
    text: str = "text",
    keep: list[str] | None = None,
    length: str | None = None,
    settings: PackingSettings = PackingSettings(),
) -> DataFrame:
    """One row per piece: the columns ``keep`` of its document (default: doc_id), piece (number in
    the document), start (its first token there), n_tokens, bin, offset (its first token in the
    bin) and bin_size. A name among ``keep`` that equals one of these raises an error."""
    keep = ["doc_id"] if keep is None else keep
    clash = {c.lower() for c in keep} & {f.name for f in _PACKED}
    if clash:
        raise ValueError(f"kept columns are named like results: {sorted(clash)}")
    size = free_name(docs, "tokens_of_row")
    if length is None:
        sized = with_lengths(docs, text, keep, size)
    else:
        sized = docs.select(*[col(c) for c in keep], F.greatest(F.coalesce(col(length).cast("long"), F.lit(0)), F.lit(0)).alias(size))
    longest = max(settings.sizes)
    shard = free_name(sized, "shard_of_row")
    settled = shared_table(sized, "lengths")  # a repeated task must deal the same rows out again
    shards = max(1, -(-settled.count() // settings.shard_pieces))
    dealt = _dealt(settled, shard, shards)
    schema = T.StructType([sized.schema[c] for c in keep] + _PACKED)

    def pack(table: pa.Table) -> pa.Table:
        # the order of rows decides ties, so it must not depend on the shuffle
        table = table.combine_chunks()
        keys = [(c, "ascending") for c in [size, *keep] if not pa.types.is_nested(table.schema.field(c).type)]
        table = table.sort_by(keys)
        total = table[size].to_numpy()
        full = np.maximum(0, (total - 1) // longest)
        row = np.repeat(np.arange(len(total)), full + 1)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(full + 1) - full - 1, full + 1)
        lengths = np.where(piece < full[row], longest, total[row] - full[row] * longest)
        bin_of, offset, final = pack_pieces(lengths, settings)
        number = table[shard][0].as_py()
        kept = table.select(keep).take(pa.array(row))
        columns = [
            pa.array(piece, pa.int32()),
            pa.array(piece * longest, pa.int64()),
            pa.array(lengths, pa.int64()),
            pa.array([f"{number}:{b}" for b in bin_of], pa.string()),
            pa.array(offset, pa.int64()),
            pa.array(final[bin_of], pa.int32()),
        ]
        return pa.Table.from_arrays([*kept.columns, *columns], names=schema.names)

    return dealt.groupBy(shard).applyInArrow(pack, schema)


def _dealt(rows: DataFrame, shard: str, shards: int) -> DataFrame:
    """Rows of a settled table dealt out in turn, equal ones included."""
    schema = T.StructType([*rows.schema.fields, T.StructField(shard, T.IntegerType())])

    def deal(batches):
        turn = TaskContext.get().partitionId() * 7919
        for batch in batches:
            own = (turn + np.arange(batch.num_rows)) % shards
            turn += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=schema.names)

    return rows.mapInArrow(deal, schema)
