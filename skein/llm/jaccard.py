"""N-gram Jaccard join: documents whose sets of word n-grams are alike, as components.

A document's set holds its distinct ``n``-word shingles (A-Z lower-cased words
``[^\\x20\\x09-\\x0D]+``; with fewer words the whole sequence is one shingle; without words it is
empty and links with nothing). Two documents link when 100 * overlap >= ``percent`` * union.

The product of the document by n-gram incidence matrix with itself is never formed as a whole:

1. *Nodes.* Equal sets are one node, however many documents have them.
2. *Column blocks.* Sizes of linked sets bound how many n-grams they may not share. The columns
   (n-grams, by hash) are cut into more blocks than that, so linked sets agree on at least one
   whole block. Size classes overlap, so that linked sets meet in one class. A set with too many
   empty blocks is cut again with another hash, together with the sets like it; so agreeing on an
   empty block alone never makes a candidate and none is lost.
   Block keys are not kept: a first reading of the texts finds those that two sets have, as a
   filter of bounded size, a second one sends those alone.
3. *Families.* Nodes that agree on a block are tied to the least of them; the components of these
   ties hold every possible link. A set is left out if other tied sets have fewer of its n-grams
   between them than a link asks for; families are formed anew from the sets that stay.
4. *Row blocks.* A family is cut into blocks of at most about ``rows`` nodes, each joined by the
   family's least node. In a block the sparse product is taken row by row: overlaps with all rows
   whose size fits are accumulated over the row's n-grams, and rows that are already connected are
   left out. Nodes that their block does not connect with the family's least node go against the
   family's nodes of like size in the same way, again in blocks; all others are connected already.
5. *Components* of the links found, with the least document id of each.

Sets are compared by 64-bit hashes of their n-grams. A node is known by a 64-bit hash of its set;
a second one is carried along and a difference between them raises an error. Null texts are
empty; null ids stand aside when the least id is sought; repeated rows are one node.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import (
    KeyFilter,
    byte_slices,
    col,
    drop_shared,
    filter_block,
    free_name,
    map_texts,
    mix64,
    ragged,
    shared_table,
    split_key,
    split_words,
    word_hashes,
)
from skein.session import shuffle_partitions


#: Bytes of text whose n-grams or block keys a task holds at once.
SLICE_BYTES = 3 << 20


@dataclass(frozen=True)
class JoinSettings:
    n: int = 3
    percent: int = 90
    rows: int = 1024
    class_width: float = 1.5
    levels: int = 8


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text in a row, and how many each has."""
    numbers, counts, words = split_words(texts, lower=True)
    doc = np.repeat(np.arange(len(counts)), counts)
    value = word_hashes(words)[numbers]
    heads = np.cumsum(counts) - counts
    rolling = value.copy()
    for k in range(1, n):
        rolling = mix64(rolling[:-1]) * np.uint64(0x9E3779B97F4A7C15) + value[k:] if len(rolling) > 1 else rolling[:0]
    inside = np.flatnonzero(doc[: len(rolling)] == doc[n - 1 :]) if len(rolling) else np.zeros(0, np.int64)
    key, owner = [mix64(rolling[inside])], [doc[inside]]
    for length in range(1, n):  # short texts: one shingle of all words, apart from longer ones
        short = np.flatnonzero(counts == length)
        whole = np.full(len(short), length, np.uint64)
        for k in range(length):
            whole = mix64(whole) * np.uint64(0xBF58476D1CE4E5B9) + value[heads[short] + k]
        key.append(mix64(whole))
        owner.append(short)
    key, owner = np.concatenate(key), np.concatenate(owner)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[first], np.bincount(owner[first], minlength=len(texts)).astype(np.int64)


def linked(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * overlap >= percent * (a + b - overlap)


def class_borders(most: int, width: float) -> list[int]:
    """Where classes of sizes begin, up to one behind ``most``."""
    begins = [1]
    while begins[-1] <= most:
        begins.append(max(begins[-1] + 1, math.ceil(begins[-1] * width)))
    return begins


def _blocks(begin: int, end: int, percent: int) -> tuple[int, int]:
    """Blocks of a class that sets of [begin, end) meet in, and how many may be empty."""
    apart = (100 - percent) * 2 * (end - 1) // (100 + percent)
    blocks = apart + 1
    spare = math.floor(2 * blocks * math.exp(-begin / blocks))
    return blocks + spare, spare


def block_keys(keys: np.ndarray, sizes: np.ndarray, settings: JoinSettings) -> tuple[np.ndarray, np.ndarray]:
    """The block keys of every set in a row, and how many each has.

    A class takes sets of its own sizes and, from the class below, those large enough to link
    with one of its own. ``apart`` is the largest symmetric difference of two linked sets of the
    class. With blocks = apart + 1 + spare, linked sets agree on spare + 1 blocks at least, so a
    set with at most ``spare`` empty ones agrees on one that is not empty.
    """
    begins = class_borders(int(sizes.max(initial=1)), settings.class_width)
    heads = np.cumsum(sizes) - sizes
    out, owner = [], []
    for number in range(len(begins) - 1):
        begin, end = begins[number], begins[number + 1]
        least = -(-begin * settings.percent // 100)
        live = np.flatnonzero((sizes >= least) & (sizes < end) & (sizes > 0))
        if not len(live):
            continue
        blocks, spare = _blocks(least, end, settings.percent)
        for level in range(settings.levels):
            at = ragged(heads[live], sizes[live])
            mixed = mix64(keys[at] ^ np.uint64(0xA0761D6478BD642F + number * 64 + level))
            block = (mixed >> np.uint64(32)).astype(np.int64) % blocks
            row = np.repeat(np.arange(len(live)), sizes[live])
            cell = row * blocks + block
            # order-free sums of the members name the content of a block
            order = np.argsort(cell, kind="stable")
            first = np.flatnonzero(np.diff(cell[order], prepend=-1))
            sums = np.add.reduceat(mix64(mixed[order] + np.uint64(1)), first) if len(first) else np.zeros(0, np.uint64)
            named = cell[order][first]
            count = np.bincount(named // blocks, minlength=len(live))
            name = mix64(sums ^ mix64((named % blocks).astype(np.uint64) + np.uint64(1) + np.uint64((number * 64 + level) << 32)))
            out.append(name.view(np.int64))
            owner.append(live[named // blocks])
            again = blocks - count > spare
            if level == settings.levels - 1 and again.any():
                # the last level: sets that are left meet on whole classes
                rest = live[again]
                out.append(np.full(len(rest), mix64(np.array([number + 1], np.uint64))[0].view(np.int64)))
                owner.append(rest)
            live = live[again]
            if not len(live):
                break
    if not out:
        return np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
    out, owner = np.concatenate(out), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return out[order], np.bincount(owner, minlength=len(sizes))


_SET = [
    T.StructField("n_shingles", T.LongType()),
    T.StructField("node", T.LongType()),
    T.StructField("check", T.LongType()),
]


def node_hashes(keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every set: its node and a check; 0 for an empty set."""
    sums = []
    for seed in (0x2545F4914F6CDD1D, 0x1D8E4E27C47D124F):
        each = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(keys ^ np.uint64(seed)))])
        ends = np.cumsum(sizes)
        total = mix64((each[ends] - each[ends - sizes]) + sizes.astype(np.uint64))
        sums.append(np.where(sizes > 0, total, np.uint64(0)).view(np.int64))
    return sums[0], sums[1]


def document_sets(docs: DataFrame, text: str, keep: list[str], settings: JoinSettings) -> DataFrame:
    """One row per document: n_shingles, node and check."""

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            keys, sizes = shingle_sets(texts, settings.n)
            node, check = node_hashes(keys, sizes)
            return [pa.array(sizes), pa.array(node), pa.array(check)]

        return work

    return map_texts(docs, text, keep, make, _SET, SLICE_BYTES)


#: Bytes of text for one hash partition of block keys, and the most bytes of the filter made of them.
_PART_BYTES, _FILTER_BYTES = 16 << 20, 64 << 20
#: Keys that the task of a hash partition gathers before it merges them.
_WAITING = 1 << 21


def _two_each(codes: np.ndarray) -> np.ndarray:
    """Sorted codes (key above, node below, 32 bits each) with at most two nodes of each key."""
    codes = np.unique(codes)
    key = codes >> np.uint64(32)
    return codes[np.concatenate([np.ones(min(2, len(key)), bool), key[2:] != key[:-2]])]


def _node_blocks(batches, settings: JoinSettings):
    """id, node and block keys (with the row of each) of every distinct set of a slice, under the
    least id that has it there."""
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        for start, n in byte_slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), SLICE_BYTES):
            keys, sizes = shingle_sets(pa.concat_arrays([texts.slice(start, n)]), settings.n)
            node, _ = node_hashes(keys, sizes)
            ids = batch.column(0).slice(start, n)
            rank = pc.rank(ids, "ascending", null_placement="at_end", tiebreaker="first").to_numpy()
            order = np.lexsort((rank, node))
            order = order[sizes[order] > 0]
            keep = np.sort(order[np.flatnonzero(np.diff(node[order], prepend=~node[order[:1]]) != 0)]) if len(order) else order
            heads = np.cumsum(sizes) - sizes
            blocks, counts = block_keys(keys[ragged(heads[keep], sizes[keep])], sizes[keep], settings)
            yield ids.take(pa.array(keep)), node[keep], blocks.view(np.uint64), np.repeat(np.arange(len(keep)), counts)


def _met_twice(rows: DataFrame, read: Callable, size: int):
    """A broadcast filter of the keys that two different nodes have, and a few others, with the bits
    that name its blocks. ``read`` turns a task's batches into arrays of keys and their nodes;
    ``size`` is about their bytes. Tasks send hashes of keys, at most two nodes for a key and batch."""
    spark = rows.sparkSession
    top = max(1, (max(shuffle_partitions(spark), -(-size // _PART_BYTES)) - 1).bit_length())

    def send(batches):
        for keys, node in read(batches):
            part, low = split_key(mix64(keys), top)
            codes = (low.astype(np.uint64) << np.uint64(32)) | (node.view(np.uint64) & np.uint64(0xFFFFFFFF))
            order = np.argsort(part, kind="stable")
            parts, first = np.unique(part[order], return_index=True)
            sent = [_two_each(c).tobytes() for c in np.split(codes[order], first[1:])] if len(parts) else []
            yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array(sent, pa.binary())], names=["part", "codes"])

    def merge(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                mine = held.setdefault(part, [])
                mine.append(np.frombuffer(blob.as_buffer(), np.uint64).copy())
                if sum(map(len, mine[1:])) > _WAITING:
                    held[part] = [_two_each(np.concatenate(mine))]
        for part, mine in held.items():
            key = _two_each(np.concatenate(mine)) >> np.uint64(32)
            block = filter_block(key[1:][key[1:] == key[:-1]], max(8, _FILTER_BYTES >> top))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.binary())], names=["part", "block"])

    sent = rows.mapInArrow(send, "part int, codes binary")
    made = sent.repartitionById(1 << top, F.col("part")).mapInArrow(merge, "part int, block binary")
    # at most _FILTER_BYTES, or 8 bytes a partition
    return spark.sparkContext.broadcast({r[0]: bytes(r[1]) for r in made.collect()}), top


def _tied_blocks(source: DataFrame, settings: JoinSettings) -> DataFrame:
    """id, node, block: the block keys of every document that two different sets have, and a few
    others: the texts are read once for the filter, and again to send what passes it."""
    texts = source.select("id", "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shared, top = _met_twice(texts, lambda batches: ((b, node[row]) for _, node, b, row in _node_blocks(batches, settings)), size)

    def pick(batches):
        wanted = KeyFilter(shared.value, top)
        for ids, node, blocks, row in _node_blocks(batches, settings):
            stay = wanted.passes(mix64(blocks))
            row = row[stay]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row)), pa.array(node[row]), pa.array(blocks[stay].view(np.int64))], names=["id", "node", "block"]
            )

    return texts.mapInArrow(pick, "id long, node long, block long")


def _ties(cells: DataFrame) -> DataFrame:
    """Nodes that agree on a block, each tied to the least of them."""
    shared = cells.groupBy("block").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least != most")
    return cells.join(shared, "block").where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (a, b) reaches. Alternates ties of
    larger neighbours and of smaller neighbours to the least one until nothing changes; every
    round is written to the shared folder."""
    current = shared_table(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0"
    )
    number = 0
    while True:
        number += 1
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # larger neighbours go to the least one
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # then smaller neighbours and the node itself
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = shared_table(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), f"{name}-{number}")
        # done when each node has one tie and no root is tied itself
        state = after.agg(F.count("*").alias("ties"), F.countDistinct("a").alias("nodes")).first()
        if state["ties"] == state["nodes"] and not after.join(after.select(F.col("a").alias("b")), "b", "left_semi").take(1):
            roots = after.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
            return after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        drop_shared(current)
        current = after


class Forest:
    """Union of connected rows."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, rows: np.ndarray, row: int) -> None:
        """Connect rows with a row; the array always names roots."""
        held = np.unique(self.root[np.append(rows, row)])
        self.root[np.isin(self.root, held)] = held[0]


def product_links(keys: np.ndarray, sizes: np.ndarray, percent: int, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is linked among sorted sets: row by row, overlaps with all rows
    not yet connected are accumulated over the row's n-grams. With ``left``, only pairs of a
    marked and an unmarked row count."""
    n = len(sizes)
    columns, column = np.unique(keys, return_inverse=True)
    row_of = np.repeat(np.arange(n), sizes)
    heads = np.cumsum(sizes) - sizes
    order = np.argsort(column, kind="stable")
    by_column = row_of[order]
    starts = np.concatenate([[0], np.cumsum(np.bincount(column, minlength=len(columns)))])
    forest, links = Forest(n), []
    for row in range(n):
        if left is not None and not left[row]:
            continue
        open_rows = forest.root != forest.root[row]
        if left is None:
            open_rows[:row] = False
        else:
            open_rows &= ~left
        open_rows &= (100 * np.minimum(sizes, sizes[row]) >= percent * np.maximum(sizes, sizes[row])) & (sizes > 0)
        if not open_rows.any():
            continue
        mine = column[heads[row] : heads[row] + sizes[row]]
        length = starts[mine + 1] - starts[mine]
        overlap = np.bincount(by_column[ragged(starts[mine], length)], minlength=n)
        found = np.flatnonzero(open_rows & linked(overlap, sizes, sizes[row], percent))
        if len(found):
            # one link to each of the components that the row meets
            _, firsts = np.unique(forest.root[found], return_index=True)
            links += [(row, int(k)) for k in found[firsts]]
            forest.join(found, row)
    return links


_LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _sets_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    values = table["keys"].combine_chunks()
    keys = np.frombuffer(b"".join(values.to_pylist()), np.uint64)
    return keys, table["n_shingles"].to_numpy().astype(np.int64)


def _block_links(percent: int, crosswise: bool):
    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("node", "ascending")])
        node = table["node"].to_numpy()
        keys, sizes = _sets_of(table)
        left = table["guest"].to_numpy(zero_copy_only=False).astype(bool) if crosswise else None
        links = product_links(keys, sizes, percent, left)
        pairs = np.array(links, np.int64).reshape(-1, 2)
        return pa.Table.from_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], names=_LINKS.names)

    return work


def similar_components(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    keep: list[str] | None = None,
    settings: JoinSettings = JoinSettings(),
    prefix: str = "",
) -> DataFrame:
    """The columns ``keep`` of every document (default: all) with n_shingles, node (equal for equal
    sets, null for the empty one) and component_id (the least id of the documents it is connected
    with, its own for an empty set), named with ``prefix``."""
    keep = docs.columns if keep is None else keep
    source = docs.select(
        col(doc_id).cast("long").alias("id"), col(text).alias("text"), *[col(c).alias(f"kept_{k}") for k, c in enumerate(keep)]
    )
    kept = source.columns[2:]
    sets = shared_table(document_sets(source, "text", ["id", *kept], settings), "jaccard-sets")
    full = sets.where("n_shingles > 0")
    nodes = full.groupBy("node").agg(F.min("id").alias("id"), F.min("check").alias("low"), F.max("check").alias("high"))
    safe = F.when(F.col("low") == F.col("high"), F.col("node")).otherwise(
        F.raise_error(F.lit("two different sets share a hash")).cast("long")
    )
    nodes = shared_table(nodes.select(safe.alias("node"), "id"), "jaccard-nodes")

    first = nodes.select("node", F.col("id").alias("first"))
    cells = _tied_blocks(source, settings).join(first, "node").where(F.col("id").eqNullSafe(F.col("first"))).select("node", "block")
    cells = shared_table(cells, "jaccard-cells")
    tied = components(_ties(cells), "jaccard-ties")
    members = _members(source, tied, nodes, settings)
    # ties often come from passages alone; without sets that cannot have a link families fall apart
    families = components(_ties(cells.join(members.select("node"), "node", "left_semi")), "jaccard-families")
    grouped = members.join(families.select("node", F.col("root").alias("family")), "node")
    drop_shared(cells, tied)
    links = _links(grouped, families, settings)
    rooted = components(links, "jaccard-links")
    drop_shared(members, families)

    named = nodes.join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = named.groupBy("root").agg(F.min("id").alias("component"))
    of_node = named.join(roots, "root").select("node", "component")
    found = sets.join(of_node, "node", "left")
    return found.select(
        *[F.col(k).alias(c) for k, c in zip(kept, keep)],
        F.col("n_shingles").alias(prefix + "n_shingles"),
        F.when(F.col("n_shingles") > 0, F.col("node")).alias(prefix + "node"),
        F.coalesce("component", "id").alias(prefix + "component_id"),
    )


#: Slots of the bitmap of ids that picks the texts to read as sets.
_SLOTS = 1 << 20


def _members(source: DataFrame, tied: DataFrame, nodes: DataFrame, settings: JoinSettings) -> DataFrame:
    """node, n_shingles and keys (sorted hashes) of every node with a tie that may have a link, from
    one document each. A linked set shares ``percent`` of its n-grams at least, so a set stays only
    if the others have that many of its n-grams between them. A bitmap of fixed size over hashed ids
    picks texts in the scan, so that only sets that may have a partner are shuffled."""
    wanted = tied.join(nodes, "node").select("node", F.col("id").alias("first"))

    def slot(c):
        return F.pmod(F.xxhash64(c), F.lit(_SLOTS)).cast("int")

    bitmap = np.zeros(_SLOTS, bool)
    bitmap[wanted.select(slot("first").alias("s")).distinct().toArrow()["s"].to_numpy()] = True  # at most _SLOTS rows
    picked = source.sparkSession.sparkContext.broadcast(np.packbits(bitmap))
    texts = source.select("id", slot("id").alias("slot"), "text")
    fields = [
        T.StructField("id", T.LongType()),
        T.StructField("node", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("keys", T.BinaryType()),
    ]
    schema = T.StructType(fields)

    def sets(batches):
        chosen = np.unpackbits(picked.value).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(chosen[batch.column(1).to_numpy(zero_copy_only=False)]))
            texts = pc.fill_null(batch.column(2), "")
            for start, n in byte_slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), SLICE_BYTES):
                keys, sizes = shingle_sets(pa.concat_arrays([texts.slice(start, n)]), settings.n)
                yield batch.column(0).slice(start, n), node_hashes(keys, sizes)[0], keys, sizes

    # an n-gram and its node take about as many bytes as a word
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shared, top = _met_twice(texts, lambda batches: ((keys, np.repeat(node, n)) for _, node, keys, n in sets(batches)), size)

    def read(batches):
        met = KeyFilter(shared.value, top)
        for ids, node, keys, sizes in sets(batches):
            row = np.repeat(np.arange(len(sizes)), sizes)
            stay = 100 * np.bincount(row, met.passes(mix64(keys)), minlength=len(sizes)) >= settings.percent * sizes
            keys, sizes, stays = keys[stay[row]], sizes[stay], pa.array(stay)
            ends = np.concatenate([[0], np.cumsum(sizes)]) * 8
            blob = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(keys.tobytes())]
            )
            columns = [ids.filter(stays), pa.array(node[stay]), pa.array(sizes)]
            yield pa.RecordBatch.from_arrays([*columns, blob.cast(pa.binary())], names=schema.names)

    found = texts.mapInArrow(read, schema)
    # repeated rows of an id with one set are one member
    members = found.join(wanted, "node").where(F.col("id").eqNullSafe(F.col("first"))).select("node", "n_shingles", "keys")
    return shared_table(members.dropDuplicates(["node"]), "jaccard-members")


def _visits(large: DataFrame, apart: DataFrame, settings: JoinSettings) -> DataFrame:
    """Where the sets of large families stand as hosts and those of ``apart`` as guests: (family, layer,
    block, lane, node, n_shingles, keys, guest). Every guest meets every host of like size once."""
    # linked sets have like sizes: they lie in one layer of sizes or in two next to each other
    width = max(100 / settings.percent, 1.01) * (1 + 1e-9)
    layer = F.floor(F.log(F.col("n_shingles")) / math.log(width)).cast("int")
    large, apart = (t.select("family", layer.alias("layer"), "node", "n_shingles", "keys") for t in (large, apart))
    near_layers = F.explode(F.sequence(F.col("layer") - 1, F.col("layer") + 1)).alias("layer")
    guests = apart.select("family", near_layers, "node").groupBy("family", "layer").agg(F.ceil(F.count("*") / settings.rows).cast("int").alias("lanes"))
    layers = large.groupBy("family", "layer").agg(F.ceil(F.count("*") / settings.rows).cast("int").alias("blocks"))
    layers = layers.join(guests, ["family", "layer"])

    def dealt_out(name: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(name)).cast("int")

    def all_of(name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    # each guest meets every block of a layer; guests come in lanes of about as many as a block has rows
    hosts = large.join(layers, ["family", "layer"]).select(
        "family", "layer", dealt_out("blocks").alias("block"), all_of("lanes").alias("lane"), "node", "n_shingles", "keys", F.lit(False).alias("guest")
    )
    visits = apart.select("family", near_layers, "node", "n_shingles", "keys").join(layers, ["family", "layer"]).select(
        "family", "layer", all_of("blocks").alias("block"), dealt_out("lanes").alias("lane"), "node", "n_shingles", "keys", F.lit(True).alias("guest")
    )
    return hosts.unionByName(visits)


def _links(members: DataFrame, families: DataFrame, settings: JoinSettings) -> DataFrame:
    """Links that connect what is linked, inside blocks and then across them."""
    sizes = families.groupBy("root").agg(F.count("*").alias("members")).select(F.col("root").alias("family"), "members")
    dealt = members.join(sizes, "family").withColumn("blocks", F.ceil(F.col("members") / settings.rows).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # the family's least node stands in every block
    block = F.explode(F.when(F.col("node") == F.col("family"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own)))
    placed = dealt.select("family", block.alias("block"), "node", "n_shingles", "keys", F.lit(False).alias("guest"))
    inside = shared_table(
        placed.repartition("family", "block").groupBy("family", "block").applyInArrow(_block_links(settings.percent, False), _LINKS), "jaccard-inside"
    )
    if not sizes.where(F.col("members") > settings.rows).take(1):
        return inside
    large = dealt.where("blocks > 1")
    near = components(inside, "jaccard-near")
    state = large.join(near, "node", "left").withColumn("root", F.coalesce("root", "node"))
    main = state.where("node = family").select("family", F.col("root").alias("main")).distinct()
    apart = state.join(main, "family").where("root != main")
    rows = _visits(large, apart, settings)
    place = ["family", "layer", "block", "lane"]
    across = rows.repartition(*place).groupBy(*place).applyInArrow(_block_links(settings.percent, True), _LINKS)
    return inside.unionByName(across)


#: Ids of copies, 8 bytes each, that are sent to every task.
_LISTED = 1 << 20


def keep_one(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", settings: JoinSettings = JoinSettings()) -> DataFrame:
    """All columns of one document of each component, the one with the least id; documents with an
    empty set stay. Rows of one id with an n-gram are one document and one of them stays; rows
    without an id stay, as nothing tells them apart."""
    found = similar_components(docs, text=text, doc_id=doc_id, keep=[doc_id], settings=settings)
    known = found.select(col(doc_id).cast("long").alias("id"), "node", "component_id").where("id is not null")
    # counted first: a short list goes to the texts, a long one is joined like any table
    copies = shared_table(known.where("id != component_id").select("id").distinct(), "jaccard-copies")
    copies = F.broadcast(copies) if copies.count() <= _LISTED else copies
    again = known.where("node is not null").groupBy("id").count().where("count > 1").select("id")
    name = free_name(docs, "long_id")
    keyed = docs.withColumn(name, col(doc_id).cast("long"))
    kept = keyed.join(copies, keyed[name] == copies["id"], "left_anti")
    if again.take(1):
        # the first by text, then by the other columns, however often a task runs
        order = W.partitionBy(name).orderBy(col(text), *[col(c).cast("string") for c in docs.columns if c != text])
        place = free_name(kept, "place")
        once = kept.join(again, kept[name] == again["id"], "left_semi").withColumn(place, F.row_number().over(order))
        once = once.where(F.col(place) == 1).drop(place)
        kept = kept.join(again, kept[name] == again["id"], "left_anti").unionByName(once)
    return kept.drop(name)
