"""Similarity join on word shingles by parity sketches.

A document is its set of shingle hashes; equal sets are one node. Sets of a and b
elements link when 100 * |A n B| >= percent * |A u B|, that is when their symmetric
difference is at most limit(a + b).

* Parity sketches: each part of a set is the XOR of the hashes that fall in it. The
  number of unequal parts is at most the symmetric difference.
* Pigeonhole: sizes are cut into bands; a band of sets up to U elements gets
  limit(2 U) + 1 parts and some to spare, so that linked sets agree in more parts
  than those that a set leaves empty. Agreement in a part that isn't empty makes a
  group; the few sets with more empty parts than spared also send those.
* A group's smallest node is its centre. The members of all groups of one centre, each
  once, are a neighbourhood: two linked sets share a group, so they share a neighbourhood,
  and groups that overlap (as those of a cloud of near copies do) cost a node one row.
* A first pass over each neighbourhood compares bit sketches, whose Hamming distance is a
  lower bound of the symmetric difference: it keeps the members that may link with the
  centre, and those that may link with another member. Only their sets are fetched.
* A second pass holds the sets of a neighbourhood and verifies exactly: the centre
  against all, then what is left unlinked against members of other classes; where links
  are counted, every pair once, in the neighbourhood of the smallest centre that both have.
  It returns spanning links and counts, never all pairs.
* Components of the verified links are the classes.

A neighbourhood beyond ROW members or ELEMENTS shingles is dealt to blocks, and the centre
goes to each. Members that are not linked with it in their block then visit the other
blocks (all members visit the later blocks where links are counted), so a pass over a
neighbourhood of n members of which u aren't linked with the centre takes n + u * n / ROW
rows. Copies collapse before anything else, and each batch sends a (part, node) once.

Hashes have 64 bits; two different shingles of a pair that collide would be counted as one.

Defined cases: a null or blank text has no shingles and links with nothing; a null
id links with nothing and has no component; rows that repeat an id or text are
nodes like others; every input row gives one row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, buckets_for, cut, pack, session, stored_bytes, text_or_empty
from .graph import components
from .winnow import mix
from .words import WordHashes, shingles

SIG = np.dtype([("s", "<u4"), ("t", "<u2"), ("n", "<i8")])
#: Sizes of one band: from x up to RATIO * x.
RATIO = 1.5
#: Signatures that a batch gathers before it sends them.
BATCH = 1 << 20
#: Members and shingles of a block of a neighbourhood.
ROW, ELEMENTS = 4096, 1 << 20
ROWS = "kind int,a long,b long,mark long,size int,blob binary"


@lru_cache(1 << 16)
def limit(total: int, percent: int) -> int:
    """The largest symmetric difference of two linked sets of total elements together."""
    return total - 2 * -(-percent * total // (100 + percent))


@lru_cache(64)
def bands(percent: int) -> tuple[list[int], list[int], list[int]]:
    """Of each band: its least size, its parts and the parts to spare."""
    low, parts, spare, x = [], [], [], 1
    while x < 1 << 31:
        nxt = max(x + 1, math.ceil(x * max(RATIO, 100 / percent)))
        most = max(limit(n, percent) for n in range(max(2, 2 * nxt - 40), max(3, 2 * nxt - 1)))
        extra = 1
        for _ in range(8):
            p = most + 1 + extra
            mean = p * math.exp(-max(1, x * percent // 100) / p)
            extra = max(1, math.ceil(mean + 4 * math.sqrt(mean)))
            extra = min(extra, most + 1)
        low.append(x)
        parts.append(most + 1 + extra)
        spare.append(extra)
        x = nxt
    return low, parts, spare


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, number of the set) of all parts of all sets in their bands."""
    low, parts, spare = bands(percent)
    out_s, out_i = [], []
    size = np.array([len(s) for s in sets])
    band = np.searchsorted(low, size, "right") - 1
    top = np.array([*low[1:], 1 << 62])
    for step in (0, 1):
        # the next band, too, for sets with which one of its sets could be linked
        use = np.flatnonzero((size > 0) & ((step == 0) | (size * 100 // percent >= top[band])))
        if not len(use):
            continue
        b = np.minimum(band[use] + step, len(low) - 1)
        p = np.array(parts)[b]
        at = np.cumsum(p) - p
        h = np.concatenate([sets[i] for i in use])
        who = np.repeat(np.arange(len(use)), size[use])
        place = at[who] + ((h >> np.uint64(20)) % p.astype(np.uint64)[who]).astype(np.int64)
        xor = np.zeros(int(p.sum()), np.uint64)
        np.bitwise_xor.at(xor, place, h)
        owner = np.repeat(np.arange(len(use)), p)
        part = np.arange(len(xor)) - at[owner]
        empty = xor == 0
        many = np.bincount(owner[empty], minlength=len(use)) > np.array(spare)[b]
        keep = ~empty | many[owner]
        sig = mix(mix(xor) ^ (b[owner].astype(np.uint64) << np.uint64(40)) ^ part.astype(np.uint64))
        out_s.append(sig[keep])
        out_i.append(use[owner[keep]])
    if not out_s:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(out_s), np.concatenate(out_i)


def node_of(s: np.ndarray) -> int:
    """A set's name: never null for a set that isn't empty."""
    return int(mix(np.array([np.bitwise_xor.reduce(mix(s)), np.uint64(len(s))]).cumsum(dtype=np.uint64))[1].astype(np.int64))


def bit_sketch(s: np.ndarray) -> bytes:
    """Parity of the hashes at each bit: at least twice as many bits as the set has elements, a power of two from 256."""
    bits = max(256, 2 << (len(s) - 1).bit_length())
    return np.packbits((np.bincount((mix(s) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference."""
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    n, m = len(x), len(y)
    while n > m:
        n //= 2
        a = (a & ((1 << 8 * n) - 1)) ^ (a >> 8 * n)
    while m > n:
        m //= 2
        b = (b & ((1 << 8 * m) - 1)) ^ (b >> 8 * m)
    return (a ^ b).bit_count()


def describe(rows: DataFrame, words: int, percent: int, slots: int) -> DataFrame:
    """(kind, a, b, mark, size, blob): 0, signatures to bucket a; 1, a document: id, node, mark, size, bit sketch."""
    schema = arrow_schema(ROWS)

    def batch_of(kind, a, b, mark, size, blob):
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(mark, pa.int64()), pa.array(size, pa.int32()), pa.array(blob, pa.binary())], schema=schema)

    def run(batches):
        hashes, known, sigs, nodes, held = WordHashes(), set(), [], [], 0

        def send():
            sig, node = np.concatenate(sigs), np.concatenate(nodes)
            out = np.empty(len(sig), SIG)
            out["s"], out["t"], out["n"] = sig & np.uint64(0xFFFFFFFF), (sig >> np.uint64(32)) & np.uint64(0xFFFF), node
            slot, blob = pack(out, ((sig >> np.uint64(48)) % np.uint64(slots)).astype(np.int64), slots)
            return batch_of(0, slot, [0] * len(slot), [0] * len(slot), [0] * len(slot), blob)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            sets = [shingles(hashes.of(t), words) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            names = [node_of(s) if len(s) else None for s in sets]
            yield batch_of(1, ids, names, batch.column(2), [len(s) for s in sets], [bit_sketch(s) if len(s) else None for s in sets])
            fresh = []
            for i, n, s in zip(ids, names, sets, strict=True):
                if i is not None and n is not None and n not in known:
                    known.add(n)
                    fresh.append((n, s))
            if fresh:
                sig, which = signatures([s for _, s in fresh], percent)
                sigs.append(sig)
                nodes.append(np.array([n for n, _ in fresh], np.int64)[which])
                held += len(sig)
            if held >= BATCH:
                yield send()
                known, sigs, nodes, held = set(), [], [], 0
        if held:
            yield send()

    return rows.mapInArrow(run, ROWS)


def group(described: DataFrame, tasks: int, slots: int) -> DataFrame:
    """Kind 1 as it is; 0, a centre and a member."""
    schema = arrow_schema(ROWS)

    def run(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py():
            return table.select([f.name for f in schema])
        got = np.frombuffer(b"".join(table.column("blob").to_pylist()), SIG)
        key = got["s"].astype(np.uint64) | (got["t"].astype(np.uint64) << np.uint64(32))
        order = np.lexsort((got["n"], key))
        key, node = key[order], got["n"][order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[new], node[new]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(first)
        sizes = np.diff(np.r_[starts, len(key)])
        centre = np.repeat(node[starts], sizes)
        member = node != centre
        pairs = np.unique(np.stack([centre[member], node[member]], 1), axis=0) if member.any() else np.empty((0, 2), np.int64)
        k = len(pairs)
        return pa.table([pa.array([0] * k, pa.int32()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array([0] * k, pa.int64()), pa.array([0] * k, pa.int32()), pa.array([None] * k, pa.binary())], schema=schema)

    # documents go by their id, so that they spread
    spread = F.when(F.col("kind") == 0, F.col("a")).otherwise(F.pmod(F.coalesce("a", F.xxhash64("blob")), F.lit(slots)))
    return described.withColumn("slot", spread).repartition(tasks, "kind", "slot").groupBy("kind", "slot").applyInArrow(run, ROWS)


def dealt(around: DataFrame) -> DataFrame:
    """around (c, node, size and more; centres aren't rows of their own yet) with the block of each member and the number of blocks."""
    sums = around.groupBy("c").agg(F.ceil(F.greatest(F.count(F.lit(1)) / ROW, F.sum("size") / ELEMENTS)).cast("int").alias("blocks"))
    # one row for each ROW members or ELEMENTS shingles at most
    many = sums.where("blocks > 1")
    return around.join(many, "c", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def centres(placed: DataFrame) -> DataFrame:
    """(c, node, blk, blocks): the centre in each of its blocks."""
    return placed.select("c", F.col("c").alias("node"), "blk", "blocks").distinct()


def neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (c, blk) of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        c, blk = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        starts = [0, *(np.flatnonzero((c[1:] != c[:-1]) | (blk[1:] != blk[:-1])) + 1).tolist(), len(c)]
        if held and (held[-1].column(0)[0].as_py() != c[0] or held[-1].column(1)[0].as_py() != blk[0]):
            yield pa.Table.from_batches(held)
            held = []
        for at, end in zip(starts, starts[1:], strict=False):
            if at:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, end - at))
    if held:
        yield pa.Table.from_batches(held)


def each(rows: DataFrame, tasks: int, step: Callable[[pa.Table], list], ddl: str) -> DataFrame:
    """step's columns for each (c, blk) of rows, whose first two columns these are."""
    schema = arrow_schema(ddl)

    def run(batches):
        for table in neighbourhoods(batches):
            out = step(table)
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return rows.repartition(tasks, "c", "blk").sortWithinPartitions("c", "blk").mapInArrow(run, ddl)


def near(pairs: DataFrame, nodes: DataFrame, percent: int, tasks: int) -> DataFrame:
    """(c, node, size): the members that bit sketches allow to link within the neighbourhood of c."""
    sketched = nodes.select("node", "size", "sketch")
    placed = cut(dealt(pairs.join(sketched.select("node", "size"), "node")).select("c", "blk", "node", "blocks"))
    rows = lambda df, guest: df.join(sketched, "node").select("c", "blk", "node", "blocks", "size", "sketch", F.lit(guest).alias("guest"))

    def fits(sizes: np.ndarray, n: int) -> np.ndarray:
        return np.minimum(sizes, n) * 100 >= percent * np.maximum(sizes, n)

    def close(bits: dict, sizes: np.ndarray, x: int, others: np.ndarray) -> np.ndarray:
        """Which of the rows others may link with row x."""
        n = int(sizes[x])
        others = others[fits(sizes[others], n)]
        if not len(others):
            return others
        most = np.array([limit(n + m, percent) for m in range(int(sizes[others].min()), int(sizes[others].max()) + 1)])
        return others[sketch_distances(bits, x, others) <= most[sizes[others] - int(sizes[others].min())]]

    def first(table: pa.Table) -> list:
        c, blk, node, blocks, sizes = (table.column(i).to_numpy() for i in range(5))
        bits = sketch_matrix(table.column(5).to_pylist())
        member = np.flatnonzero(node != c)
        ok = np.zeros(len(node), bool)
        ok[close(bits, sizes, int(np.flatnonzero(node == c)[0]), member)] = True
        keep = ok.copy()
        if len(member) > 1:
            for x in member[~ok[member]].tolist():
                keep[x] = len(close(bits, sizes, x, member[member != x])) > 0
        # in a neighbourhood of many blocks the others' fate is open
        use = member[keep[member] | (blocks[member] > 1)]
        return [c[use], node[use], sizes[use], blk[use], blocks[use], ok[use], keep[use]]

    def second(table: pa.Table) -> list:
        c, _, node, _, sizes = (table.column(i).to_numpy() for i in range(5))
        guest = table.column(6).to_numpy(zero_copy_only=False)
        bits, own = sketch_matrix(table.column(5).to_pylist()), np.flatnonzero(~guest)
        use = [x for x in np.flatnonzero(guest).tolist() if len(close(bits, sizes, x, own))]
        return [c[use], node[use], sizes[use]]

    looked = cut(each(rows(placed.unionByName(centres(placed)), False), tasks, first, "c long,node long,size int,blk int,blocks int,ok boolean,keep boolean"))
    loose = looked.where("blocks > 1 and not keep").select("c", "node", "blk", "blocks").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("to <> blk").select("c", F.col("to").alias("blk"), "node", "blocks")
    met = each(rows(loose, True).unionByName(rows(looked.where("blocks > 1").select("c", "blk", "node", "blocks"), False)), tasks, second, "c long,node long,size int")
    return looked.where("keep").select("c", "node", "size").unionByName(met.distinct())


def sets_of(wanted: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """(node, items) of the nodes wanted (node, rep), from the texts of their rep documents.

    A bitmap of the wanted documents, of eight bits for each up to a bound, spares the others' texts.
    """
    spark = rows.sparkSession
    size = 1 << min(BITMAP, max(15, (8 * wanted.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(size)).cast("int")
    bits = wanted.select(place("rep").alias("place")).groupBy(F.expr("place div 32").alias("word")).agg(F.expr("bit_or(shiftleft(1L, place % 32))").alias("bits"))
    bitmap, found = np.zeros(size // 32, np.uint32), bits.toPandas()
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    shared = spark.sparkContext.broadcast(bitmap)
    schema = arrow_schema("node long,items binary")

    def run(batches):
        hashes, bitmap = WordHashes(), shared.value
        for batch in batches:
            at = batch.column(1).to_numpy()
            part = batch.take(pa.array(np.flatnonzero((bitmap[at >> 5] >> (at & 31).astype(np.uint32)) & 1)))
            sets = [s for s in (shingles(hashes.of(t), words) for t in part.column(0).cast(pa.binary()).to_pylist()) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    sets = rows.where("doc_id is not null").select("body", place("doc_id").alias("place")).mapInArrow(run, "node long,items binary")
    return sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


#: The bitmap of sets_of has two to this power bits at most: 16 MB.
BITMAP = 27


class Sets:
    """Sets side by side, as numbers of their distinct elements."""

    def __init__(self, items: list[bytes]):
        self.size = np.array([len(b) // 8 for b in items])
        flat = np.unique(np.frombuffer(b"".join(items), np.uint64), return_inverse=True)[1]
        self.ids = np.split(flat, np.cumsum(self.size)[:-1])
        self.mark = np.zeros(int(flat.max(initial=-1)) + 1, bool)

    def linked(self, x: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Which of others link with x."""
        n = self.size[x]
        others = others[np.minimum(self.size[others], n) * 100 >= percent * np.maximum(self.size[others], n)]
        if not len(others):
            return others
        self.mark[self.ids[x]] = True
        starts = np.cumsum(self.size[others]) - self.size[others]
        both = np.add.reduceat(self.mark[np.concatenate([self.ids[y] for y in others])], starts, dtype=np.int64)
        self.mark[self.ids[x]] = False
        return others[100 * both >= percent * (n + self.size[others] - both)]


def verified(kept: DataFrame, nodes: DataFrame, rows: DataFrame, words: int, percent: int, count: bool, tasks: int) -> DataFrame:
    """(kind, a, b): kind 0, spanning links of each neighbourhood; 1, b of the links of node a."""
    placed = cut(dealt(kept).select("c", "node", "blk", "blocks"))
    whole = placed.unionByName(centres(placed))
    wanted = cut(whole.select("node").distinct().join(nodes.select("node", "rep"), "node"))
    sets = cut(sets_of(wanted, rows, words))
    if count:
        of = whole.groupBy("node").agg(F.sort_array(F.collect_set("c")).alias("of"))
        sets = sets.join(of, "node")
    else:
        sets = sets.withColumn("of", F.lit(None).cast("array<long>"))
    laid = lambda df, guest: df.join(sets, "node").select("c", "blk", "node", "items", "of", F.lit(guest).alias("guest"))
    ddl = "kind int,a long,b long,blk int"

    def search(table: pa.Table, hosts: np.ndarray | None) -> tuple[list, list, np.ndarray]:
        """Spanning links, counts by row, and the class of each row. hosts: the rows that visitors, which are the others, meet."""
        c, node = table.column(0).to_numpy(), table.column(2).to_numpy()
        sets, label, counts, links = Sets(table.column(3).to_pylist()), np.arange(len(node)), np.zeros(len(node), np.int64), []
        held = [frozenset(x) for x in table.column(4).to_pylist()] if count else None
        at = np.flatnonzero(node == c)
        first, rest = at[:1], np.flatnonzero(node != c)
        order = np.r_[first, rest] if hosts is None else np.setdiff1d(np.arange(len(node)), hosts)
        for k, x in enumerate(order.tolist()):
            if count:
                others = order[k + 1 :] if hosts is None else hosts
            else:
                if hosts is None and k and label[x] == label[first[0]]:
                    continue
                others = rest if hosts is None else hosts
                others = others[label[others] != label[x]]
            for y in sets.linked(x, others, percent).tolist():
                if count and min(held[x] & held[y]) == c[0]:
                    counts[x] += 1
                    counts[y] += 1
                if label[x] != label[y]:
                    label[label == label[y]] = label[x]
                    links.append((int(node[x]), int(node[y])))
        return links, counts.tolist(), label

    def out(links: list, table: pa.Table, counts: list, left: list) -> list:
        node, blk = table.column(2).to_pylist(), table.column(1)[0].as_py()
        found = [(0, a, b, blk) for a, b in links] + [(1, n, k, blk) for n, k in zip(node, counts, strict=True) if k] + left
        return [list(x) for x in zip(*found, strict=True)] if found else [[], [], [], []]

    def alone(table: pa.Table) -> list:
        links, counts, label = search(table, None)
        c, node, blk = table.column(0).to_numpy(), table.column(2).to_numpy(), table.column(1)[0].as_py()
        centre = label[np.flatnonzero(node == c)[0]]
        # in a neighbourhood of many blocks these visit the others
        open_ = np.flatnonzero((node != c) & ((label != centre) | count))
        return out(links, table, counts, [(2, int(c[0]), int(node[x]), blk) for x in open_] if table.column(6)[0].as_py() > 1 else [])

    def visited(table: pa.Table) -> list:
        guest = table.column(5).to_numpy(zero_copy_only=False)
        links, counts, _ = search(table, np.flatnonzero(~guest))
        return out(links, table, counts, [])

    blocks = whole.groupBy("c").agg(F.max("blocks").alias("blocks"))
    got = cut(each(laid(whole, False).join(blocks.where("blocks > 1"), "c", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))), tasks, alone, ddl))
    guests = got.where("kind = 2").select(F.col("a").alias("c"), F.col("b").alias("node"), "blk").join(blocks, "c")
    guests = guests.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("to > blk" if count else "to <> blk").select("c", F.col("to").alias("blk"), "node")
    met = each(laid(guests, True).unionByName(laid(placed.where("blocks > 1"), False)), tasks, visited, ddl)
    return cut(got.where("kind < 2").unionByName(met).select("kind", "a", "b"))


def jaccard_join(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", count: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, n_links (the different sets that its set
    links with; null unless count), and for callers that filter: mark (xxhash64 of the text) and label
    (the class; null where the row links with nothing by definition)."""
    spark = session(docs)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = buckets_for(2 * stored_bytes(docs))
    rows = text_or_empty(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body")), "body").withColumn("mark", F.xxhash64("body"))
    found = cut(group(describe(rows, words, percent, slots), tasks, slots))
    members = found.where("kind = 1").select(F.col("a").alias("doc_id"), F.col("b").alias("node"), "mark", "size", F.col("blob").alias("sketch"))
    nodes = members.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    pairs = found.where("kind = 0").select(F.col("a").alias("c"), F.col("b").alias("node")).distinct()
    links = verified(cut(near(pairs, nodes, percent, tasks)), nodes, rows, words, percent, count, tasks)
    label = components(links.where("kind = 0").select("a", "b"))
    named = members.drop("sketch").join(label, "node", "left").withColumn("label", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "node")))
    first = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    degree = links.where("kind = 1").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("n_links"))
    out = named.join(first, "label", "left").join(degree, "node", "left")
    n_links = F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long") if count else F.lit(None).cast("long")
    return out.select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), n_links.alias("n_links"), "mark", "label")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, with one row of each class: that of the smallest id
    (and mark, where ids repeat). Rows without an id or without words all stay."""
    found = jaccard_join(docs, words, percent, id_col, text_col, count=False)
    first = found.where("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "mark")).alias("x")).select("x.doc_id", "x.mark", F.lit(True).alias("once"))
    loose = found.where("label is null").select("doc_id", "mark", F.lit(False).alias("once")).distinct()
    named = first.unionByName(loose).toDF("of_id", "of_mark", "once")
    body = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(body).alias("mark"))
    kept = whole.join(named, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark"))).select("kept", "id", "mark", "once")
    both = kept.where("once").dropDuplicates(["id", "mark"]).unionByName(kept.where("not once"))
    return both.select("kept.*")


def sketch_matrix(sketches: list[bytes]) -> dict[int, np.ndarray]:
    """At 0 the sketches' lengths; at each length that occurs, all sketches of that length or more, folded to it: [row, word]."""
    own = np.array([len(s) for s in sketches])
    out, wide = {0: own}, None
    for n in sorted(set(own.tolist()), reverse=True):
        here = np.zeros((len(own), n // 8), np.uint64)
        if wide is not None:
            while wide.shape[1] > n // 8:
                half = wide.shape[1] // 2
                wide = wide[:, :half] ^ wide[:, half:]
            here[:] = wide
        here[own == n] = np.frombuffer(b"".join(s for s in sketches if len(s) == n), np.uint64).reshape(-1, n // 8)
        out[n] = wide = here
    return out


def sketch_distances(bits: dict[int, np.ndarray], x: int, y: np.ndarray) -> np.ndarray:
    """Hamming distances of row x to the rows y, each pair at the shorter one's length."""
    own, out = bits[0], np.zeros(len(y), np.int64)
    short = np.minimum(own[y], own[x])
    for n in np.unique(short).tolist():
        use = short == n
        out[use] = np.bitwise_count(bits[n][y[use]] ^ bits[n][x]).sum(1)
    return out
