"""Best-fit packing of tokenised documents into sequences.

Best-two-fit: a bin is filled greedily with the largest piece that fits; then its
smallest piece is replaced by two unpacked pieces that fill the expanded gap more
tightly, when there are two such pieces. Pieces are dealt to groups of a bounded
number of pieces by a hash of their document and offset, so no task ever holds
more than one group; a group loses at most its one last, part-filled bin.

Token ids: a space between two characters that are no white space always starts a
new pre-token, so the text is cut there and the ids of each part are cached. What
is not cached is encoded by the byte-pair ranks of the same vocabulary. A text that
holds one of the vocabulary's added tokens is encoded whole by `tokenizers`, which gives
such a token its own id.

Defined cases: a null or empty text is one piece with the end token alone; a null
id is kept; repeated rows are packed like any others; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, cut, session, text_or_empty

#: Parts of text whose ids one worker keeps.
CACHE = 400_000
#: Pieces that one packing task gets, about.
GROUP_PIECES = 40_000
END = 2
#: White space next to a space, or rare white space: such a text is encoded whole.
ODD = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ", *"\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))


@lru_cache(2)
def encoder(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(2)
def whole_encoder(vocabulary: str):
    """The added tokens' texts, and the encoder that knows them."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary)
    return [t.content for t in own.get_added_tokens_decoder().values()], lambda text: own.encode(text, add_special_tokens=False).ids


class Ids:
    """Token ids of texts, with a bounded cache of the ids of space-separated parts."""

    def __init__(self, vocabulary: str, ranks_path: str, pattern: str):
        self.encode, self.seen, self.at = encoder(ranks_path, pattern), {}, 0
        self.added, self.whole = whole_encoder(vocabulary)
        self.flat, self.starts, self.sizes = np.empty(1 << 20, np.uint32), [], []

    def place(self, part: str) -> int:
        ids = self.encode(part)
        if self.at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[self.at : self.at + len(ids)] = ids
        self.starts.append(self.at)
        self.sizes.append(len(ids))
        self.at += len(ids)
        self.seen[part] = len(self.starts) - 1
        return len(self.starts) - 1

    def of(self, texts: list[str]) -> list[np.ndarray]:
        odd = {i for i, t in enumerate(texts) if any(a in t for a in self.added)}
        out = self.plain(["" if i in odd else t for i, t in enumerate(texts)])
        for i in odd:
            out[i] = np.array(self.whole(texts[i]), np.uint32)
        return out

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.seen) > CACHE or self.at > 8 * CACHE:
            self.seen, self.at, self.starts, self.sizes = {}, 0, [], []
        get, place, numbers, counts = self.seen.get, self.place, [], []
        for text in texts:
            if not text:
                parts = []
            elif text[0] == " " or text[-1] == " " or any(x in text for x in ODD):
                parts = [text]
            else:
                parts = text.split(" ")
                first = parts[0]
                parts = [" " + p for p in parts]
                parts[0] = first
            found = [get(p) for p in parts]
            if None in found:
                found = [(place(p) if (k := get(p)) is None else k) if n is None else n for n, p in zip(found, parts, strict=True)]
            numbers.extend(found)
            counts.append(len(found))
        n = np.array(numbers, np.int64)
        starts, sizes = np.array(self.starts, np.int64)[n], np.array(self.sizes, np.int64)[n]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]
        edges = np.r_[0, ends][np.cumsum([0, *counts])]
        return [flat[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


PIECES = "doc_id long,piece int,start long,length long,ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, ranks_path: str, pattern: str, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document: its ids, an end token, cut only where longer than size; the first piece gets the remainder.

    vocabulary is the tokenizer's file, ranks_path and pattern the same vocabulary's byte-pair ranks and pre-token pattern.
    """
    session(docs)
    schema = arrow_schema(PIECES)

    def run(batches):
        ids_of = Ids(vocabulary, ranks_path, pattern)
        for batch in batches:
            rows = [[], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of.of(batch.column(1).to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for c, v in zip(rows, (doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return text_or_empty(docs.select(id_col, text_col), text_col).mapInArrow(run, PIECES)


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece its bin and its place there. lengths: 1 to size."""
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    for i, n in enumerate(lengths.tolist()):
        stacks[n].append(i)
    have = sum(1 << n for n in range(1, size + 1) if stacks[n])  # bit n: a piece of length n is left
    mirror = sum(1 << (size - n) for n in range(1, size + 1) if stacks[n])
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def take(n: int) -> int:
        nonlocal have, mirror
        i = stacks[n].pop()
        if not stacks[n]:
            have ^= 1 << n
            mirror ^= 1 << (size - n)
        return i

    def give(n: int, i: int) -> None:
        nonlocal have, mirror
        if not stacks[n]:
            have |= 1 << n
            mirror |= 1 << (size - n)
        stacks[n].append(i)

    def two(most: int, over: int) -> tuple[int, int] | None:
        """Two lengths with the largest sum at most `most` and above `over`."""
        for total in range(most, over, -1):
            # a length n is left and so is total - n: bit size - n of mirror, shifted to bit total - n
            both = have & (mirror >> (size - total) if size >= total else mirror << (total - size))
            while both:
                a = both.bit_length() - 1
                b = total - a
                if b > 0 and (a != b or len(stacks[a]) > 1):
                    return a, b
                both ^= 1 << a
        return None

    k = 0
    while have:
        held, gap = [], size
        while gap and (fits := have & ((2 << gap) - 1)):
            n = fits.bit_length() - 1
            held.append((n, take(n)))
            gap -= n
        if gap and have and len(held) > 1:
            n, i = held[-1]  # the smallest: lengths fall as the bin fills
            if pair := two(gap + n, n):
                held.pop()
                give(n, i)
                held += [(m, take(m)) for m in pair]
        at = 0
        for n, i in held:
            bins[i], places[i] = k, at
            at += n
        k += 1
    return bins, places


PACKED = PIECES + ",sequence_id long,offset long"


def pack_best_fit(parts: DataFrame, size: int = 1024) -> DataFrame:
    """parts (PIECES) with the sequence of each piece and its place there."""
    spark = session(parts)
    parts = cut(parts)
    groups = max(1, round(parts.count() / GROUP_PIECES))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), groups)
    schema = arrow_schema(PACKED)

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort([table.column(c).to_numpy() for c in ("ids_crc32", "start", "doc_id")] if not table.column("doc_id").null_count else [table.column(c).to_numpy() for c in ("ids_crc32", "start")])
        bins, places = best_two_fit(table.column("length").to_numpy()[order], size)
        back = np.argsort(order)
        first = table.column("grp")[0].as_py() << 40
        table = table.drop_columns("grp").append_column("sequence_id", pa.array(bins[back] + first)).append_column("offset", pa.array(places[back]))
        return table.cast(schema)

    whole = parts.where(F.col("length") == size).select("*", (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = parts.where(F.col("length") < size).withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    packed = rest.repartition(tasks, "grp").groupBy("grp").applyInArrow(run, PACKED)
    return whole.unionByName(packed)
