"""Packing of token sequences: dominance reduction of Martello and Toth, then best fit.

Only the number of pieces of each length matters for packing, and lengths are at most the capacity. So
the driver gets a histogram of at most ``capacity`` rows, however many documents there are, and decides
for ranges of equal pieces: "pieces 70 to 99 of length 512 go to bins 300 to 329 at offset 1024". The
decisions are looked up by length and rank in the tasks.

A set of pieces dominates another that holds the same piece if the other's pieces can be stacked into
the places of its own. Three rules find dominating sets of up to three pieces (see ``reduce_sizes``);
bins fixed by them occur in some best packing. What no rule decides is packed by best fit, largest
first.
"""

from __future__ import annotations

import bisect
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightwatch.llm.registry import query
from flightwatch.llm.tables import arrow_schema, settled, slices, table

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker remembers.
REMEMBERED = 300_000

# The tokenizer's own pre-splitting, written for lower-cased Latin-1 text.
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+"
# Outside these characters (or with a special token's mark) the tokenizer reads the text itself.
_PLAIN = r"[\t\n\r\x20-\x7e\xa1-\xff]*"


class Encoder:
    """Ids of texts, as bytes of little-endian unsigned 32-bit numbers, with a memory of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.split, self.plain = re.compile(_SPLIT).findall, re.compile(_PLAIN).fullmatch
        self.known: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null text has none. Words that are not remembered are encoded once for all texts given."""
        split = [self.split(t.lower()) if t and "<|" not in t and self.plain(t) else None for t in texts]
        known = self.known
        new = list({w for words in split if words for w in words if w not in known})
        found = dict(zip(new, self._ids(new), strict=True))
        if len(known) < REMEMBERED:
            known.update(found)
        out = []
        for t, words in zip(texts, split, strict=True):
            if words is None:
                out.append(self._ids([t])[0] if t else b"")
            else:
                out.append(b"".join([known[w] if w in known else found[w] for w in words]))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _ENCODERS:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each text's ids and ``end_id``, cut at ``capacity``."""
    end = np.asarray([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long"
    schema = arrow_schema(ddl)

    def cut(batches):
        encode = encoder(path).encode
        for docs, texts in slices(batches, "doc_id", "text"):
            rows = []
            for doc, ids in zip(docs, encode(texts), strict=True):
                ids += end
                rows += [(doc, at // step, at // 4, len(x := ids[at:at + step]) // 4, zlib.crc32(x))
                         for at in range(0, len(ids), step)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(cut, ddl)


class Slots:
    """Decisions: pieces of ``length`` from rank ``first`` on, ``count`` of them, to bins from ``bin`` on."""

    def __init__(self):
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.used: dict[int, int] = {}
        self.bins = 0

    def put(self, length: int, count: int, bin_from: int, offset: int) -> None:
        first = self.used.get(length, 0)
        self.rows.append((length, first, count, bin_from, offset))
        self.used[length] = first + count

    def fill(self, lengths: list[int], times: int) -> int:
        """``times`` new bins that hold ``lengths`` each; the first one's number."""
        at, offset = self.bins, 0
        for length in lengths:
            self.put(length, times, at, offset)
            offset += length
        self.bins += times
        return at


def _fitting(sizes: list[int], room: int, left: dict[int, int], besides: tuple[int, ...] = ()) -> int | None:
    """The largest size of at most ``room`` of which a piece is left besides those named."""
    i = bisect.bisect_right(sizes, room) - 1
    while i >= 0:
        if left[sizes[i]] > besides.count(sizes[i]):
            return sizes[i]
        i -= 1
    return None


def _smallest(sizes: list[int], n: int, left: dict[int, int], besides: int, above: int = 0) -> list[int]:
    """The ``n`` smallest pieces left, without one of size ``besides``, larger than ``above``."""
    out: list[int] = []
    for s in sizes[bisect.bisect_right(sizes, above):]:
        out += [s] * min(n - len(out), left[s] - (s == besides))
        if len(out) >= n:
            break
    return out


def reduce_sizes(counts: dict[int, int], capacity: int, slots: Slots) -> dict[int, int]:
    """Fix bins that dominate all others for their largest piece; what remains undecided is returned.

    For each piece w, the largest first, with the room r beside it, among all pieces not fixed yet:
    no piece fits: {w}. A piece of exactly r is left: {w, r}, as whatever else fits stacks up into r.
    Two pieces never fit: {w, largest fitting}. Three never fit: {w, b} if the largest fitting b is no
    smaller than the best pair; {w, b, c} with the largest c beside b, if no two pieces larger than c
    fit together.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    sizes = sorted(left)
    for w in sorted(left, reverse=True):
        while left.get(w):
            chosen = _dominating(w, capacity - w, sizes, left)
            if chosen is None:
                break
            times = min(left[s] // chosen.count(s) for s in set(chosen))
            slots.fill(chosen, times)
            for s in chosen:
                left[s] -= times
            for s in {s for s in chosen if not left[s]}:
                del left[s]
                sizes.remove(s)
    return left


def _dominating(w: int, room: int, sizes: list[int], left: dict[int, int]) -> list[int] | None:
    least = _smallest(sizes, 3, left, w)
    if not least or least[0] > room:
        return [w]
    if left.get(room, 0) > (room == w):
        return [w, room]
    b = _fitting(sizes, room, left, (w,))
    if len(least) < 2 or least[0] + least[1] > room:
        return [w, b]
    if len(least) < 3 or sum(least) > room:
        pair = max((x + y for x in sizes if left[x] > (x == w) and x < room
                    for y in [_fitting(sizes, room - x, left, (w, x))] if y), default=0)
        if b >= pair:
            return [w, b]
        c = _fitting(sizes, room - b, left, (w, b))
        if c:
            over = _smallest(sizes, 2, left, w, above=c)
            if len(over) < 2 or sum(over) > room:
                return [w, b, c]
    return None


def best_fit(counts: dict[int, int], capacity: int, slots: Slots) -> None:
    """Largest first, each into the fullest bin that has room; equal pieces and equal bins at a time."""
    open_bins: dict[int, list[tuple[int, int]]] = {}  # room left: (first bin, number)
    rooms: list[int] = []

    def keep(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in open_bins:
                open_bins[room] = []
                bisect.insort(rooms, room)
            open_bins[room].append((first, n))

    for size in sorted(counts, reverse=True):
        todo = counts[size]
        while todo:
            i = bisect.bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[i]
            else:
                room, n = capacity, -(-todo // (capacity // size))
                first = slots.bins
                slots.bins += n
            each = room // size
            full = min(n, todo // each)
            for k in range(each if full else 0):
                slots.put(size, full, first, capacity - room + k * size)
            keep(room - each * size, first, full)
            todo -= full * each
            first, n = first + full, n - full
            if n and 0 < todo < each:
                for k in range(todo):
                    slots.put(size, 1, first, capacity - room + k * size)
                keep(room - todo * size, first, 1)
                first, n, todo = first + 1, n - 1, 0
            keep(room, first, n)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> Slots:
    slots = Slots()
    best_fit(reduce_sizes(counts, capacity, slots), capacity, slots)
    return slots


def with_rank(pieces: DataFrame, keys: list[str], order: list[str], part: str = "part") -> DataFrame:
    """Number the rows of each key from 0 without gathering a key: counts by (key, part), their prefix
    sums, and row numbers inside (key, part)."""
    begins = (pieces.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("_rows"))
              .select(*keys, part, F.coalesce(F.sum("_rows").over(
                  Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)),
                  F.lit(0)).alias("_before")))
    inside = Window.partitionBy(*keys, part).orderBy(*order)
    return (pieces.join(begins, [*keys, part])
            .withColumn("rank", F.col("_before") + F.row_number().over(inside) - 1).drop("_before"))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every text's ids and a closing id 0 in sequences of at most ``capacity`` ids.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Only texts of more than
    ``capacity`` ids are cut. A null or empty text is the closing id alone. Rows with equal or null ids
    are packed one by one; which of two equal pieces takes which place is open. An empty table gives no
    rows; other columns of ``docs`` are not read.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    pieces = settled(token_pieces(docs, path, capacity).withColumn("part", F.spark_partition_id()))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = np.asarray(sorted(plan_bins(counts, capacity).rows), dtype=np.int64).reshape(-1, 5)
    # One number orders (length, rank): the table has its length in the high bits.
    starts = (rows[:, 0] << 48) + rows[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(starts, (length.to_numpy() << 48) + rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": rows[at, 3] + rank.to_numpy() - rows[at, 1], "offset": rows[at, 4]})

    return (with_rank(pieces, ["length"], ["doc_id", "piece", "ids_crc32"])
            .withColumn("_place", place("length", "rank"))
            .select("doc_id", "piece", "start", "length", "ids_crc32", "_place.sequence_id", "_place.offset"))


@query("op7_packing")
def op7_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
