"""Near-duplicate texts: an exact Jaccard join of word n-gram sets with a count-vector R-tree.

A text's set is hashed into groups, and the counts of the groups are a point. Two sets share at most the sum
of the smaller counts, group by group, so a box of points is bounded by its largest counts: a tree of boxes
leaves out what cannot reach the threshold, and only the pairs that survive are compared in full.

So that no point has to meet all others, points are dealt out by shingles. Two sets that reach the threshold
share one of the first shingles of either in any common order (the prefix filter), and shingles that many
texts share stand last in it; of the smaller set, a shorter beginning is enough. Rows of a block without a partner
of fitting size go before anything moves on. Equal sets are one point. In each block of points with a shingle in common:

1. every point is compared with two leaders of its block; that joins the bulk of large groups of near copies
   with a number of comparisons linear in their size;
2. points of one component need not be compared again, so the trees search what is left: pairs of a block
   from different components. Blocks with the same members are searched once.
3. where the trees let through more pairs than points, no pairs are told: these points are compared with the one that
   most leaders are linked with, and what is still open where the sets lie, set by set: blocks around one such point, which
   mostly hold the same sets, as one. This tells only the links that join components: never more of them than points.

Pairs are looked at by few coarse counts first, and by the full ones if these allow the threshold. Blocks larger than a tile are cut into tiles and every pair of tiles is searched, so no task holds a block
whole and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightwatch.llm.graph import components
from flightwatch.llm.registry import query
from flightwatch.llm.tables import arrow_schema, settled, slices, small_batches, table

WORDS = 5
#: The threshold: NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 75, 100
#: Shingles that count as frequent when seen in so many of a run of texts, and how many of them are known at most.
#: They only decide the order of shingles: any order gives the same result.
FREQUENT, FREQUENT_KNOWN = 3, 400_000
FREQUENT_RUN = 4_000_000
#: Shingles of prefixes that a task holds before it sends them.
RUN = 1_000_000
#: Bytes of them that are sent at a time, about.
SENT_BYTES = 4 << 20
#: Sizes of sets are told to blocks by the floor of SIZE_STEPS * log n: those that fit differ by SIZE_REACH at most.
SIZE_STEPS, SIZE_REACH = 500, 144
#: Bytes of text that are hashed at a time; a longer text is alone.
HASHED_BYTES = 1 << 19
#: Groups for each shingle of a set, at least; logarithms of the least and largest number of groups.
GROUPS_EACH, LEAST_LOG, MOST_LOG = 2, 3, 17
#: Groups of a point that one group of a box stands for; cells of a tree's points.
COARSER, CELLS = 8, 1 << 25
BUCKET_ROWS = 400_000
TILE, LEAF = 1024, 32
#: Shingles of the sets of a tile, about.
TILE_SHINGLES = 2_000_000
#: Numbers of sets (16 bytes each) up to which they are broadcast to find their texts; beyond, texts move to them.
BROADCAST_SETS = 1_000_000
#: Pairs that are compared with one set in a task.
PARTNERS = 256

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 1 << 62)) * 4 + 1
_BACK = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Shingle sets of texts as sorted arrays of 64-bit hashes."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """One array per text; a text of fewer than WORDS words has one shingle, an empty one none."""
        out, raw, size = [], [], 0
        for t in texts:
            raw.append(t.encode("utf-8", "surrogatepass").translate(_FOLD) if t else b"")
            size += len(raw[-1])
            if size >= HASHED_BYTES:
                out += self._sets(raw)
                raw, size = [], 0
        return out + self._sets(raw) if raw else out

    def _sets(self, raw: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        if len(data) > len(self.up):
            self.up, self.down = _powers(_BASE, len(data)), _powers(_BACK, len(data))
        space = _SPACE[data]
        edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
        begins, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * self.up[:len(data)], dtype=np.uint64)])
        word = _mix((sums[ends] - sums[begins]) * self.down[begins] + (ends - begins).astype(np.uint64))
        until = np.searchsorted(begins, np.cumsum([len(r) + 1 for r in raw]))
        grams = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
        for k in range(WORDS):
            grams += word[k:len(word) - WORDS + 1 + k] * _PLACE[k] if len(grams) else grams
        grams = _mix(grams)
        out, first = [], 0
        for last in until.tolist():
            n = last - first
            if n >= WORDS:
                out.append(np.unique(grams[first:last - WORDS + 1]))
            elif n:
                short = (word[first:last] * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)
                out.append(_mix(np.asarray([short], np.uint64) ^ np.uint64(0x5851F42D4C957F2D)))
            else:
                out.append(np.zeros(0, np.uint64))
            first = last
        return out


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit number for a set."""
    x = _mix(np.asarray([_mix(s).sum(dtype=np.uint64) + np.uint64(len(s)), np.bitwise_xor.reduce(_mix(~s))], np.uint64))
    return int((x[:1] * np.uint64(3) + x[1:]).astype(np.int64)[0])


_FOUR = np.stack([(np.arange(256) >> k) & 3 for k in (0, 2, 4, 6)], axis=1).astype(np.uint8)


def counts_of(s: np.ndarray) -> bytes:
    """Counts of the groups, two bits each, never more than 3: what is cut off is the size less their sum."""
    k = max(LEAST_LOG, min(MOST_LOG, (GROUPS_EACH * len(s) - 1).bit_length()))
    counts = np.minimum(np.bincount((s >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k), 3).astype(np.uint8)
    return (counts[0::4] | counts[1::4] << 2 | counts[2::4] << 4 | counts[3::4] << 6).tobytes()


def coarse_of(s: np.ndarray) -> bytes:
    """Counts of an eighth or less of the groups, four bits each, never more than 15."""
    k = max(LEAST_LOG, min(MOST_LOG, max(1, len(s)).bit_length() - 2))
    counts = np.minimum(np.bincount((s >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k), 15).astype(np.uint8)
    return (counts[0::2] | counts[1::2] << 4).tobytes()


def unpacked(blobs: list[bytes], bits: int) -> np.ndarray:
    """Counts of blobs of one length as rows of a matrix."""
    packed = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)
    parts = [(packed >> np.uint8(k)) & np.uint8((1 << bits) - 1) for k in range(0, 8, bits)]
    return np.stack(parts, axis=2).reshape(len(blobs), -1)


def most_shared(a: list[bytes], b: list[bytes], na: np.ndarray, nb: np.ndarray, bits: int) -> np.ndarray:
    """For each pair of counts the most shingles that the sets can share.

    Finer counts added up are cut off again, as the coarser ones are: then both sides leave out exactly what a
    group holds beyond the limit, and no pair shares more of that than either side left out.
    """
    out = np.zeros(len(a), np.int64)
    widths = np.asarray([(len(x), len(y)) for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    limit = np.uint8((1 << bits) - 1)
    for wa, wb in np.unique(widths, axis=0).tolist():
        alike = np.flatnonzero((widths[:, 0] == wa) & (widths[:, 1] == wb))
        width, step = min(wa, wb) * 8 // bits, max(1, CELLS // 32 // max(wa, wb))
        for at in range(0, len(alike), step):
            rows = alike[at:at + step]
            p, q = (unpacked([x[i] for i in rows], bits) for x in (a, b))
            p, q = (np.minimum(x.reshape(len(rows), width, -1).sum(axis=2, dtype=np.uint32), limit).astype(np.uint8)
                    if x.shape[1] > width else x for x in (p, q))
            spare = np.minimum(na[rows] - p.sum(axis=1, dtype=np.int64), nb[rows] - q.sum(axis=1, dtype=np.int64))
            out[rows] = np.minimum(p, q).sum(axis=1, dtype=np.int64) + spare
    return out


def points_of(blobs: list[bytes], width: int | None = None) -> np.ndarray:
    """Counts as rows of one matrix, the finer ones added up to ``width``, or else to the coarsest."""
    width = width or 4 * min(map(len, blobs))
    out = np.empty((len(blobs), width), np.uint8)
    for i, b in enumerate(blobs):
        row = _FOUR[np.frombuffer(b, np.uint8)].ravel()
        out[i] = row if len(row) == width else np.minimum(row.reshape(width, -1).sum(axis=1), 255)
    return out


def needed(a, b):
    """Least overlap of sets of sizes ``a`` and ``b`` at the threshold."""
    return -((-NUMERATOR * (a + b)) // (NUMERATOR + DENOMINATOR))


class CountTree:
    """An R-tree over points: leaves of up to LEAF points in order of size and of their heaviest half, boxes above.

    Boxes hold the largest counts of coarser groups; single points are compared in full.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        # What the counts leave out may all be shared.
        self.over = sizes - points.sum(axis=1, dtype=np.int64)
        self.coarse = self.coarser(points)
        half = points[:, :points.shape[1] // 2].sum(axis=1, dtype=np.int64)
        slab = np.argsort(np.argsort(sizes, kind="stable"), kind="stable") // (4 * LEAF)
        order = np.lexsort((half, slab))
        self.leaves = [order[i:i + LEAF] for i in range(0, len(sizes), LEAF)]
        level = (np.stack([self.coarse[m].max(axis=0) for m in self.leaves]), np.asarray([sizes[m].min() for m in self.leaves]),
                 np.asarray([sizes[m].max() for m in self.leaves]), np.asarray([self.over[m].max() for m in self.leaves]))
        self.levels = [level]
        while len(level[0]) > 8:
            runs, (top, low, high, over) = range(0, len(level[0]), 8), level
            level = (np.stack([top[i:i + 8].max(axis=0) for i in runs]), np.asarray([low[i:i + 8].min() for i in runs]),
                     np.asarray([high[i:i + 8].max() for i in runs]), np.asarray([over[i:i + 8].max() for i in runs]))
            self.levels.append(level)

    @staticmethod
    def coarser(points: np.ndarray) -> np.ndarray:
        return points.reshape(*points.shape[:-1], -1, COARSER).sum(axis=-1, dtype=np.int16)

    @staticmethod
    def _may(point, size, spare, top, low, high, over) -> np.ndarray:
        out = np.flatnonzero((DENOMINATOR * high >= NUMERATOR * size) & (NUMERATOR * low <= DENOMINATOR * size))
        if len(out):
            least = np.maximum(low[out], -(-NUMERATOR * size // DENOMINATOR))
            bound = np.minimum(top[out], point).sum(axis=1, dtype=np.int64) + over[out] + spare
            out = out[bound >= needed(size, least)]
        return out

    def search(self, k: int) -> np.ndarray:
        """Numbers of the points whose sets may reach the threshold with the set of point ``k``."""
        point, size, spare = self.coarse[k], int(self.sizes[k]), int(self.over[k])
        at = len(self.levels) - 1
        boxes = np.arange(len(self.levels[at][0]))
        while len(boxes):
            boxes = boxes[self._may(point, size, spare, *[x[boxes] for x in self.levels[at]])]
            if at == 0:
                break
            at -= 1
            boxes = (boxes[:, None] * 8 + np.arange(8)).ravel()
            boxes = boxes[boxes < len(self.levels[at][0])]
        if not len(boxes):
            return boxes
        inside = np.concatenate([self.leaves[b] for b in boxes])
        # Coarse counts first: they leave out most at little cost.
        inside = inside[self._may(point, size, spare, self.coarse[inside], self.sizes[inside], self.sizes[inside], self.over[inside])]
        n = self.sizes[inside]
        return inside[self._may(self.points[k], size, spare, self.points[inside], n, n, self.over[inside])]


def _described(docs: DataFrame) -> DataFrame:
    """A row for each text (``kind`` 0: doc_id, n, sid, counts, coarse) and for each frequent shingle of a run of
    texts (``kind`` 1: shingle in ``sid``, texts in ``n``)."""
    ddl = "kind int, doc_id long, n long, sid long, counts binary, coarse binary"
    schema = arrow_schema(ddl)

    def batch(kind, ids, n, sids, counts, coarse):
        cols = [[kind] * len(sids), ids, n, sids, counts, coarse]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    def frequent(every: np.ndarray):
        every.sort()
        # Equal ones lie side by side; only what is frequent is counted.
        found = np.unique(every[FREQUENT - 1:][every[FREQUENT - 1:] == every[:len(every) - FREQUENT + 1]])
        n = np.searchsorted(every, found, "right") - np.searchsorted(every, found, "left")
        return batch(1, [None] * len(n), n.tolist(), found.astype(np.int64).tolist(), [None] * len(n), [None] * len(n))

    def describe(batches):
        # Shingles of a run lie in one array, which is sorted in place: no set is kept besides.
        hasher, run, held, seen = Hasher(), np.empty(FREQUENT_RUN, np.uint64), 0, set()
        for ids, texts in slices(batches, "doc_id", "text"):
            sets = hasher.sets(texts)
            sids = [set_id(s) if len(s) else None for s in sets]
            yield batch(0, ids, [len(s) for s in sets], sids, [counts_of(s) if len(s) else None for s in sets],
                        [coarse_of(s) if len(s) else None for s in sets])
            for i, s in zip(sids, sets, strict=True):
                if i is None or i in seen:
                    continue
                if held + len(s) > len(run) and held:
                    yield frequent(run[:held])
                    held = 0
                    seen.clear()
                # A set that is longer than a run would be alone in it, and none of its shingles frequent.
                if len(s) <= len(run):
                    run[held:held + len(s)] = s
                    held += len(s)
                    seen.add(i)
        if held:
            yield frequent(run[:held])

    return docs.mapInArrow(describe, ddl)


def paired(block: np.ndarray, fact: np.ndarray) -> np.ndarray:
    """Numbers of the rows of blocks of which another row of the block may be the partner: its size fits and the
    smaller one is early. ``fact``: step of the size, early, stands for several. Of a block with a row that stands
    for several sets all rows are kept. A row of ``block`` alone is never kept, marked or not: what it stands for
    goes another way, itself included."""
    size, early, several = (fact >> 2).astype(np.int64), (fact & 2) > 0, (fact & 1) > 0
    by = np.lexsort((~early, size, block))
    b, n, e = block[by], size[by], early[by]
    begin = np.concatenate([[True], b[1:] != b[:-1]])
    number = np.cumsum(begin) - 1
    at = np.arange(len(b))
    # Early ones stand first among equal sizes: the nearest early row before a row is its best smaller partner.
    before = np.concatenate([[-1], np.maximum.accumulate(np.where(e, at, -1))[:-1]])
    up = (before >= 0) & (b[before] == b) & (n - n[before] <= SIZE_REACH)
    after = np.minimum(at + 1, len(b) - 1)
    down = e & (after > at) & (b[after] == b) & (n[after] - n <= SIZE_REACH)
    whole = np.zeros(number[-1] + 1, bool)
    whole[number[several[by]]] = True
    alone = begin & np.concatenate([begin[1:], [True]])
    return np.sort(by[~alone & (up | down | whole[number])])


def _signatures(docs: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """``block, sid, size, early`` of texts that share a shingle of their prefixes with a different set.

    ``size`` is the step of the set's size; ``early`` says that the shingle lies in the beginning that is enough for the
    smaller set of a pair. A row of a block is kept if there is another row with which it may be a pair.

    Tasks send (shingle, set) pairs to buckets, packed. A shingle that a task has seen in several sets is known to
    be shared: its sets go straight on, and only one of them to the bucket. So a bucket gets a shingle once from
    each run of texts, however many texts have it. As it stands for several sizes, nothing of its block is left out.
    """
    frequent_sorted = np.sort(frequent)
    rank = np.argsort(frequent, kind="stable").astype(np.uint64)
    mapped = "bucket int, straight boolean, shingles binary, sids binary, facts binary"
    mapped_schema = arrow_schema(mapped)

    def prefix(s: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The set's first shingles and a fact for each: step of the size, early or not, two bits from the right."""
        n = len(s)
        length = n - (-(-NUMERATOR * n // DENOMINATOR)) + 1
        beginning = n - needed(n, n) + 1
        key = _mix(s ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
        maybe = np.flatnonzero(seen[(s >> np.uint64(40)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(frequent_sorted, s[maybe]), len(frequent_sorted) - 1)
            hit = frequent_sorted[at] == s[maybe]
            key[maybe[hit]] = np.uint64(1 << 63) + rank[at[hit]]
        first = np.argpartition(key, length - 1)[:length] if length < n else np.arange(n)
        last = np.partition(key[first], beginning - 1)[beginning - 1]
        step = int(SIZE_STEPS * np.log(n)) << 2
        return s[first], np.where(key[first] <= last, step | 2, step).astype(np.uint16)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), mapped_schema.types, strict=True)],
                                          schema=mapped_schema)

    def emit(run: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        shingle = np.concatenate([v[0] for v in run.values()])
        fact = np.concatenate([v[1] for v in run.values()])
        sid = np.repeat(np.fromiter(run, np.int64, len(run)), [len(v[0]) for v in run.values()])
        run.clear()
        by = np.argsort(shingle, kind="stable")
        shingle, sid, fact = shingle[by], sid[by], fact[by]
        del by
        first = np.concatenate([[True], shingle[1:] != shingle[:-1]])
        alone = first & np.concatenate([first[1:], [True]])
        low = (shingle // np.uint64(buckets)).astype(np.uint32)
        bucket = (shingle % np.uint64(buckets)).astype(np.int64)
        del shingle

        def parts():
            shared = np.flatnonzero(~alone)
            for at in range(0, len(shared), 65_536):
                part = shared[at:at + 65_536]
                yield True, part, (bucket[part] << 32) | low[part].astype(np.int64), fact[part]
            firsts = np.flatnonzero(first)
            firsts = firsts[np.argsort(bucket[firsts], kind="stable")]
            cuts = np.flatnonzero(np.diff(bucket[firsts])) + 1
            for part in np.split(firsts, cuts):
                # The one that stands for several is marked.
                yield False, part, low[part], fact[part] | (~alone[part]).astype(np.uint16)

        rows, size = [], 0
        for straight, part, shingles, facts in parts():
            rows.append((int(bucket[part[0]]), straight, shingles.tobytes(), sid[part].tobytes(), facts.tobytes()))
            size += sum(map(len, rows[-1][2:]))
            if size >= SENT_BYTES or len(rows) == 64:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    def sign(batches):
        seen = np.zeros(1 << 24, bool)
        seen[(frequent_sorted >> np.uint64(40)).astype(np.int64)] = True
        hasher, run, held = Hasher(), {}, 0
        for (texts,) in slices(batches, "text"):
            for s in hasher.sets(texts):
                if len(s) and (i := set_id(s)) not in run:
                    run[i] = prefix(s, seen)
                    held += len(run[i][0])
            if held > RUN:
                yield from emit(run)
                held = 0
        if run:
            yield from emit(run)

    def share(group: pd.DataFrame) -> pd.DataFrame:
        straight = group.straight.to_numpy(bool)
        block = [np.frombuffer(x, np.int64) for x in group.shingles[straight]]
        sid = [np.frombuffer(x, np.int64) for x in group.sids[straight]]
        fact = [np.frombuffer(x, np.uint16) for x in group.facts[straight]]
        if (~straight).any():
            low, who, what = (np.concatenate([np.frombuffer(x, t) for x in group[c][~straight]])
                              for c, t in (("shingles", np.uint32), ("sids", np.int64), ("facts", np.uint16)))
            # Of a set that came several times the marked row is kept.
            by = np.lexsort((~what, who, low))
            low, who, what = low[by], who[by], what[by]
            new = np.concatenate([[True], (low[1:] != low[:-1]) | (who[1:] != who[:-1])])
            kept = paired(low[new], what[new])
            block.append((int(group.bucket.iloc[0]) << 32) | low[new][kept].astype(np.int64))
            sid.append(who[new][kept])
            fact.append(what[new][kept])
        fact = np.concatenate(fact).astype(np.int32)
        return pd.DataFrame({"block": np.concatenate(block), "sid": np.concatenate(sid), "size": fact >> 2, "early": (fact & 2) > 0})

    packed = docs.select("text").mapInArrow(sign, mapped)
    # Rows of known sharing are spread: they need no meeting.
    key = F.when(F.col("straight"), F.xxhash64("shingles", "sids")).otherwise(F.col("bucket").cast("long"))
    return packed.withColumn("_key", key).groupBy("_key", "straight").applyInPandas(share, "block long, sid long, size int, early boolean")


def _bounded(pairs: DataFrame, points: DataFrame, counts: str = "counts", bits: int = 2) -> DataFrame:
    """The pairs ``u, v`` whose sizes and counts allow the threshold."""
    ddl = "u long, v long"
    schema = arrow_schema(ddl)

    def bound(batches):
        for us, vs, a, b, na, nb in slices(batches, "u", "v", "a", "b", "na", "nb", rows=1024):
            na, nb = np.asarray(na, np.int64), np.asarray(nb, np.int64)
            kept = np.flatnonzero(most_shared(a, b, na, nb, bits) >= needed(na, nb))
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)[kept]) for x in (us, vs)], schema=schema)

    fits = (F.least("na", "nb") * DENOMINATOR >= F.greatest("na", "nb") * NUMERATOR)
    return (pairs.join(points.select(F.col("sid").alias("u"), F.col("n").alias("na"), F.col(counts).alias("a")), "u")
            .join(points.select(F.col("sid").alias("v"), F.col("n").alias("nb"), F.col(counts).alias("b")), "v")
            .filter(fits).mapInArrow(bound, ddl))


def _allowed(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs ``u, v`` that coarse counts allow, and then full ones: only what the former leave is joined with the
    latter, which are larger."""
    return _bounded(settled(_bounded(pairs, points, "coarse", 4)), points)


def _sets(asked: DataFrame, docs: DataFrame, points: DataFrame) -> DataFrame:
    """``want, items``: the sets named by ``sid`` in ``asked`` (distinct), made again from the texts."""
    ddl = "sid long, items binary"
    schema = arrow_schema(ddl)

    def sets(batches):
        hasher = Hasher()
        for want, texts in slices(batches, "want", "text"):
            rows = [(w, s.tobytes()) for w, s in zip(want, hasher.sets(texts), strict=True) if len(s) and set_id(s) == w]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)],
                                                 schema=schema)

    wanted = settled(asked.join(points, "sid").select("doc_id", F.col("sid").alias("want")))
    if wanted.count() <= BROADCAST_SETS:
        wanted = F.broadcast(wanted)
    return docs.join(wanted, "doc_id").select("want", "text").mapInArrow(sets, ddl)


def reaches(head: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the sets reach the threshold with ``head``."""
    sizes = np.asarray([len(x) for x in others], np.int64)
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(head, every), len(head) - 1)
    both = np.add.reduceat(head[at] == every, np.cumsum(sizes) - sizes, dtype=np.int64)
    return DENOMINATOR * both >= NUMERATOR * (len(head) + sizes - both)


def _verified(pairs: DataFrame, docs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs ``u, v`` whose sets, made again from the texts, reach the threshold."""
    asked = pairs.select(F.col("u").alias("sid")).unionByName(pairs.select(F.col("v").alias("sid"))).distinct()
    made = _sets(asked, docs, points).withColumnRenamed("want", "sid")
    # A set with many partners is compared in several places.
    degree = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("_places"))
    dealt = (pairs.join(degree, "v").withColumn("place", F.pmod(F.xxhash64("u"), F.col("_places")).cast("long")))
    members = dealt.select(F.col("u").alias("sid"), "v", "place", "u")
    heads = dealt.select("v", "place").distinct().select(F.col("v").alias("sid"), "v", "place", F.col("v").alias("u"))
    # Sets are made and moved once, for both parts they play.
    needed_sets = members.unionByName(heads).join(made, "sid").select("v", "place", "u", "items")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        v = group.v.iloc[0]
        head = np.frombuffer(group["items"][group.u == v].iloc[0], np.uint64)
        kept = []
        for u, items in zip(group.u, group["items"], strict=True):
            other = np.frombuffer(items, np.uint64)
            at = np.minimum(np.searchsorted(head, other), len(head) - 1)
            both = int((head[at] == other).sum())
            if u != v and DENOMINATOR * both >= NUMERATOR * (len(head) + len(other) - both):
                kept.append(u)
        return pd.DataFrame({"u": np.asarray(kept, np.int64), "v": np.full(len(kept), v, np.int64)})

    return needed_sets.groupBy("v", "place").applyInPandas(compare, "u long, v long")


def _leaf_pairs(rows: DataFrame, keys: int) -> DataFrame:
    """Pairs ``u, v`` of different components and fitting sizes, the smaller one early, in blocks of at most LEAF
    rows: ``rows`` of block, sid, component, size, early. Such a block is a single leaf; its pairs, mostly met in several blocks, are made distinct
    before their counts are looked at."""
    def search(group: pd.DataFrame) -> pd.DataFrame:
        by = np.argsort(group.block.to_numpy(), kind="stable")
        block, sid, component, size, early = (group[c].to_numpy()[by] for c in ("block", "sid", "component", "size", "early"))
        size = size.astype(np.int64)
        found = [np.zeros((0, 2), np.int64)]
        for d in range(1, LEAF):
            i = np.flatnonzero(block[d:] == block[:-d])
            if not len(i):
                break
            j = i + d
            # Of sets in one step either may be the smaller one.
            fits = ((component[i] != component[j]) & (np.abs(size[i] - size[j]) <= SIZE_REACH)
                    & ((early[i] & (size[i] <= size[j])) | (early[j] & (size[j] <= size[i]))))
            pair = np.stack([sid[i[fits]], sid[j[fits]]], axis=1)
            found.append(np.unique(np.sort(pair, axis=1), axis=0))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

    return (rows.select(F.pmod("block", F.lit(keys)).alias("_key"), "block", "sid", "component", "size", "early")
            .groupBy("_key")
            .applyInPandas(search, "u long, v long").distinct())


def _candidates(group: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """Block by block, and a tree for each: a row of the group and those from other components that may be its partners."""
    across = group.x.iloc[0] != group.y.iloc[0]
    sids, components_, sizes_, mines = (group[c].to_numpy() for c in ("sid", "component", "n", "mine"))
    blobs = group["counts"].tolist()
    lists = [np.asarray(x, np.int64) for x in group["blocks"]]
    row, block = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)
    by = np.argsort(block, kind="stable")
    row, block = row[by], block[by]
    for rows_ in np.split(row, np.flatnonzero(np.diff(block)) + 1):
        component, sid, mine = components_[rows_], sids[rows_], mines[rows_]
        if (component == component[0]).all():
            continue
        sizes = sizes_[rows_].astype(np.int64)
        width = np.asarray([len(blobs[i]) for i in rows_])
        # Sets that can reach the threshold have as many groups or half as many: a tree for each number of groups.
        for w in np.unique(width).tolist():
            inside = np.flatnonzero((width == w) | (width == 2 * w))
            cells = 4 * w
            while cells > 64 and len(inside) * cells > CELLS:
                cells //= 2
            tree = CountTree(points_of([blobs[rows_[i]] for i in inside], cells), sizes[inside])
            for k in np.flatnonzero(width[inside] == w).tolist():
                i = inside[k]
                j = inside[tree.search(k)]
                j = j[((width[j] > w) | (sid[j] > sid[i])) & (component[j] != component[i])]
                if across:
                    j = j[mine[j] != mine[i]]
                if len(j):
                    yield int(rows_[i]), rows_[j]


def few_candidates(group: pd.DataFrame) -> pd.DataFrame:
    """Pairs ``u, v`` of a group; if there are more than rows, only its name, with null ``u`` and ``v``."""
    sids, most = group.sid.to_numpy(), len(group)
    found, held = [np.zeros((0, 2), np.int64)], 0
    for i, j in _candidates(group):
        found.append(np.sort(np.stack([np.full(len(j), sids[i]), sids[j]], axis=1), axis=1))
        held += len(j)
        if held > 2 * most + PARTNERS:
            found = [np.unique(np.concatenate(found), axis=0)]
            held = len(found[0])
            if held > most:
                break
    pairs = np.unique(np.concatenate(found), axis=0)
    dense = len(pairs) > most
    out = pd.DataFrame({"u": pd.array([None], "Int64"), "v": pd.array([None], "Int64")} if dense else
                       {"u": pd.array(pairs[:, 0], "Int64"), "v": pd.array(pairs[:, 1], "Int64")})
    return out.assign(**{c: group[c].iloc[0] for c in ("key", "x", "y")})


def joining_links(group: pd.DataFrame) -> pd.DataFrame:
    """Links ``u, v`` of a group that has its sets (``items``; sizes and counts are told by them): enough to join all that
    its links join, and so fewer than rows. Pairs that are joined already are not compared, nor any pair twice."""
    sids = group.sid.to_numpy()
    items = [np.frombuffer(x, np.uint64) for x in group["items"]]
    group = group.assign(n=[len(x) for x in items], counts=[counts_of(x) for x in items])
    of = pd.factorize(group.component.to_numpy())[0]
    parent = np.arange(len(sids))
    links, seen, new = [], np.zeros(0, np.int64), []
    for i, j in _candidates(group):
        code = np.minimum(i, j) * len(sids) + np.maximum(i, j)
        if len(seen):
            at = np.minimum(np.searchsorted(seen, code), len(seen) - 1)
            code, j = code[seen[at] != code], j[seen[at] != code]
        new.append(code)
        if len(new) >= TILE:
            seen, new = np.unique(np.concatenate([seen, *new])), []
        for at in range(0, len(j), PARTNERS):
            some = j[at:at + PARTNERS]
            some = some[parent[of[some]] != parent[of[i]]]
            if not len(some):
                continue
            for k in some[reaches(items[i], [items[k] for k in some])].tolist():
                a, b = parent[of[i]], parent[of[k]]
                if a != b:
                    parent[parent == b] = a
                    links.append((min(sids[i], sids[k]), max(sids[i], sids[k])))
    pairs = np.asarray(links, np.int64).reshape(-1, 2)
    return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})


def _keyed(rows: DataFrame, keys: int) -> DataFrame:
    """``rows`` of block, sid, component, members (rows of the block), shingles (of their sets, about), with the ``tiles`` and
    the ``key`` of their block. Blocks of a tile at most share ``keys`` groups."""
    tiles = F.ceil(F.greatest(F.col("members") / TILE, F.col("shingles") / TILE_SHINGLES)).cast("int")
    return rows.withColumn("tiles", tiles).withColumn(
        "key", F.when(F.col("tiles") > 1, F.col("block")).otherwise(F.pmod("block", F.lit(keys))))


def _listed(keyed: DataFrame) -> DataFrame:
    """Rows of ``_keyed`` dealt to groups ``key, x, y``. A set goes once to a group, with the list of its blocks there."""
    mine = F.pmod(F.xxhash64("sid"), F.col("tiles")).cast("int")
    dealt = (keyed.withColumn("mine", mine)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other")))
    return dealt.groupBy("key", "x", "y", "sid").agg(F.first("component").alias("component"), F.first("mine").alias("mine"),
                                                     F.collect_list("block").alias("blocks"))


def _search(rows: DataFrame, points: DataFrame, keys: int) -> tuple[DataFrame, DataFrame]:
    """Pairs ``u, v`` that the trees let through, perhaps repeated, and the blocks (``block``) of groups in which they
    let through more pairs than rows: of those no pairs are told. ``rows`` as in ``_keyed``."""
    keyed = _keyed(rows, keys)
    listed = _listed(keyed).join(points.select("sid", "n", "counts"), "sid")
    found = settled(listed.groupBy("key", "x", "y").applyInPandas(few_candidates, "key long, x int, y int, u long, v long"))
    dense = found.filter("u IS NULL").select("key").distinct()
    crowded = keyed.join(F.broadcast(dense), "key", "left_semi") if dense.take(1) else keyed.limit(0)
    return found.filter("u IS NOT NULL").select("u", "v"), crowded.select("block").distinct()


def _joined(rows: DataFrame, points: DataFrame, docs: DataFrame, keys: int) -> DataFrame:
    """Links ``u, v`` that join all that the links of the blocks join, found where the sets lie: ``rows`` as in ``_keyed``."""
    listed = settled(_listed(_keyed(rows, keys)))
    made = _sets(listed.select("sid").distinct(), docs, points).withColumnRenamed("want", "sid").dropDuplicates(["sid"])
    return settled(listed.join(made, "sid").groupBy("key", "x", "y").applyInPandas(joining_links, "u long, v long").distinct())


def _gathered(crowd: DataFrame, hubs: DataFrame) -> DataFrame:
    """The rows of ``crowd`` (block, sid, size, component), those of blocks around the same point (``hubs``: block, l; or else
    the block's first one) as one block, named by the point, where that has no more pairs than the blocks apart. Pairs
    of it that have no block in common are compared as well, none is lost."""
    named = (crowd.groupBy("block").agg(F.min("sid").alias("_least"), F.count(F.lit(1)).cast("double").alias("_n"))
             .join(hubs.select("block", F.col("l.sid").alias("hub")), "block", "left")
             .select("block", "_n", F.coalesce("hub", "_least").alias("hub")))
    around = settled(crowd.join(named, "block"))
    gathered = around.drop("block", "_n").dropDuplicates(["hub", "sid"])
    apart = around.select("hub", "block", "_n").distinct().groupBy("hub").agg(F.sum(F.col("_n") * F.col("_n")).alias("_apart"))
    fewer = (gathered.groupBy("hub").agg(F.count(F.lit(1)).cast("double").alias("_together")).join(apart, "hub")
             .filter(F.col("_together") * F.col("_together") <= F.col("_apart")).select("hub"))
    rest = around.join(fewer, "hub", "left_anti").select("block", "sid", "size", "component")
    return settled(rest.unionByName(gathered.join(fewer, "hub", "left_semi")
                                    .select(F.col("hub").alias("block"), "sid", "size", "component")))


def _open(placed: DataFrame) -> DataFrame:
    """Blocks of more than one component with their rows, ``members``, and about the ``shingles`` of their sets."""
    found = placed.groupBy("block").agg(
        F.min("component").alias("_a"), F.max("component").alias("_b"), F.count(F.lit(1)).alias("members"),
        F.sum(F.exp((F.col("size") + 1) / SIZE_STEPS)).alias("shingles"),
        F.bit_xor(F.xxhash64("sid")).alias("_f"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("_g")).filter("_a <> _b")
    # Of large blocks with the same members one is searched.
    return settled(found.groupBy("members", F.when(F.col("members") <= LEAF, F.col("block")).alias("_h"), "_f", "_g")
                   .agg(F.min("block").alias("block"), F.min_by("shingles", "block").alias("shingles"))
                   .select("block", "members", "shingles"))


def _keys(open_blocks: DataFrame) -> int:
    """Groups that the blocks of a tile at most are dealt to."""
    members, shingles = open_blocks.agg(*[F.coalesce(F.sum(c).cast("long"), F.lit(0)) for c in ("members", "shingles")]).first()
    return max(members // (16 * TILE), shingles // (2 * TILE_SHINGLES)) + 1


def _placed(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The rows with the component of their set."""
    group = components(links).withColumnRenamed("node", "sid")
    return settled(rows.join(group, "sid", "left").withColumn("component", F.coalesce("component", "sid")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` (doc_id, text).

    Words are runs of characters other than space, tab and line breaks, A-Z read as a-z; a set has the distinct
    runs of WORDS words, or, of fewer words, all of them as one. Sets link from the threshold on, and a component
    is named by its smallest doc_id. A null or empty text has an empty set, linked with nothing: its component is
    its own id. A row with a null doc_id links with nothing and has a null component. Rows with equal ids are
    taken one by one. Other columns are not read.
    """
    # Every step with Python is written before this returns.
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs)


def _near_duplicates(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = settled(_described(rows))
    texts = described.filter("kind = 0").drop("kind")
    linked = rows.filter("doc_id IS NOT NULL")
    points = settled(texts.filter("sid IS NOT NULL AND doc_id IS NOT NULL").groupBy("sid").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("counts").alias("counts"), F.first("coarse").alias("coarse")))
    known = (described.filter("kind = 1").groupBy("sid").agg(F.sum("n").alias("n"))
             .orderBy(F.desc("n"), "sid").limit(FREQUENT_KNOWN).collect())
    # The most frequent come last in the order of shingles.
    frequent = np.asarray([r["sid"] for r in reversed(known)], np.int64).astype(np.uint64)
    shingles = points.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = settled(_signatures(linked, frequent, max(1, shingles // (4 * BUCKET_ROWS) + 1)).distinct())

    # Only pairs with a leader whose size may fit.
    leaders = blocks.groupBy("block").agg(F.min(F.struct("sid", "size")).alias("l1"),
                                          F.min_by(F.struct("sid", "size"), F.xxhash64("sid")).alias("l2"))
    stars = (blocks.join(leaders, "block").select(F.col("sid").alias("u"), "size", F.explode(F.array("l1", "l2")).alias("l"))
             .filter(F.col("u") != F.col("l.sid")).filter(F.abs(F.col("size") - F.col("l.size")) <= SIZE_REACH)
             .select("u", F.col("l.sid").alias("v")).distinct())
    first = settled(_verified(settled(_allowed(stars, points)), linked, points))
    placed = _placed(blocks, first)
    open_blocks = _open(placed)
    keys = _keys(open_blocks)
    left = placed.join(open_blocks, "block")
    small = _allowed(_leaf_pairs(left.filter(F.col("members") <= LEAF), keys), points)
    left = left.filter(F.col("members") > LEAF)
    large, crowded = _search(left, points, keys)
    second = _verified(settled(small.unionByName(large).distinct()), linked, points)
    crowd = settled(left.join(crowded, "block", "left_semi").select("block", "sid", "size", "component"))
    if crowd.take(1):
        # A large group may gather around a point that is no leader: the one most leaders are linked with.
        known = first.groupBy(F.col("u").alias("sid")).agg(F.count(F.lit(1)).alias("_links"))
        hubs = settled(crowd.join(known, "sid").groupBy("block").agg(F.max(F.struct("_links", "sid", "size", "component")).alias("l")))
        stars = (crowd.join(hubs, "block").filter(F.col("component") != F.col("l.component"))
                 .filter(F.abs(F.col("size") - F.col("l.size")) <= SIZE_REACH)
                 .select(F.col("sid").alias("u"), F.col("l.sid").alias("v")).distinct())
        first = settled(first.unionByName(_verified(settled(_allowed(stars, points)), linked, points)))
        # Blocks around one point mostly hold the same sets.
        crowd = _placed(_gathered(crowd, hubs).drop("component"), first)
        open_blocks = _open(crowd)
        second = second.unionByName(_joined(crowd.join(open_blocks, "block"), points, linked, _keys(open_blocks)))
    links = settled(first.unionByName(second).distinct())
    group = settled(components(links))

    named = (points.select("sid", "doc_id").join(group.withColumnRenamed("node", "sid"), "sid", "left")
             .withColumn("component", F.coalesce("component", "sid")))
    names = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = named.join(names, "component").select("sid", "component_id")
    return (texts.join(by_set, "sid", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))


@query("op9_ngram_jaccard")
def op9_ngram_jaccard(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
