"""Passages of test sets in training texts, found with a distributed positional inverted index.

Training texts are laid end to end in shards of bounded size, and a shard stores for each term the
positions at which it occurs. Between two texts lies a gap no phrase or distance can bridge. A shard is
one row of a table in the shared folder, so a lost task reads it again.

A phrase is looked up in a shard from its rarest term: the positions of that term, less its offset in
the phrase, are the possible starts; the lists of the other terms, each shifted by its own offset, are
intersected with them, rarest first, until none is left or all terms have agreed. Proximity starts from
the rarest term in the same way and looks for the nearest position of the others.

Test sets are cut into blocks of bounded size and every block is put to all shards, one block after the
other, so neither side has to fit into memory as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightwatch.llm.registry import query
from flightwatch.llm.tables import arrow_schema, settled, slices, table

WINDOW = 13
#: Bytes of text in a shard.
SHARD_BYTES = 2 << 20
#: Words of test sets that are broadcast at a time.
BLOCK_WORDS = 1 << 16
#: Words of a test text in one piece; longer texts are cut with an overlap of a window less one word.
PIECE_WORDS = 1 << 14
GAP = 1 << 12

# Words are runs of 0-9, A-Z, a-z and every character beyond ASCII, A-Z read as a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def _runs(batches) -> Iterator[tuple[list, list]]:
    """Ids and texts of runs of rows with at most about SHARD_BYTES of text; a longer text is alone."""
    ids, texts, size = [], [], 0
    for some_ids, some_texts in slices(batches, "doc_id", "text"):
        for i, text in zip(some_ids, some_texts, strict=True):
            n = len(text) if text else 0
            if ids and size + n > SHARD_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(text)
            size += n
    if ids:
        yield ids, texts


def build_index(docs: DataFrame, vocabulary: set[bytes] | None = None) -> DataFrame:
    """One row per shard: ``doc_ids`` and ``n_words`` of its texts, their first positions ``starts``, the
    ``terms`` and, for each, its ascending ``positions`` (packed 32-bit). ``vocabulary`` limits the index
    to terms that can be asked for; None stores all.
    """
    kept = vocabulary

    def shard(doc_ids: list, texts: list) -> dict:
        # Equal words get equal numbers in order of first appearance.
        number: dict[bytes, int] = {}
        if kept is not None:
            number = dict(zip(kept, range(len(kept)), strict=True))
        starts, n_words, ids, at = [], [], [], []
        place = GAP
        for text in texts:
            got = words(text)
            starts.append(place)
            n_words.append(len(got))
            if kept is None:
                found = np.fromiter((number.setdefault(w, len(number)) for w in got), np.int32, len(got))
            else:
                found = np.fromiter((number.get(w, -1) for w in got), np.int32, len(got))
            here = np.flatnonzero(found >= 0)
            ids.append(found[here])
            at.append(here + place)
            place += len(got) + GAP
        term = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        order = np.argsort(term, kind="stable")
        position = np.concatenate(at).astype("<i4")[order]
        present, first = np.unique(term[order], return_index=True)
        names = list(number)
        return {"doc_ids": doc_ids, "n_words": n_words, "starts": starts,
                "end": place, "terms": [names[t] for t in present],
                "positions": [x.tobytes() for x in np.split(position, first[1:])] if len(present) else []}

    ddl = ("doc_ids array<long>, n_words array<long>, starts array<long>, end long, terms array<binary>, "
           "positions array<binary>")
    schema = arrow_schema(ddl)

    def build(batches):
        for doc_ids, texts in _runs(batches):
            yield pa.RecordBatch.from_pylist([shard(doc_ids, texts)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(build, ddl)


class Shard:
    """A row of the index, ready for look-ups."""

    def __init__(self, row):
        self.doc_ids, self.n_words = row.doc_ids, np.asarray(row.n_words, np.int64)
        self.starts, self.end = np.asarray(row.starts, np.int64), int(row.end)
        self.lists = {t: np.frombuffer(p, "<i4") for t, p in zip(row.terms, row.positions, strict=True)}

    def phrase(self, terms: tuple[bytes, ...]) -> np.ndarray:
        """Positions at which the terms stand one after the other."""
        lists = []
        for offset, term in enumerate(terms):
            found = self.lists.get(term)
            if found is None:
                return np.zeros(0, np.int64)
            lists.append((len(found), offset, found))
        lists.sort(key=lambda x: x[:2])
        _, offset, rarest = lists[0]
        starts = rarest.astype(np.int64) - offset
        for _, offset, found in lists[1:]:
            want = starts + offset
            at = np.searchsorted(found, want)
            at[at == len(found)] = 0
            starts = starts[found[at] == want]
            if not len(starts):
                break
        return starts

    def near(self, terms: tuple[bytes, ...], within: int) -> np.ndarray:
        """Positions of the rarest term that have every other term at most ``within`` words away."""
        lists = sorted((self.lists.get(t, np.zeros(0, np.int32)) for t in dict.fromkeys(terms)), key=len)
        anchors = lists[0].astype(np.int64)
        for found in lists[1:]:
            if not len(found) or not len(anchors):
                return anchors[:0]
            right = np.searchsorted(found, anchors)
            after = np.abs(found[np.minimum(right, len(found) - 1)] - anchors)
            before = np.abs(found[np.maximum(right - 1, 0)] - anchors)
            anchors = anchors[np.minimum(after, before) <= within]
        return anchors

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1


def phrase_matches(index: DataFrame, phrases: list[str]) -> DataFrame:
    """Exact matches of a bounded list of phrases: ``doc_id, phrase (its number), start (word)``."""
    asked = [tuple(words(p)) for p in phrases]

    def look(batches):
        for batch in batches:
            for row in batch.itertuples():
                shard = Shard(row)
                for k, terms in enumerate(asked):
                    if terms and len(at := shard.phrase(terms)):
                        doc = shard.document(at)
                        yield pd.DataFrame({"doc_id": pd.array([shard.doc_ids[d] for d in doc], "Int64"), "phrase": k,
                                            "start": at - shard.starts[doc]})

    return index.mapInPandas(look, "doc_id long, phrase int, start long")


def proximity_matches(index: DataFrame, asked: list[str], within: int = 8) -> DataFrame:
    """For each text of words: places of its rarest word with all its other words at most ``within`` words
    away, in any order. ``doc_id, query (its number), position (word)``; ``within`` is below the gap."""
    if not 0 < within < GAP:
        raise ValueError(f"within must be between 1 and {GAP - 1}")
    terms = [tuple(words(q)) for q in asked]

    def look(batches):
        for batch in batches:
            for row in batch.itertuples():
                shard = Shard(row)
                for k, t in enumerate(terms):
                    if t and len(at := shard.near(t, within)):
                        doc = shard.document(at)
                        yield pd.DataFrame({"doc_id": pd.array([shard.doc_ids[d] for d in doc], "Int64"), "query": k,
                                            "position": at - shard.starts[doc]})

    return index.mapInPandas(look, "doc_id long, query int, position long")


def item_pieces(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, text, n`` of pieces of the test texts' words; ``block`` numbers bounded runs of them."""
    def cut(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.item_id, batch.text, strict=True):
                got = words(text)
                step = PIECE_WORDS - window + 1
                for at in range(0, max(1, len(got) - window + 1), step):
                    if part := got[at:at + PIECE_WORDS]:
                        rows.append((item, b" ".join(part), len(part)))
            yield pd.DataFrame(rows, columns=["item_id", "words", "n"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).filter(
        "item_id IS NOT NULL").mapInPandas(cut, "item_id long, words binary, n long")


def _blocks(pieces: DataFrame):
    """The pieces in runs of at most about BLOCK_WORDS words, one run at a time on the driver."""
    from flightwatch.llm.sharding import with_prefix_sums
    order = ["item_id", "words"]
    ordered = settled(pieces.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    if not ordered.take(1):
        return
    placed = settled(with_prefix_sums(ordered, "n", order).select(
        "item_id", "words", F.floor(F.col("start") / BLOCK_WORDS).cast("long").alias("block")))
    for block in range(placed.agg(F.max("block")).first()[0] + 1):
        yield placed.filter(F.col("block") == block).select("item_id", "words").collect()


def _windows(pieces, window: int) -> dict[tuple[bytes, ...], list[int]]:
    """The windows of a block and the items that have them."""
    out: dict[tuple[bytes, ...], set[int]] = {}
    for piece in pieces:
        got = bytes(piece["words"]).split(b" ")
        for at in range(max(1, len(got) - window + 1)):
            out.setdefault(tuple(got[at:at + window]), set()).add(piece["item_id"])
    return {k: sorted(v) for k, v in out.items()}


def runs_of(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches [begin, end) in order, those that overlap or touch as one: memory goes with the stretches, not
    with the positions they lie among."""
    by = np.argsort(begins, kind="stable")
    begins, until = begins[by], np.maximum.accumulate(ends[by])
    apart = begins[1:] > until[:-1]
    edge = np.ones(min(1, len(begins)), bool)
    return begins[np.concatenate([edge, apart])], until[np.concatenate([apart, edge])]


def _hits(index: DataFrame, asked: dict[tuple[bytes, ...], list[int]], part: int) -> DataFrame:
    """For each document of each shard: runs of hit words and the items found, for one block of windows."""
    ddl = ("shard long, nth int, part int, doc_id long, n_words long, runs array<struct<b:long,e:long>>, items array<long>")
    schema = arrow_schema(ddl)

    def look(batches):
        names: dict[bytes, int] = {}
        by_length: dict[int, list[tuple[bytes, ...]]] = {}
        for w in asked:
            by_length.setdefault(len(w), []).append(w)
            for t in w:
                names.setdefault(t, len(names))
        tables = [(n, ws, np.asarray([[names[t] for t in w] for w in ws])) for n, ws in by_length.items()]
        for batch in batches:
            for at in range(batch.num_rows):  # a row is a whole shard
                row = SimpleNamespace(**{k: v[0] for k, v in batch.slice(at, 1).to_pydict().items()})
                shard = Shard(row)
                there = np.zeros(len(names), bool)
                there[[names[t] for t in shard.lists if t in names]] = True
                found, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                items: dict[int, set[int]] = {}
                for n, ws, terms in tables:
                    for k in np.flatnonzero(there[terms].all(axis=1)):  # all its terms occur somewhere in the shard
                        starts = shard.phrase(ws[k])
                        if len(starts):
                            found.append(starts)
                            lengths.append(np.full(len(starts), n))
                            for d in np.unique(shard.document(starts)):
                                items.setdefault(int(d), set()).update(asked[ws[k]])
                starts = np.concatenate(found)
                begins, ends = runs_of(starts, starts + np.concatenate(lengths))
                owner = shard.document(begins)
                runs: dict[int, list[tuple[int, int]]] = {}
                for d, b, e in zip(owner, begins - shard.starts[owner], ends - shard.starts[owner], strict=True):
                    runs.setdefault(int(d), []).append((int(b), int(e)))
                n = len(shard.doc_ids)
                cols = [[row.shard] * n, list(range(n)), [part] * n, shard.doc_ids, shard.n_words.tolist(),
                        [[{"b": b, "e": e} for b, e in runs.get(d, [])] for d in range(n)],
                        [sorted(items.get(d, ())) for d in range(n)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    return index.mapInArrow(look, ddl)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """For every row of ``docs``: words, words inside any occurrence of a window of ``benchmark``, items with
    such windows, and ``contaminated``: hits are at least one word in ``share``.

    Returns ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, runs, items``; ``runs`` are
    the hit words as [b, e). Null and empty texts have no words and are clean; items that are null or
    without words ask nothing, item ids that are null are left out. Repeated rows are answered one by one,
    repeated items count once per id. Empty tables work; other columns are not read.
    """
    blocks = _blocks(item_pieces(benchmark, window))
    first = next(blocks, [])
    asked = _windows(first, window)
    second = next(blocks, None)
    # With a single block, only the terms it asks for need to be stored.
    vocabulary = {t for w in asked for t in w} if second is None else None
    index = settled(build_index(docs, vocabulary).withColumn("shard", F.monotonically_increasing_id()))
    found = _hits(index, asked, 0)
    if second is None:
        return _report(found, share)
    parts = [settled(found)]
    while second is not None:
        parts.append(settled(_hits(index, _windows(second, window), len(parts))))
        second = next(blocks, None)
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    # A document has one row per block; blocks are few, its runs no more than its words.
    merged = every.groupBy("shard", "nth").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    union = """aggregate(runs, named_struct('n', 0L, 'to', 0L), (a, r) -> named_struct(
        'n', a.n + greatest(0L, r.e - greatest(r.b, a.to)), 'to', greatest(a.to, r.e)), a -> a.n)"""
    return _report(merged, share, F.expr(union))


def _report(found: DataFrame, share: int, n_hit=None) -> DataFrame:
    if n_hit is None:
        n_hit = F.expr("aggregate(runs, 0L, (n, r) -> n + r.e - r.b)")
    as_text = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return (found.withColumn("n_hit", n_hit)
            .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(as_text, 256).alias("items_sha256"),
                    ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
                    "runs", "items"))


_FOLDED = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
           "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")


def contamination_ctes(docs: str = "documents") -> str:
    """SQL of ``contamination`` for a table named ``docs``: ends in a table ``verdict``."""
    return f"""
item_words AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, i, i + least(len(w), 13) - 1) AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (SELECT doc_id, {_FOLDED} AS w FROM {docs}),
grams AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM doc_words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
matches AS (SELECT doc_id, item_id, i, n FROM grams JOIN windows USING (n, gram)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc_id, i, n FROM matches)) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM matches) GROUP BY doc_id),
verdict AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
         CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
         coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
  FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN hit_items USING (doc_id))"""


@query("op1_decontamination", f"WITH {contamination_ctes()} SELECT * FROM verdict")
def op1_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("runs", "items")
