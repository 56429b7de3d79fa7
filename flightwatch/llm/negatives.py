"""Hard negatives by angular triangle filtering.

Every row stores its norm and its angles to some reference directions. By the triangle inequality on the sphere
the angle between an anchor and a row lies between |a - b| and min(a + b, 2 pi - a - b) for each reference, so
its cosine lies in an interval; times the norms, widened by more than rounding can do, that bounds the integer
score. A row is scored exactly only where its bounds overlap what the anchor still looks for: a score that may
be among its best positives, or one inside the window of one of its positives.

Rows are put in order of label, nearest reference and angle and packed into shards of bounded size; anchors
into blocks. The same bounds, taken over the ranges of angles of a shard and a block, decide which shards a
block visits at all. Any directions give the same result, better ones score less.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightwatch.llm.registry import query
from flightwatch.llm.tables import settled, table

SCALE = 256
#: Reference directions are rows that lie far from each other, picked among at most so many sampled ones.
REFERENCES = 16
SAMPLED = 2048
SHARD_ROWS = 4096
BLOCK_ROWS = 1024
#: Rows of a block that are bounded at once.
TILE = 128
SLACK = 8
_PACKED = ("dim int, rows int, kind string, ids binary, labels binary, points binary, norms binary, angles binary, aims array<array<bigint>>, "
           "label_min long, label_max long, norm_max double, angle_min array<double>, angle_max array<double>")
_KINDS = ("int8", "int16", "int32", "float64")


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
              scale: int = SCALE) -> DataFrame:
    """``vec_id, label, v`` of the rows that take part: an id, a label and a vector without null or non-finite
    components; each component x becomes floor(scale * x), x as double. Zero and empty vectors take part."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                    F.transform(v, lambda x: _floor(scale * x.cast("double"))).alias("v")))


def _floor(x: Column) -> Column:
    """As a double; from 2^52 on a double has no fraction."""
    return F.when(F.abs(x) < float(2 ** 52), F.floor(x).cast("double")).otherwise(x)


def _unit(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and directions (zero rows stay zero)."""
    norms = np.sqrt((points * points).sum(axis=1))
    return norms, points / np.where(norms > 0, norms, 1.0)[:, None]


def directions(rows: DataFrame, references: int = REFERENCES, sampled: int = SAMPLED) -> dict[int, np.ndarray]:
    """Per length of vector, up to ``references`` directions: of ``sampled`` rows at most (the smallest by hash of
    their id) always the one furthest from those picked before."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "v").limit(sampled).select("v").toPandas()["v"]
    out = {}
    for dim in sorted({len(v) for v in sample}):
        units = _unit(np.stack([np.asarray(v, float) for v in sample if len(v) == dim]))[1]
        units = units[(units != 0).any(axis=1)] if dim else units[:0]
        picked, nearest = [], np.full(len(units), -2.0)
        while len(picked) < references and len(units) and (not picked or nearest.min() < 1 - 1e-9):
            picked.append(units[int(nearest.argmin())])
            nearest = np.maximum(nearest, units @ picked[-1])
        if picked:
            out[dim] = np.asarray(picked)
    return out


def slack(dim: int) -> float:
    """More than a difference of angles can be off: rounding of the cosines, magnified by arccos near 0 and pi."""
    return SLACK * np.sqrt((dim + 8) * np.finfo(float).eps)


def score_bounds(norms_a, angles_a, norms_b, angles_b, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest integer score of every row a with every row b, from norms and angles alone."""
    apart = np.zeros((len(norms_a), len(norms_b)))
    most = np.full(apart.shape, np.pi)
    for a, b in zip(angles_a.T, angles_b.T, strict=True):
        np.maximum(apart, np.abs(a[:, None] - b[None, :]), out=apart)
        both = a[:, None] + b[None, :]
        np.minimum(most, np.minimum(both, 2 * np.pi - both), out=most)
    size = norms_a[:, None] * norms_b[None, :]
    off, rounding = slack(dim), 1e-9 * size + 1e-6
    high = np.floor(size * np.cos(np.maximum(apart - off, 0)) + rounding)
    low = np.ceil(size * np.cos(np.minimum(most + off, np.pi)) - rounding)
    return low, high


def scores(points: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows with one vector."""
    bound = float(np.abs(points).max(initial=0)) * float(np.abs(anchor).sum())
    if bound < 2 ** 53:
        return (points.astype(float) @ anchor).astype(np.int64)
    if bound < 2 ** 63:
        return points.astype(np.int64) @ anchor.astype(np.int64)
    raise ValueError("scores do not fit into 64 bits; use a smaller scale")


def _packing(rows: int, references: dict[int, np.ndarray]):
    """Runs of rows of one length, packed with norms, angles and their ranges."""
    def packed(dim, group):
        ids, labels, points, aims = zip(*group, strict=True)
        points = np.asarray(points, float).reshape(len(group), dim)
        norms, units = _unit(points)
        # Angles of a zero vector mean nothing, but then every score is 0 and so are its bounds.
        angles = np.arccos(np.clip(units @ references[dim].T, -1, 1)) if dim in references else np.zeros((len(group), 0))
        kind = next(k for k in _KINDS if k == "float64" or np.abs(points).max(initial=0) <= np.iinfo(k).max)
        return {"dim": dim, "rows": len(group), "kind": kind, "ids": np.asarray(ids, np.int64).tobytes(),
                "labels": np.asarray(labels, np.int64).tobytes(), "points": points.astype(kind).tobytes(),
                "norms": norms.tobytes(), "angles": angles.tobytes(), "aims": [list(x) for x in aims],
                "label_min": min(labels), "label_max": max(labels), "norm_max": norms.max(),
                "angle_min": angles.min(axis=0).tolist(), "angle_max": angles.max(axis=0).tolist()}

    def pack(batches):
        open_runs: dict[int, list] = {}
        for batch in batches:
            for row in zip(batch["vec_id"], batch["label"], batch["v"], batch["aims"], strict=True):
                group = open_runs.setdefault(len(row[2]), [])
                group.append(row)
                if len(group) == rows:
                    yield pd.DataFrame([packed(len(row[2]), open_runs.pop(len(row[2])))])
        for dim, group in open_runs.items():
            yield pd.DataFrame([packed(dim, group)])
    return pack


class Run:
    """A packed run of rows, unpacked."""

    def __init__(self, row, prefix: str):
        def get(name, kind=np.float64):
            data = getattr(row, prefix + name)
            return np.frombuffer(data, kind) if data else np.empty(0, kind)
        self.dim, n = getattr(row, prefix + "dim"), getattr(row, prefix + "rows")
        self.ids, self.labels, self.norms = get("ids", np.int64), get("labels", np.int64), get("norms")
        self.points = get("points", getattr(row, prefix + "kind")).reshape(n, self.dim)
        angles = get("angles")
        self.angles = angles.reshape(n, len(angles) // n)


def place(rows: DataFrame, references: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` with their nearest reference, ``cell``, and ``turn``, the cosine to it (negative)."""
    def near(batches):
        for batch in batches:
            cells, turns = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            lengths = batch["v"].map(len).to_numpy()
            for dim in np.unique(lengths):
                if int(dim) in references:
                    at = np.nonzero(lengths == dim)[0]
                    units = _unit(np.stack([np.asarray(v, float) for v in batch["v"].iloc[at]]))[1]
                    cosines = units @ references[int(dim)].T
                    cells[at], turns[at] = cosines.argmax(axis=1), -cosines.max(axis=1)
            yield batch.assign(cell=cells, turn=turns)

    return rows.mapInPandas(near, "vec_id long, label long, v array<double>, cell int, turn double")


def packed(placed: DataFrame, references: dict[int, np.ndarray], size: int) -> DataFrame:
    """Runs of at most ``size`` rows of one vector length, numbered by ``run``.

    Rows go in order of label, cell and turn, so that runs lie close together; equal rows are told apart by id and
    a spread number, so no label or cell has to fit into one partition. ``placed`` is read twice.
    """
    order = ["label", "cell", "turn", "vec_id"]
    return settled(placed.withColumn("_spread", F.pmod(F.monotonically_increasing_id(), F.lit(4096)))
                   .repartitionByRange(*order, "_spread").sortWithinPartitions(*order)
                   .select("vec_id", "label", "v", "aims").mapInPandas(_packing(size, references), _PACKED)
                   .withColumn("run", F.monotonically_increasing_id()))


def _meetings(blocks: DataFrame, shards: DataFrame, same_label: bool, least: Column) -> DataFrame:
    """``block, shard, bound`` where labels fit and by the ranges of angles a score of ``least`` (a column of the blocks;
    null: any) is possible. Runs meet as numbers and ranges, without their rows."""
    ranges = ["dim", "label_min", "label_max", "norm_max", "angle_min", "angle_max"]
    numbered = settled(shards.select(F.col("run").alias("shard"), *[F.col(c).alias(f"s_{c}") for c in ranges])
                       .withColumn("_n", F.row_number().over(Window.orderBy("shard"))))  # one narrow row per run
    count = numbered.count()
    mine = (blocks.select(F.col("run").alias("block"), *ranges, least.alias("least"))
            .withColumn("_m", F.explode(F.sequence(F.lit(1), F.lit(count)) if count else F.array().cast("array<int>"))))
    met = mine.join(numbered, (F.col("_m") == F.col("_n")) & (F.col("dim") == F.col("s_dim")))
    if same_label:
        met = met.filter((F.col("label_min") <= F.col("s_label_max")) & (F.col("s_label_min") <= F.col("label_max")))
    else:
        met = met.filter((F.least("label_min", "s_label_min") != F.greatest("label_max", "s_label_max")))
    gaps = F.zip_with(F.arrays_zip("angle_min", "angle_max"), F.arrays_zip("s_angle_min", "s_angle_max"),
                      lambda a, b: F.greatest(a["angle_min"] - b["s_angle_max"], b["s_angle_min"] - a["angle_max"]))
    off = F.sqrt((F.col("dim") + 8) * float(np.finfo(float).eps)) * SLACK
    gap = F.greatest(F.coalesce(F.array_max(gaps), F.lit(0.0)) - off, F.lit(0.0))
    # A negative cosine says no more than: not above 0.
    bound = F.col("norm_max") * F.col("s_norm_max") * F.greatest(F.cos(gap), F.lit(0.0)) * (1 + 1e-9) + 1
    return (met.withColumn("bound", bound).filter(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
            .select("block", "shard", "bound"))


def _joined(meetings: DataFrame, blocks: DataFrame, shards: DataFrame) -> DataFrame:
    """Both runs of each meeting, dealt evenly to the tasks."""
    few = ["dim", "rows", "kind", "ids", "labels", "points", "norms", "angles", "run"]
    left = blocks.select(*[F.col(c).alias(f"b_{c}") for c in [*few, "aims"]])
    right = shards.select(*[F.col(c).alias(f"s_{c}") for c in few])
    return (meetings.select("block", "shard").join(right, F.col("shard") == F.col("s_run"))
            .join(left, F.col("block") == F.col("b_run")).repartition("block", "shard"))


def _best(wanted: np.ndarray, ids: np.ndarray, got: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    by = np.lexsort((ids[wanted], -got))[:k]
    return ids[wanted[by]], got[by]


def _anchors(batches):
    """Each anchor of a meeting with its bounds: block, shard, the anchor's place, what it looks for, least and most."""
    for batch in batches:
        for r in batch.itertuples():
            block, shard = Run(r, "b_"), Run(r, "s_")
            for at in range(0, len(block.ids), TILE):
                part = slice(at, at + TILE)
                least, most = score_bounds(block.norms[part], block.angles[part], shard.norms, shard.angles, block.dim)
                for i, (low, high) in enumerate(zip(least, most, strict=True), at):
                    yield block, shard, i, r.b_aims[i], low, high


def _find_positives(k: int):
    def find(batches):
        for block, shard, i, floor, _, high in _anchors(batches):
            wanted = (shard.labels == block.labels[i]) & (shard.ids != block.ids[i])
            if len(floor):
                wanted &= high >= float(floor[0])
            wanted = np.nonzero(wanted)[0]
            if len(wanted):
                ids, got = _best(wanted, shard.ids, scores(shard.points[wanted], block.points[i].astype(float)), k)
                yield pd.DataFrame({"anchor_id": block.ids[i], "positive_id": ids, "positive_score": got})
    return find


def _find_negatives(k: int, low: int, high: int):
    def find(batches):
        for block, shard, i, tops, least, most in _anchors(batches):
            overlaps = np.zeros(len(shard.ids), bool)
            for top in tops:
                overlaps |= (100 * most >= low * float(top)) & (100 * least <= high * float(top))
            wanted = np.nonzero(overlaps & (shard.labels != block.labels[i]))[0]
            if not len(wanted):
                continue
            got = scores(shard.points[wanted], block.points[i].astype(float))
            for nth, top in enumerate(map(int, tops), 1):
                inside = (got >= -(-low * top // 100)) & (got <= high * top // 100)
                if inside.any():
                    ids, found = _best(wanted[inside], shard.ids, got[inside], k)
                    yield pd.DataFrame({"anchor_id": block.ids[i], "nth": nth, "negative_id": ids, "negative_score": found})
    return find


def _together(frames):
    """Few large frames instead of many small ones."""
    kept, rows = [], 0
    for frame in frames:
        kept.append(frame)
        rows += len(frame)
        if rows >= 10_000:
            yield pd.concat(kept)
            kept, rows = [], 0
    if kept:
        yield pd.concat(kept)


def _search(meetings: DataFrame, blocks: DataFrame, shards: DataFrame, find, schema: str) -> DataFrame:
    return _joined(meetings, blocks, shards).mapInPandas(lambda batches: _together(find(batches)), schema)


def _aiming(anchors: DataFrame, aims: DataFrame | None) -> DataFrame:
    """Anchors with what they look for (``anchor_id, aims``)."""
    if aims is None:
        return anchors.withColumn("aims", F.array().cast("array<long>"))
    return anchors.join(aims, F.col("vec_id") == F.col("anchor_id"), "left").drop("anchor_id").withColumn(
        "aims", F.coalesce("aims", F.array().cast("array<long>")))


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         references: int = REFERENCES, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``anchors`` against all of
    ``rows`` (both ``vec_id, label, v`` as from ``quantised``; both are read several times).

    A score is the exact integer inner product. An anchor's positives are its ``positives`` best other rows of the
    same label; for each of them come the ``negatives`` best rows of another label whose score is between ``low`` and
    ``high`` percent of the positive's; higher scores first, ties to the smaller id. A row is never its anchor's
    match if it has the anchor's id. An anchor id that repeats is answered once, for its least label and vector;
    a repeated row counts as often as it occurs. Vectors of another length are never compared. An anchor without
    positives or a positive without negatives gives no rows, as do empty tables. Scores beyond 64 bits raise an error.
    """
    if min(positives, negatives, references, shard_rows, block_rows) < 1:
        raise ValueError("counts and sizes must be at least 1")
    turned = directions(rows, references)
    shards = packed(_aiming(settled(place(rows, turned)), None), turned, shard_rows)
    once = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("_x")).select("vec_id", "_x.label", "_x.v")
    placed = settled(place(once, turned))
    unaimed = packed(_aiming(placed, None), turned, block_rows)

    # Positives: first in the likeliest shard of each block, then wherever the k-th best so far may still be beaten.
    found = "anchor_id long, positive_id long, positive_score long"
    met = settled(_meetings(unaimed, shards, True, F.lit(None).cast("double")))
    likeliest = settled(met.groupBy("block").agg(F.max_by("shard", F.struct("bound", -F.col("shard"))).alias("shard")))
    first = settled(_search(likeliest, unaimed, shards, _find_positives(positives), found))
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    floors = (first.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") == positives)
              .select("anchor_id", F.array("positive_score").alias("aims")))
    aimed = packed(_aiming(placed, floors), turned, block_rows)
    floor = F.when(~F.exists("aims", lambda x: F.size(x) == 0), F.array_min(F.transform("aims", lambda x: x[0])))
    chosen = settled(
        _search(_meetings(aimed, shards, True, floor.cast("double")), aimed, shards, _find_positives(positives), found)
        .withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= positives))

    # Negatives: wherever a score may lie inside the window of a positive.
    tops = chosen.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))).alias("_x"))
    tops = tops.select("anchor_id", F.col("_x.positive_score").alias("aims"))
    aimed = packed(_aiming(placed, tops).filter(F.size("aims") > 0), turned, block_rows)
    window = F.array_min(F.transform("aims", lambda x: F.array_min(x))).cast("double")
    window = F.when(window > 0, window * (low / 100) - 1).otherwise(window * (high / 100) - 1)
    near = _search(_meetings(aimed, shards, False, window), aimed, shards, _find_negatives(negatives, low, high),
                   "anchor_id long, nth int, negative_id long, negative_score long")
    by = Window.partitionBy("anchor_id", "nth").orderBy(F.desc("negative_score"), "negative_id")
    return (near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= negatives)
            .join(chosen, ["anchor_id", "nth"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


_ORACLE = """
WITH fine AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS alike,
         CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM fine a JOIN fine r ON a.vec_id <> r.vec_id AND len(a.v) = len(r.v) WHERE a.vec_id % 100 = 0),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positive JOIN scored s USING (anchor_id)
  WHERE NOT s.alike AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 5
"""


@query("op11_hard_negatives", _ORACLE)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    rows = settled(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))
    return mine(rows, rows.filter(F.col("vec_id") % 100 == 0))
