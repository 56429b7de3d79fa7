"""A Merkle manifest of a dataset: one root digest that vouches for every row, and a proof for each.

Rows become leaves, leaves of one language a tree of ``FANOUT`` children per node, the languages' subroots the
top tree. What is stored are records from a digest to the digests of its children, level by level: content
addresses everything, equal nodes are one record.

Proofs come from descending. A request is a leaf's rank in its tree; its digits in base ``FANOUT``, highest
first, say which child to take at every record on the way from the root. The children not taken are collected
as one segment of the path, and the segments, reversed, are the proof from leaf to root. Requests that share
the first digits share one row on the way, so a node is opened once however many leaves are asked for.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightwatch.llm.ranges import running
from flightwatch.llm.registry import query
from flightwatch.llm.tables import settled, table

FANOUT = 8
#: The tree of subroots has this number; trees of languages are numbered by the rank of their first leaf.
TOP = -1
_PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts; digests go in as hex text."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value, so that fields cannot run into each other."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def _height(leaves: Column, fanout: int) -> Column:
    """Levels above the leaves until one node is left."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.pow(F.lit(float(fanout)), k) < leaves))


@dataclass(frozen=True)
class Manifest:
    """``leaves``: the given columns with ``tree``, ``rank``. ``trees``: ``tree, n, height, subroot, place`` per
    language, ``place`` being its rank among the subroots. ``store``: per level above the leaves, records
    ``digest, children``. ``root``: ``root, height`` of the top tree, one row (none for an empty table)."""
    leaves: DataFrame
    trees: DataFrame
    store: list[DataFrame]
    top_store: list[DataFrame]
    root: DataFrame
    fanout: int


def _grow(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Records of each level over ``tree, rank, height, digest``, and ``tree, subroot`` of all trees."""
    highest = nodes.agg(F.max("height")).first()[0] or 0
    store, tops = [], nodes.filter("height = 0").select("tree", F.col("digest").alias("subroot"))
    for level in range(1, highest + 1):
        nodes = settled(
            nodes.filter(F.col("height") >= level)
            .groupBy("tree", "height", F.expr(f"rank div {fanout}").alias("rank"))
            .agg(F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("_run"))
            .select("tree", "height", "rank", F.col("_run.digest").alias("children"))
            .withColumn("digest", digest(F.concat_ws("", "children"))))
        store.append(nodes.groupBy("digest").agg(F.first("children").alias("children")))
        tops = tops.unionByName(nodes.filter(F.col("height") == level).select("tree", F.col("digest").alias("subroot")))
    return store, tops


def build(leaves: DataFrame, fanout: int = FANOUT) -> Manifest:
    """The manifest over ``lang, doc_id, leaf`` and any further columns, which stay with the leaves.

    Trees are in order of ``lang`` (null first, then by UTF-8 bytes), leaves in a tree ascend by ``doc_id`` (null
    first), rows of one id by their digest; rows equal in all three are interchangeable, each is a leaf of its
    own. A tree of one leaf has that leaf as its subroot, and a single language's subroot is the root. No
    language passes through one task: ranks come from sums over ranges of rows. ``leaves`` is read twice.
    """
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    ordered = running(leaves, [F.col("lang"), F.col("doc_id"), F.col("leaf")])
    runs = settled(ordered.groupBy("part", "lang").agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("n")))
    # A join per (part of the range exchange, language): a language of a third of all rows is as many keys as parts.
    whole = runs.groupBy("lang").agg(F.min("first").alias("tree"), F.sum("n").alias("n")).withColumnRenamed("lang", "_lang")
    heads = (runs.join(whole, F.col("lang").eqNullSafe(F.col("_lang")))
             .select(F.col("part").alias("_part"), "_lang", "tree", _height(whole["n"], fanout).alias("height")))
    placed = settled(
        ordered.join(heads, (F.col("part") == F.col("_part")) & F.col("lang").eqNullSafe(F.col("_lang")))
        .withColumn("rank", F.col("nth") - F.col("tree")).drop("_part", "_lang", "part", "nth"))
    store, subroots = _grow(placed.select("tree", "rank", "height", F.col("leaf").alias("digest")), fanout)
    # One row per language from here to the root.
    trees = settled(whole.select("tree", "n", _height(F.col("n"), fanout).alias("height")).join(subroots, "tree")
                    .withColumn("place", F.row_number().over(Window.orderBy("tree")).cast("long") - 1))
    count = trees.count()
    top = trees.select(F.lit(TOP).cast("long").alias("tree"), F.col("place").alias("rank"),
                       _height(F.lit(count), fanout).alias("height"), F.col("subroot").alias("digest"))
    top_store, roots = _grow(top, fanout)
    root = settled(roots.select(F.col("subroot").alias("root"), _height(F.lit(count), fanout).alias("height")))
    return Manifest(placed, trees, store, top_store, root, fanout)


def _segment(children: Column, digit: Column) -> Column:
    """The children not taken, to the left and to the right of the one that is."""
    return F.struct(F.concat_ws("", F.slice(children, 1, digit)).alias("before"),
                    F.concat_ws("", F.slice(children, digit + 2, F.size(children))).alias("after"))


def _descend(store: list[DataFrame], starts: DataFrame, fanout: int, wanted: DataFrame | None) -> DataFrame:
    """The lowest records, ``tree, rank, path, children``, reached from ``starts`` (``tree, height, digest, path``),
    with the further columns of ``starts``.

    ``path`` holds the segments so far, from the root down. A tree that is a single leaf opens no record: its
    ``children`` are null. ``wanted`` (``tree, rank`` of leaves) keeps only what leads to them.
    """
    root = F.lit(0).cast("long").alias("rank")
    further = [c for c in starts.columns if c not in ("tree", "height", "digest", "path")]
    ends = starts.filter("height = 0").select("tree", root, "path", F.lit(None).cast("array<string>").alias("children"), *further)
    at = None
    for level in range(len(store), 0, -1):
        here = starts.filter(F.col("height") == level).select("tree", root, "digest", "path", *further)
        here = here if at is None else here.unionByName(at)
        if wanted is not None:
            ways = wanted.select("tree", F.expr(f"rank div {fanout ** level}L").alias("rank")).distinct()
            here = here.join(ways, ["tree", "rank"], "left_semi")
        opened = here.join(store[level - 1], "digest")
        if level == 1:
            return ends.unionByName(opened.drop("digest"))
        at = (opened.drop("digest").select("*", F.posexplode("children").alias("_digit", "digest"))
              .select("tree", (F.col("rank") * fanout + F.col("_digit")).alias("rank"), "digest",
                      F.concat("path", F.array(_segment(F.col("children"), F.col("_digit")))).alias("path"), *further))
    return ends


def _ways(requests: DataFrame, records: DataFrame, fanout: int) -> DataFrame:
    """``requests`` (``tree, rank`` and more) with the ``path`` down to them and the further columns of ``records``."""
    below = records.withColumnsRenamed({"tree": "_tree", "rank": "_rank"})
    digit = F.pmod("rank", F.lit(fanout)).cast("int")
    last = F.when(F.col("children").isNull(), F.col("path")).otherwise(
        F.concat("path", F.array(_segment(F.col("children"), digit))))
    return (requests.join(below, (F.col("tree") == F.col("_tree")) & (F.expr(f"rank div {fanout}") == F.col("_rank")))
            .withColumn("path", last).drop("_tree", "_rank", "children"))


def proofs(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """The requested rows of ``manifest.leaves`` (all, if not given) with ``subroot``, ``root`` and ``path``: an array
    of ``before, after`` from the leaf up, the hex digests to the left and right of the node on its level.

    A request is one row per (``tree``, ``rank``); the result has its columns and as many rows. Only records on
    the way to a requested leaf are opened.
    """
    fanout = manifest.fanout
    root = manifest.root.select(F.lit(TOP).cast("long").alias("tree"), "height", F.col("root").alias("digest"),
                                F.array().cast(_PATH).alias("path"), "root")
    trees = manifest.trees
    if requests is not None:
        trees = trees.join(requests.select("tree").distinct(), "tree", "left_semi")
    tops = trees.select(F.lit(TOP).cast("long").alias("tree"), F.col("place").alias("rank"),
                        F.col("tree").alias("_language"), F.col("height").alias("_height"), "subroot")
    reached = _ways(tops, _descend(manifest.top_store, root, fanout, None if requests is None else tops), fanout)
    starts = settled(reached.select(F.col("_language").alias("tree"), F.col("_height").alias("height"),
                                    F.col("subroot").alias("digest"), "path", "subroot", "root"))
    asked = (manifest.leaves if requests is None else requests).drop("height")
    found = _ways(asked, _descend(manifest.store, starts, fanout, requests), fanout)
    return found.withColumn("path", F.reverse("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to; a row is genuine if it is the manifest's."""
    return F.aggregate(path, leaf, lambda node, side: digest(side["before"], node, side["after"]))


def path_digest(path: Column) -> Column:
    """One digest over all siblings, from the leaf up, left to right."""
    return digest(F.concat_ws("", F.transform(path, lambda side: F.concat(side["before"], side["after"]))))


def document_leaves(docs: DataFrame) -> DataFrame:
    """``lang, doc_id, leaf`` of each row and ``tampered``: its leaf after an attack on the rows whose
    ``crc32(doc_id as text)`` is divisible by 3, which lower-cases the text's A-Z (null ids are left alone)."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = leaf_of(*columns, F.col("text"))
    return docs.select("lang", "doc_id", leaf.alias("leaf"), F.when(hit, leaf_of(*columns, lowered)).otherwise(leaf).alias("tampered"))


def verified(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of each row of ``docs`` with the columns
    ``doc_id, source, lang, n_chars, text``: the manifest's proof, folded with the row after the attack.

    Nulls in any column are values of their own, empty texts differ from them; repeated rows are leaves each; other
    columns are not read; an empty table gives no rows. Texts are hashed once and never moved.
    """
    made = build(settled(document_leaves(docs)), fanout)
    out = proofs(made).withColumn("folded_root", folded(F.col("tampered"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


def _oracle(levels: int = 7) -> str:
    """Tree and proofs level by level, each node with its place; trees stop where one node is left."""
    def enc(c):
        return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"

    def up(name, n):
        return [f"""
{name}{k + 1} AS (
  SELECT tree, spot // 8 AS pos, CASE WHEN m = 1 THEN min(dig) ELSE sha256(string_agg(dig, '' ORDER BY spot)) END AS dig
  FROM (SELECT tree, pos AS spot, dig, count(*) OVER (PARTITION BY tree) AS m FROM {name}{k}) GROUP BY tree, m, spot // 8)"""
                for k in range(n)]

    def walk(name, n):
        return [f"""
{name}w{k + 1} AS (
  SELECT w.who, w.tree, w.pos // 8 AS pos,
         CASE WHEN s.m = 1 THEN w.bad ELSE sha256(coalesce(s.l, '') || w.bad || coalesce(s.r, '')) END AS bad,
         w.proof || CASE WHEN s.m = 1 THEN '' ELSE coalesce(s.l, '') || coalesce(s.r, '') END AS proof
  FROM {name}w{k} w JOIN (
    SELECT tree, pos, count(*) OVER (PARTITION BY tree) AS m,
           string_agg(dig, '') OVER (PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
           string_agg(dig, '') OVER (PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r
    FROM {name}{k}) s ON s.tree = w.tree AND s.pos = w.pos)"""
                for k in range(n)]

    plain = [enc(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    crc = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(strlen(CAST(doc_id AS VARCHAR))),
    lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i::INT + 1, 1)) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""
    parts = [f"""
base AS (SELECT lang, doc_id, sha256({' || '.join([*plain, enc('text')])}) AS leaf,
         CASE WHEN ({crc}) % 3 = 0 THEN sha256({' || '.join([*plain, enc(lowered)])}) END AS other FROM documents),
n0 AS (SELECT dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
       leaf AS dig, doc_id, coalesce(other, leaf) AS bad, row_number() OVER () AS who FROM base)"""]
    parts += up("n", levels)
    parts.append(f"\nr0 AS (SELECT 0 AS tree, tree AS pos, dig FROM n{levels})")
    parts += up("r", 2)
    parts.append("\nnw0 AS (SELECT who, tree, pos, bad, '' AS proof FROM n0)")
    parts += walk("n", levels)
    parts.append(f"\nrw0 AS (SELECT who, 0 AS tree, tree AS pos, bad, proof FROM nw{levels})")
    parts += walk("r", 2)
    return f"""WITH {','.join(parts)}
SELECT n0.doc_id, n0.dig AS leaf, sub.dig AS subroot, top.dig AS root, sha256(w.proof) AS proof_sha256,
       w.bad AS folded_root, w.bad = top.dig AS verified
FROM n0 JOIN rw2 w USING (who) JOIN n{levels} sub ON sub.tree = n0.tree CROSS JOIN (SELECT dig FROM r2) top"""


@query("op13_manifest", _oracle())
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(table(spark, sf_dir, "documents"))
