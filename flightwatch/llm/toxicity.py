"""Toxic passages as maximal scoring segments of token log-odds.

Learning counts the labelled toxic and clean texts that have a token and takes its log-odds under an informative
Dirichlet prior, which draws rare tokens to the common distribution. A passage model that mixes in a share
of toxic language turns them into scores of tokens: log-likelihood ratios, negative for ordinary words.
All maximal scoring segments of a text are found in one scan (Ruzzo and Tompa). Scores of this kind have
extremes of Gumbel form with scale 1, so a segment counts by how far it exceeds what a clean text of the
same length would show; what all segments exceed is added up and mapped to a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightwatch.llm.decontamination import words
from flightwatch.llm.registry import query
from flightwatch.llm.tables import arrow_schema, settled, slices, table

#: Bound of the labelled sample (rows by a hash of the id) and of the table of toxic tokens.
SAMPLE_ROWS, TERMS = 20_000, 50_000
#: Weight of the prior as a share of all tokens counted; least z and log-odds of a toxic token.
PRIOR, LEAST_Z, LEAST_DELTA = 0.02, 1.96, 1.5
#: Share of toxic language in a toxic passage.
DENSITY = 0.1
#: Beginnings of words, in bytes, that stand for words not seen often enough.
STEMS = (6, 5, 4)
REMEMBERED = 300_000


def features(word: bytes) -> list[bytes]:
    return [word, *[word[:n] + b"*" for n in STEMS if len(word) > n]]


def segments(scores: list[tuple[int, float]], background: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, ``(begin, end, score)`` with end exclusive, in linear time.

    ``scores`` are the positive tokens' positions and scores; every other token has ``background`` < 0.
    """
    # Candidates: begin, end, total before, total at the end, and the nearest one before that has a lower total before it.
    found: list[tuple[int, int, float, float, int]] = []
    total, after = 0.0, 0
    for at, score in scores:
        total += background * (at - after)
        begin, before, here = at, total, total + score
        total, after = here, at + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= here:
                break
            # The candidate at j and all after it become part of this one.
            begin, before = found[j][0], found[j][2]
            del found[j:]
        found.append((begin, at + 1, before, here, j))
    return [(b, e, right - left) for b, e, left, right, _ in found]


@dataclass
class Model:
    terms: dict[bytes, float]
    background: float
    k: float = 1.0
    slope: float = 0.0
    bias: float = -2.0

    def scorer(self):
        """A function from words to the positive tokens' ``(position, score)``, with a memory of words."""
        known: dict[bytes, float] = {}
        terms = self.terms

        def score(text: list[bytes]) -> list[tuple[int, float]]:
            out = []
            for at, w in enumerate(text):
                s = known.get(w)
                if s is None:
                    s = next((terms[f] for f in features(w) if f in terms), 0.0)
                    if len(known) < REMEMBERED:
                        known[w] = s
                if s > 0:
                    out.append((at, s))
            return out

        return score


def token_log_odds(labelled: DataFrame) -> DataFrame:
    """``term, delta, z`` of every feature in ``labelled`` (text, toxic of 0 or 1)."""
    ddl = "term binary, toxic long, clean long"
    schema = arrow_schema(ddl)

    def count(batches):
        each: tuple[Counter, Counter] = (Counter(), Counter())

        def flush():
            names = list(each[0].keys() | each[1].keys())
            for at in range(0, len(names), 10_000):
                part = names[at:at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([each[1][t] for t in part], pa.int64()),
                                                  pa.array([each[0][t] for t in part], pa.int64())], schema=schema)
            each[0].clear()
            each[1].clear()

        for texts, toxic in slices(batches, "text", "toxic"):
            for text, y in zip(texts, toxic, strict=True):
                # A text counts a token once: one that repeats it a hundred times is one witness.
                each[y].update({f for w in set(words(text)) for f in features(w)})
            if len(each[0]) + len(each[1]) > 500_000:
                yield from flush()
        yield from flush()

    # Totals count whole words: features of one word stand beside each other, not together.
    counts = settled(labelled.select("text", "toxic").mapInArrow(count, ddl).groupBy("term")
                     .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    whole = counts.filter(F.substring("term", -1, 1) != F.lit(b"*")).agg(
        F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0))).first()
    n_toxic, n_clean = whole[0], whole[1]
    weight = PRIOR * (n_toxic + n_clean)
    prior = F.lit(PRIOR) * (F.col("toxic") + F.col("clean"))
    odds_toxic = F.log((F.col("toxic") + prior) / (n_toxic + weight - F.col("toxic") - prior))
    odds_clean = F.log((F.col("clean") + prior) / (n_clean + weight - F.col("clean") - prior))
    deviation = F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    return (counts.filter(F.lit(n_toxic > 0 and n_clean > 0)).withColumn("delta", odds_toxic - odds_clean)
            .withColumn("z", F.col("delta") / deviation).select("term", "delta", "z"))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from at most SAMPLE_ROWS labelled rows; ``labels`` has doc_id, toxic. Texts move nowhere: the
    sample's ids, bounded, are broadcast."""
    known = (labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS))
    labelled = docs.select("doc_id", F.col("text").alias("text")).join(F.broadcast(known), "doc_id").select("text", "toxic")
    terms = token_log_odds(labelled).filter(f"z >= {LEAST_Z} AND delta >= {LEAST_DELTA}").orderBy(F.desc("z"), "term").limit(TERMS).collect()
    model = Model({bytes(r["term"]): math.log(1 - DENSITY + DENSITY * math.exp(min(r["delta"], 12.0))) for r in terms},
                  math.log(1 - DENSITY))
    measured = settled(_scan(labelled, model, "toxic int").select("toxic", "n", F.transform("found", lambda s: s["score"]).alias("s")))
    most = F.coalesce(F.array_max("s"), F.lit(0.0))
    clean = measured.filter("toxic = 0 AND n > 0").agg(F.count(F.lit(1)), F.sum(F.col("n") * F.exp(-most))).first()
    if clean[0]:
        # Maximum likelihood of K: n K exp(-most) is exponential with mean 1 in clean texts.
        model.k = min(1.0, clean[0] / clean[1])
    level = F.log(F.greatest(F.lit(1.0), F.col("n") * model.k))
    over = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.greatest(x - level, F.lit(0.0)))
    pairs = measured.select("toxic", F.log1p(over).alias("x")).collect()
    model.slope, model.bias = _logistic(np.asarray([r["x"] for r in pairs]), np.asarray([r["toxic"] for r in pairs], float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope (never negative) and bias by Newton steps, with one imagined row of either label in each tail."""
    if not len(x) or y.min() == y.max():
        return 0.0, -2.0
    x = np.concatenate([x, [x.max(), 0.0]])
    y = np.concatenate([y, [0.0, 1.0]])
    design, w = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        v = p * (1 - p) + 1e-6
        w += np.linalg.solve(design.T @ (design * v[:, None]) + 1e-6 * np.eye(2), design.T @ (y - p) - 1e-6 * w)
        w = np.clip(w, -50, 50)
    return max(0.0, float(w[0])), float(w[1])


def _scan(rows: DataFrame, model: Model, carried: str) -> DataFrame:
    """The columns named in ``carried`` (a schema) of ``rows``, ``n`` tokens and the segments ``found`` in ``text``."""
    ddl = f"{carried}, n long, found array<struct<begin:long,end:long,score:double>>"
    schema = arrow_schema(ddl)
    names = [f.name for f in schema][:-2]

    def scan(batches):
        score, background = model.scorer(), model.background
        for *plain, texts in slices(batches, *names, "text"):
            n, found = [], []
            for text in texts:
                tokens = words(text)
                n.append(len(tokens))
                found.append([{"begin": b, "end": e, "score": s} for b, e, s in segments(score(tokens), background)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*plain, n, found], schema.types, strict=True)],
                                             schema=schema)

    return rows.select(*names, F.col("text").cast("string").alias("text")).mapInArrow(scan, ddl)


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, passages`` of every row of ``docs`` (doc_id, text): the probability of label 1, and the
    significant passages as ``begin, end`` (words, end exclusive) and ``score`` (what it exceeds a clean text by).

    A null or empty text has no passage and the score of no evidence. Rows are answered one by one; other columns
    are not read. If one of the labels was never seen, all scores are those of no evidence.
    """
    found = _scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, "doc_id long")
    level = F.log(F.greatest(F.lit(1.0), F.col("n") * model.k))
    over = F.transform(F.filter("found", lambda s: s["score"] > level),
                       lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), (s["score"] - level).alias("score")))
    evidence = F.aggregate("passages", F.lit(0.0), lambda a, s: a + s["score"])
    return (found.withColumn("passages", over)
            .select("doc_id", (1 / (1 + F.exp(-(F.log1p(evidence) * model.slope + model.bias)))).alias("score"), "passages"))


def held_out() -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return (passages(docs, model).withColumn("held_out", held_out())
            .select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))
