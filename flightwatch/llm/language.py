"""Language of texts by a bidirectional gated recurrent network over bytes.

The network is small and trained here, in numpy, by backpropagation through time, on a bounded sample of
labelled rows. It reads UTF-8 bytes in windows of fixed length, one state running forward and one backward,
and gives every position a probability for each language. A document's probability is the mean over all
positions of its whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightwatch.llm.registry import query
from flightwatch.llm.tables import arrow_schema, slices, table

#: Bytes that the network sees together, and cells of each direction.
WINDOW, CELLS = 128, 8
#: Bound of the training sample: rows for each language, and passages of each row.
ROWS_PER_LANGUAGE, PASSAGES = 500, 4
MAX_LANGUAGES = 256
STEPS, BATCH, RATE = 300, 128, 0.02
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]").search


def _tanh_gates(x: np.ndarray) -> np.ndarray:
    """The logistic function of twice ``x``, in place."""
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Network:
    """Parameters: ``e`` input rows of both directions for each byte (gates z, r, n), ``u`` recurrent weights,
    ``o`` and ``c`` the output layer. Gates z and r are logistic functions of twice their sums."""

    def __init__(self, languages: list[str], cells: int = CELLS, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages, self.cells = languages, cells
        self.p = {"e": rng.normal(0, 0.1, (512, 3 * cells)), "u": rng.normal(0, 0.5 / np.sqrt(cells), (2, cells, 3 * cells)),
                  "o": rng.normal(0, 0.1, (2 * cells, len(languages))), "c": np.zeros(len(languages))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def states(self, x: np.ndarray, tape: list | None = None) -> np.ndarray:
        """Both directions' states at all positions, (time, row, 2 * cells), of bytes (time, row)."""
        h, (t, n) = self.cells, x.shape
        e, u = self.p["e"], self.p["u"]
        at = np.stack([x.astype(np.intp), x[::-1].astype(np.intp) + 256], axis=1)
        out = np.empty((t, n, 2 * h), np.float32)
        s = np.zeros((2, n, h), np.float32)
        for i in range(t):
            g = e.take(at[i], axis=0)
            a = np.matmul(s, u)
            a[..., :2 * h] += g[..., :2 * h]
            gates = _tanh_gates(a[..., :2 * h])
            z, r = gates[..., :h], gates[..., h:]
            inner = a[..., 2 * h:]
            m = r * inner
            m += g[..., 2 * h:]
            np.tanh(m, out=m)
            if tape is not None:
                tape.append((at[i], s, z, r, inner, m))
            s = m + z * (s - m)
            out[i, :, :h] = s[0]
            out[t - 1 - i, :, h:] = s[1]
        return out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        y = states.reshape(-1, states.shape[-1]) @ self.p["o"] + self.p["c"]
        y -= y.max(axis=1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=1, keepdims=True)
        return y.reshape(*states.shape[:2], -1)

    def gradients(self, x: np.ndarray, label: np.ndarray, real: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over real positions, and its gradients, backwards through time."""
        h, (t, n) = self.cells, x.shape
        tape: list = []
        states = self.states(x, tape)
        p = self.probabilities(states)
        weight = real / real.sum()
        loss = -float((np.log(p[:, np.arange(n), label] + 1e-9) * weight).sum())
        dy = p * weight[..., None]
        dy[:, np.arange(n), label] -= weight
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        flat = dy.reshape(-1, dy.shape[-1])
        g["o"] = states.reshape(-1, 2 * h).T @ flat
        g["c"] = flat.sum(axis=0)
        dout = (flat @ self.p["o"].T).reshape(t, n, 2 * h)
        ds, u = np.zeros((2, n, h), np.float32), self.p["u"]
        for i in range(t - 1, -1, -1):
            at, s, z, r, inner, m = tape[i]
            ds = ds + np.stack([dout[i, :, :h], dout[t - 1 - i, :, h:]])
            dm = ds * (1 - z) * (1 - m * m)
            dz = ds * (s - m) * 2 * z * (1 - z)
            dr = dm * inner * 2 * r * (1 - r)
            da = np.concatenate([dz, dr, dm * r], axis=2)
            dg = np.concatenate([dz, dr, dm], axis=2)
            np.add.at(g["e"], at.ravel(), dg.reshape(-1, 3 * h))
            g["u"] += np.matmul(s.transpose(0, 2, 1), da)
            ds = ds * z + np.matmul(da, u.transpose(0, 2, 1))
        return loss, g

    def fit(self, windows: np.ndarray, label: np.ndarray, real: np.ndarray, steps: int = STEPS, seed: int = 0) -> list[float]:
        """Adam over batches drawn evenly from the languages."""
        rng = np.random.default_rng(seed)
        rows = [np.flatnonzero(label == k) for k in range(len(self.languages))]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(r, max(1, BATCH // len(rows))) for r in rows])
            loss, g = self.gradients(windows[pick].T, label[pick], real[pick].T)
            losses.append(loss)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
            for k, v in g.items():
                v = v * min(1.0, 1 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                self.p[k] -= (rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return losses

    def documents(self, texts: list[bytes], rows: int = 1024) -> np.ndarray:
        """Mean probabilities over all positions of each (non-empty) text."""
        counts = [-(-len(t) // WINDOW) for t in texts]
        data = b"".join([t + bytes(-len(t) % WINDOW) for t in texts])
        windows = np.frombuffer(data, np.uint8).reshape(-1, WINDOW)
        sums = np.empty((len(windows), len(self.languages)), np.float64)
        begins = np.concatenate([[0], np.cumsum(counts)])[:-1]
        length = np.full(len(windows), WINDOW)
        length[np.cumsum(counts) - 1] = [len(t) - (c - 1) * WINDOW for t, c in zip(texts, counts, strict=True)]
        for at in range(0, len(windows), rows):
            part = np.ascontiguousarray(windows[at:at + rows].T)
            p = self.probabilities(self.states(part))
            short = length[at:at + rows]
            if (short < WINDOW).any():
                p *= (np.arange(WINDOW)[:, None] < short)[..., None]
            sums[at:at + rows] = p.sum(axis=0)
        total = np.add.reduceat(sums, begins, axis=0)
        return total / total.sum(axis=1, keepdims=True)


def training_passages(labelled: DataFrame, window: int = WINDOW) -> tuple[list[str], list[str]]:
    """Passages and their languages from at most ROWS_PER_LANGUAGE rows (by a hash of the id) of each language;
    of a long text, PASSAGES places are read. ``labelled`` has doc_id, text, lang."""
    rows = labelled.filter(F.col("lang").isNotNull() & (F.length("text") > 0))
    found = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not found:
        return [], []
    span = 2.0 ** 62
    draw = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62))).cast("double")
    share = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(1.0, 1.5 * ROWS_PER_LANGUAGE / r["count"]) * span)])
    places = F.transform(F.sequence(F.lit(0), F.lit(PASSAGES - 1)), lambda k: F.substring(
        F.col("text"), (F.length("text") * k / PASSAGES).cast("int") + 1, F.lit(window)))
    sample = (rows.filter(draw < F.element_at(share, F.col("lang"))).select("lang", draw.alias("draw"), places.alias("places"))
              .orderBy("draw").limit(2 * ROWS_PER_LANGUAGE * len(found)).collect())
    pairs = [(p, r["lang"]) for r in sample for p in dict.fromkeys(r["places"]) if p]
    return [p for p, _ in pairs], [k for _, k in pairs]


def train(passages: list[str], langs: list[str], steps: int = STEPS) -> Network:
    languages = sorted(set(langs))
    net = Network(languages)
    if len(languages) > 1:
        data = [p.encode("utf-8", "surrogatepass")[:WINDOW] for p in passages]
        windows = np.frombuffer(b"".join(d.ljust(WINDOW, b"\0") for d in data), np.uint8).reshape(-1, WINDOW)
        real = (np.arange(WINDOW) < np.asarray([[len(d)] for d in data])).astype(np.float32)
        number = {k: i for i, k in enumerate(languages)}
        net.fit(windows, np.asarray([number[k] for k in langs]), real, steps)
    return net


def _labels(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    some = [i for i, t in enumerate(texts) if net.languages and t and _LETTER(t)]
    if some:
        p = net.documents([texts[i].encode("utf-8", "surrogatepass") for i in some])
        for i, k, v in zip(some, p.argmax(axis=1), p.max(axis=1), strict=True):
            langs[i], scores[i] = net.languages[k], float(v)
    return langs, scores


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row: the likeliest language of the whole text and its probability.

    A null text, or one without a letter, is UNKNOWN with score 0; so is every text if nothing was learned. Rows
    are answered one by one, other columns are not read.
    """
    ddl = "doc_id long, lang_pred string, score double"
    schema = arrow_schema(ddl)

    def label(batches):
        for ids, texts in slices(batches, "doc_id", "text"):
            cols = [ids, *_labels(net, texts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(label, ddl)


def recognised(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose ``text`` has a language; those that would be UNKNOWN go."""
    def keep(batches):
        for batch in batches:
            langs = [k for (texts,) in slices([batch], "text") for k in _labels(net, texts)[0]]
            yield batch.filter(pa.array([k != UNKNOWN for k in langs], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def held_out(k: int, rest: int) -> Column:
    """Rows that training never sees: crc32 of the id as text leaves ``rest`` modulo ``k``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % k == rest, F.lit(False))


def train_on(docs: DataFrame) -> Network:
    """The network for ``docs`` (doc_id, text, lang), learned from rows outside its held-out quarter."""
    return train(*training_passages(docs.filter(~held_out(4, 2)).select("doc_id", "text", "lang")))


@query("op3_language")
def op3_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return (predict(docs, train_on(docs)).withColumn("held_out", held_out(4, 2))
            .select("doc_id", "held_out", "lang_pred", "score"))
