"""Token totals by source, language and tokenizer version, kept up to date by signed differences.

A store is a folder. Committing a batch turns its changes into signed lines (what a document counted so
far is taken back, what it counts now is added), adds the lines up per (source, lang, version) and writes
both. A batch becomes visible by one small file that names its attempt and is created only if absent:
a batch sent again, or by two writers at once, counts once, and what a failed attempt left is never read.
Totals are sums over committed differences, so no total is ever recomputed from documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightwatch.llm.packing import TOKENIZER, encoder
from flightwatch.llm.registry import query
from flightwatch.llm.tables import arrow_schema, settled, shared_root, slices, table

KEYS = ["source", "lang", "version"]
_LINE = "doc_id long, source string, lang string, version string, n_tokens long, sign int"
_TOTAL = "source string, lang string, version string, n_docs long, n_tokens long"


def token_counts(docs: DataFrame, version: str = "word_bpe_49k", path: str | None = None) -> DataFrame:
    """``doc_id, source, lang, version, n_tokens`` of every row; a null or empty text has 0 tokens."""
    path = path or public_tokenizers.path(TOKENIZER)

    ddl = "doc_id long, source string, lang string, n_tokens long"
    schema = arrow_schema(ddl)

    def count(batches):
        encode = encoder(path).encode
        for *plain, texts in slices(batches, "doc_id", "source", "lang", "text"):
            n = [len(ids) // 4 for ids in encode(texts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip([*plain, n], schema.types, strict=True)], schema=schema)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        F.col("lang").cast("string").alias("lang"), F.col("text").alias("text"))
            .mapInArrow(count, ddl).select("doc_id", "source", "lang", F.lit(version).alias("version"), "n_tokens"))


class Rollup:
    """Totals in a folder. Writers commit one after the other; readers always see whole batches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> dict[str, str]:
        """Batch to the attempt that counts; one short file per batch."""
        path, fs = self._path("commits")
        if not fs.exists(path):
            return {}
        rows = self.spark.read.text(f"{self.folder}/commits").select("value").collect()
        return dict(r["value"].split("\t", 1) for r in rows)

    def _read(self, part: str, schema: str) -> DataFrame:
        attempts = sorted(self.committed().values())
        if not attempts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{a}/{part}" for a in attempts])

    def lines(self) -> DataFrame:
        return self._read("lines", _LINE)

    def standing(self) -> DataFrame:
        """What each document counts now: lines whose signs do not cancel, ``n`` times."""
        return (self.lines().groupBy("doc_id", *KEYS, "n_tokens").agg(F.sum("sign").alias("n")).filter("n <> 0"))

    def totals(self) -> DataFrame:
        """``source, lang, version, n_docs, n_tokens``; groups that have come down to no document are gone."""
        return (self._read("totals", _TOTAL).groupBy(*KEYS)
                .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0"))

    def commit(self, batch: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Apply a batch: ``upserts`` (doc_id, source, lang, version, n_tokens) replace what their (doc_id,
        version) counted, or are new; ``deletes`` (doc_id, and version if only that one goes) take back what
        is there, unknown ones nothing. A document in both is replaced. Returns False, and does nothing, for
        a batch that is committed.

        Repeated upsert rows of a (doc_id, version) count as often as they occur. Null source, lang and
        doc_id are values like others; a null count is 0. Empty batches are committed too.
        """
        if not batch or not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch is named by letters, digits, - and _")
        if batch in self.committed():
            return False
        attempt = f"attempt-{batch}-{uuid.uuid4().hex}"
        standing, changes = self.standing(), []
        touched = []
        if upserts is not None:
            new = upserts.select(F.col("doc_id").cast("long").alias("doc_id"), *KEYS,
                                 F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
            changes.append(new.withColumn("sign", F.lit(1)))
            touched.append(new.select("doc_id", "version"))
        if deletes is not None:
            version = F.col("version") if "version" in deletes.columns else F.lit(None).cast("string")
            touched.append(deletes.select(F.col("doc_id").cast("long").alias("doc_id"), version.alias("version")))
        if touched:
            gone = touched[0] if len(touched) == 1 else touched[0].unionByName(touched[1])
            gone = gone.distinct().select(F.col("doc_id").alias("_doc"), F.col("version").alias("_version"))
            same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (
                F.col("_version").isNull() | F.col("version").eqNullSafe(F.col("_version")))
            # One copy of the line for each time it stands.
            back = (standing.join(gone, same, "left_semi")
                    .withColumn("sign", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
                    .withColumn("sign", F.lit(-1)))
            changes.append(back)
        lines = changes[0] if changes else self.spark.createDataFrame([], _LINE)
        for more in changes[1:]:
            lines = lines.unionByName(more)
        lines.withColumn("sign", F.col("sign").cast("int")).select(
            "doc_id", *KEYS, "n_tokens", "sign").write.parquet(f"{self.folder}/{attempt}/lines")
        written = self.spark.read.schema(_LINE).parquet(f"{self.folder}/{attempt}/lines")
        (written.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"),
                                    F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
         .write.parquet(f"{self.folder}/{attempt}/totals"))
        return self._publish(batch, attempt)

    def _publish(self, batch: str, attempt: str) -> bool:
        path, fs = self._path(f"commits/{batch}")
        try:
            out = fs.create(path, False)  # fails if the file is there
        except Exception as e:
            if batch in self.committed():
                return False
            raise e
        out.write(bytearray(f"{batch}\t{attempt}\n".encode()))
        out.close()
        return True


@query("op8_token_rollups")
def op8_token_rollups(spark, sf_dir):
    """Totals of all documents after four batches: all are inserted with their count of bytes as a first,
    rough version; documents of low quality are deleted; the rest are revised to real token counts; and a
    batch that is sent a second time changes nothing."""
    docs = table(spark, sf_dir, "documents")
    poor = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id").distinct()
    store = Rollup(spark, f"{shared_root(spark)}/rollup-{uuid.uuid4().hex}")
    rough = docs.select("doc_id", "source", "lang", F.lit("utf8_bytes").alias("version"),
                        F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_tokens"))
    store.commit("load", upserts=rough)
    store.commit("drop_poor", deletes=poor)
    # Texts are counted where they lie; only counts meet other tables.
    real = settled(token_counts(docs)).join(poor, "doc_id", "left_anti")
    store.commit("revise", upserts=real, deletes=real.select("doc_id", F.lit("utf8_bytes").alias("version")))
    store.commit("drop_poor", deletes=poor)
    return store.totals()
