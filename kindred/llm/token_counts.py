"""Token counts kept up to date by deltas: totals by source, language and tokenizer version.

A batch of changes inserts, revises or deletes the count of a document under a tokenizer. Its effect on the totals is
a sum of signed contributions: plus the new count of each key it touches, minus the one that held before. That sum,
one row per source, language and tokenizer, is all a batch adds; totals are sums over batches, and no document that the
batch does not name is read again.

A batch is committed once its mark stands in the shared folder, an empty file written when its delta and its log are
complete. Committing it again does nothing; a batch that broke off left no mark, is not seen by readers, and is
overwritten by the next attempt. Folders are named by number and a digest of the batch's name, so any text may name one.

The log of changes lies in buckets of documents. A batch reads those that its documents fall in, and ``compact`` replaces the
log by the last state of each key and the deltas by their totals, under a mark of its own, so that what a batch reads is
bounded by the documents of its buckets and not by their history.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.texts import materialize, table, words
from kindred.session import scratch_path

GROUP = ["source", "lang", "tokenizer"]
LOG = "commit_no long, doc_id {id}, tokenizer string, source string, lang string, n_tokens long, alive boolean, bucket int"
DELTA = "commit_no long, source string, lang string, tokenizer string, n_docs long, n_tokens long"
MARK = "_COMMITTED"
BUCKETS = 64
PIECE = r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"


class TokenRollup:
    """Totals in the folder ``path``, which all executors reach; ``buckets`` must stay as it was at the first commit."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "long", buckets: int = BUCKETS):
        self.spark, self.path, self.log_schema, self.buckets = spark, path.rstrip("/"), LOG.format(id=id_type), buckets

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _marked(self, kind: str) -> list[tuple[int, str]]:
        """Number and folder of what is complete of a kind, in order."""
        root, files = self._path(kind), self._files()
        if not files.exists(root):
            return []
        folders = [status.getPath().getName() for status in files.listStatus(root)]
        return sorted((int(f.partition("-")[0]), f) for f in folders if files.exists(self._path(kind, f, MARK)))

    def _mark(self, kind: str, folder: str) -> None:
        self._files().create(self._path(kind, folder, MARK), True).close()

    def _state(self) -> tuple[int, list[str], list[str]]:
        """Number of the last commit, and the folders of deltas and logs that make up the present state."""
        deltas, compacted = self._marked("deltas"), self._marked("compacted")
        upto, base = compacted[-1] if compacted else (0, None)
        later = [f for n, f in deltas if n > upto]
        first = [[f"compacted/{base}/{kind}"] if base else [] for kind in ("deltas", "log")]
        return max([upto, *(n for n, _ in deltas)]), first[0] + [f"deltas/{f}" for f in later], first[1] + [f"log/{f}" for f in later]

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{f}") for f in folders]
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        return found

    def _bucketed(self, log: DataFrame, folder: str) -> None:
        log.repartition("bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{folder}")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies ``changes`` (doc_id, tokenizer, seq, op, source, lang, n_tokens) once; False if it was applied before.

        ``batch`` may be any text. ``op`` is insert, revise or delete; an insert of a known key revises it, and a revision
        of an unknown one inserts it. Of several changes of one key the last by ``seq`` holds, of equal ones the
        largest by its columns. A null count is 0; null ids, sources and languages are values of their own. Other
        operations are left out. One writer at a time.
        """
        name = hashlib.sha256(batch.encode()).hexdigest()
        if any(f.partition("-")[2] == name for _, f in self._marked("deltas")):
            return False
        upto, _, logs = self._state()
        number = 1 + upto
        folder = f"{number:09d}-{name}"
        last = F.max(F.struct("seq", (F.col("op") != "delete").alias("alive"), "source", "lang", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))).alias("last")
        new = changes.where(F.col("op").isin("insert", "revise", "delete")).groupBy("doc_id", "tokenizer").agg(last)
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int").alias("bucket")
        new = new.select(F.lit(number).cast("long").alias("commit_no"), "doc_id", "tokenizer", "last.source", "last.lang", "last.n_tokens", "last.alive", bucket)
        self._bucketed(new, f"log/{folder}")
        new = self._read([f"log/{folder}"], self.log_schema)
        signed = new.where("alive").select(*GROUP, F.lit(1).cast("long").alias("sign"), "n_tokens")
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
        if logs and touched:
            keys = new.select(F.col("doc_id").alias("id"), F.col("tokenizer").alias("by"))
            before = self._read(logs, self.log_schema).where(F.col("bucket").isin(touched))
            before = before.join(keys, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("tokenizer").eqNullSafe(F.col("by")), "left_semi")
            signed = signed.unionByName(
                present(before).where("alive").select(*GROUP, F.lit(-1).cast("long").alias("sign"), "n_tokens")
            )
        delta = signed.groupBy(*GROUP).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        delta.select(F.lit(number).cast("long").alias("commit_no"), *GROUP, "n_docs", "n_tokens").write.mode("overwrite").parquet(f"{self.path}/deltas/{folder}")
        self._mark("deltas", folder)
        return True

    def compact(self) -> None:
        """Puts the present state in the place of all commits so far; an attempt that breaks off changes nothing.

        Folders of commits stay where they are, as their names say which batches were applied and readers may be at
        them; nothing reads their contents any more.
        """
        upto, deltas, logs = self._state()
        if len(deltas) < 2:
            return
        folder = f"{upto:09d}"
        self._bucketed(present(self._read(logs, self.log_schema)).where("alive"), f"compacted/{folder}/log")
        total = self.totals().select(F.lit(upto).cast("long").alias("commit_no"), *GROUP, "n_docs", "n_tokens")
        total.write.mode("overwrite").parquet(f"{self.path}/compacted/{folder}/deltas")
        self._mark("compacted", folder)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches; groups without documents are left out."""
        deltas = self._read(self._state()[1], DELTA)
        return deltas.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs != 0")


def present(log: DataFrame) -> DataFrame:
    """The last state of each key of a log."""
    last = F.max(F.struct("commit_no", "alive", "source", "lang", "n_tokens", "bucket")).alias("last")
    return log.groupBy("doc_id", "tokenizer").agg(last).select(
        "last.commit_no", "doc_id", "tokenizer", "last.source", "last.lang", "last.n_tokens", "last.alive", "last.bucket"
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over all documents, one of them sent twice.

    Words and pieces of every document are inserted; a seventh of the word counts is revised to count the text's end
    too; an eleventh of the documents is deleted under both tokenizers.
    """
    docs = table(spark, sf_dir, "documents")
    counted = materialize(
        docs.select(
            "doc_id", "source", "lang", F.size(words(F.col("text"))).cast("long").alias("words"),
            F.coalesce(F.regexp_count("text", F.lit(PIECE)), F.lit(0)).cast("long").alias("pieces"),
        ),
        "token-counts",
    )

    def changes(rows: DataFrame, op: str, tokenizer: str, n: str) -> DataFrame:
        return rows.select("doc_id", F.lit(tokenizer).alias("tokenizer"), F.lit(0).alias("seq"), F.lit(op).alias("op"), "source", "lang", F.expr(n).alias("n_tokens"))

    rollup = TokenRollup(spark, scratch_path(spark, "token-rollup"), docs.schema["doc_id"].dataType.simpleString())
    revised = changes(counted.where("pmod(doc_id, 7) = 3"), "revise", "words-1", "words + 1")
    gone = counted.where("pmod(doc_id, 11) = 5")
    for batch, rows in (
        ("words", changes(counted, "insert", "words-1", "words")),
        ("pieces", changes(counted, "insert", "pieces-1", "pieces")),
        ("ends", revised),
        ("ends", revised),
        ("takedown", changes(gone, "delete", "words-1", "0").unionByName(changes(gone, "delete", "pieces-1", "0"))),
    ):
        rollup.commit(batch, rows)
    return rollup.totals()


ORACLE = r"""
WITH counted AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')) AS pieces
  FROM documents
), kept AS (
  SELECT source, lang, 'words-1' AS tokenizer, coalesce(words, 0) + CASE WHEN doc_id % 7 = 3 THEN 1 ELSE 0 END AS n, doc_id FROM counted
  UNION ALL SELECT source, lang, 'pieces-1', coalesce(pieces, 0), doc_id FROM counted
)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM kept WHERE doc_id % 11 <> 5 GROUP BY source, lang, tokenizer
"""
