"""Operator 6: incremental substring deduplication against a log-structured index of window fingerprints."""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import repeats
from millrace.llm.common import NULL_DOC, WordHashes, parts, scan, scratch_root, utf8, written

WINDOW = 50
ANCHOR = 17
STEPS = (1,)
BATCHES = 3

_hashes = WordHashes()


def word_tokens(text: str | None) -> repeats.Tokens:
    words = utf8(text).split()
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    return repeats.Tokens(_hashes.of(words), b" ".join(words), ends - sizes, ends)


class FingerprintIndex:
    """Immutable runs of fingerprints, all partitioned alike by fingerprint into ``buckets`` and sorted within.

    A run holds the anchored ranges of windows of the documents of one batch (see ``repeats``).  ``add``
    fingerprints a batch as a new run and merge-joins it, bucket by bucket, with every older one: history
    is read in order and not shuffled.  Matches are verified by digests of their words, down to single
    windows.  ``compact`` merges the runs into one that has only the smallest document of equal
    ranges: of those the others decide nothing.  ``texts`` is the archive from which ranges that
    differ are cut into windows: a table with the text of every document that was added.
    Runs are written once and never changed, so a lost executor costs only its tasks."""

    def __init__(self, spark: SparkSession, texts: DataFrame, root: str | None = None, window: int = WINDOW, buckets: int | None = None):
        self.spark, self.window = spark, window
        self.root = root or f"{scratch_root(spark)}/fingerprints-{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.texts = self._keyed(texts)
        self.anchor = max(1, window * ANCHOR // WINDOW)

    @staticmethod
    def _keyed(docs: DataFrame) -> DataFrame:
        return repeats.keyed(docs, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_DOC)))

    def _write(self, rows: DataFrame) -> str:
        name = f"fingerprints_{uuid.uuid4().hex}"
        rows = rows.repartition(self.buckets, "core")  # one file a bucket
        rows.write.bucketBy(self.buckets, "core").sortBy("core").option("path", f"{self.root}/{name}").option("compression", "zstd").format("parquet").saveAsTable(name)
        return name

    def _past(self) -> DataFrame:
        return reduce(DataFrame.unionByName, map(self.spark.table, self.runs))

    def add(self, docs: DataFrame) -> list[DataFrame]:
        """Adds a batch; returns tables (doc, t, start, n) of its windows that also start in a document
        of a smaller id, in the batch or before."""
        name = self._write(repeats.ranges(self._keyed(docs), word_tokens, self.window, self.anchor))
        fresh = self.spark.table(name)
        rows = fresh
        if self.runs:  # of history, only ranges whose core the batch has
            cores = fresh.select("core").distinct()
            met = [self.spark.table(run).join(cores.hint("merge"), "core", "left_semi").select(*fresh.columns) for run in self.runs]
            rows = written(reduce(DataFrame.unionByName, met, fresh), "index-met")
        found = repeats.repeated(rows, self.texts, word_tokens, self.window, STEPS, earlier=True)
        self.runs.append(name)
        return found

    def compact(self) -> None:
        """Merges all runs; of equal ranges the smallest document's stay (all of them, as it may have several)."""
        if len(self.runs) < 2:
            return
        rows, key = self._past(), ["core", "w1", "w2"]
        least = rows.groupBy(*key).agg(F.min("doc").alias("doc"))
        self.runs = [self._write(rows.join(least, [*key, "doc"], "left_semi").select(*rows.columns))]


def duplicate_spans(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """Spans of words to remove of every document: the table is added to a new index in ``batches``
    by ascending id, and compacted before each further one.  The result doesn't depend on how many; null
    ids come last."""
    index = FingerprintIndex(docs.sparkSession, docs, window=window)
    cuts = []
    if batches > 1:
        at = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)])).first()[0]
        cuts = sorted(set(at or []))
    found, low = [], None
    for high in [*cuts, None]:
        part = docs
        if low is not None:
            part = part.filter((F.col("doc_id") > low) | F.col("doc_id").isNull()) if high is None else part.filter(F.col("doc_id") > low)
        if high is not None:
            part = part.filter(F.col("doc_id") <= high)
        low = high
        found += index.add(part)
        if high is not None:
            index.compact()
    return repeats.merged(found, window)


def _cutter(keep: bool):
    def run(batches):
        for b in batches:
            rows, all_ = b.column(0), b.column(1).to_pylist()
            starts, ends = b.column(2).to_pylist(), b.column(3).to_pylist()
            for at, part in parts(all_):
                out = [[], [], [], []]
                for i, x in enumerate(part, at):
                    words = utf8(x).split()
                    n, kept, last = len(words), [], 0
                    for a, z in zip(starts[i] or (), ends[i] or ()):
                        kept += words[last:a]
                        last = z
                    kept += words[last:]
                    left = b" ".join(kept)
                    for o, v in zip(out, (n, n - len(kept), hashlib.sha256(left).hexdigest(), left.decode() if keep else None)):
                        o.append(v)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
                cols = [pa.array(o, k) for o, k in zip(out, kinds)]
                yield pa.RecordBatch.from_arrays([rows.slice(at, len(part)), *cols][: 4 + keep], ["row", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + keep])

    return run


def remove_duplicates(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES, keep_text: bool = True) -> DataFrame:
    """Every row as a struct ``row`` with n_words, n_removed, kept_sha256 and, if ``keep_text``, the
    kept words joined by blanks.

    A word goes if a window of ``window`` words covers it whose words also start in a document of a
    smaller doc_id.  Rows of one id don't remove each other's words.  A null text has no words, a
    text shorter than a window keeps all; an empty table gives no rows.  Columns keep their names within
    ``row``, so none can clash.  Very long texts go through as ranges of windows, in segments."""
    found = duplicate_spans(docs.select("doc_id", "text"), window, batches)
    doc, t = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_DOC)), F.xxhash64(F.coalesce("text", F.lit("")))
    texts = docs.select(doc.alias("doc"), t.alias("t"), "text", F.struct(*docs.columns).alias("row"))
    both = repeats.with_spans(texts, found).select("row", "text", "starts", "ends")
    schema = f"row {both.schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return both.mapInArrow(_cutter(keep_text), schema)


def op6_fingerprint_index(spark, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir).select("doc_id", "text")
    return remove_duplicates(docs, keep_text=False).select("row.doc_id", "n_words", "n_removed", "kept_sha256")
