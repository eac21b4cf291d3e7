"""Operator 9: repeated byte strings, by a radix sort of suffixes that stops at the threshold's depth."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import repeats
from millrace.llm.common import BYTE_CODES, parts, scan, utf8, written

LENGTH = 200
ANCHOR = 64
STEPS = (12, 1)


def byte_tokens(text: str | None) -> repeats.Tokens:
    data = utf8(text)
    return repeats.Tokens(BYTE_CODES[np.frombuffer(data, np.uint8)], data)


def _keyed(docs: DataFrame, row: Column) -> DataFrame:
    """(doc, t, text, row): doc and t, hashes of different seeds, together name the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.xxhash64(F.lit(1), text).alias("doc"), F.xxhash64(text).alias("t"), "text", row.alias("row"))


def spans(docs: DataFrame, length: int = LENGTH, anchor: int | None = None, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): the runs of bytes of each text that strings of ``length`` bytes cover which also
    start anywhere else, in this text or another, or in another row of the same text.

    What is repeated is the text's alone, so spans are by text and repeated rows share them."""
    k = anchor or max(1, length * ANCHOR // LENGTH)
    texts = _keyed(docs, F.lit(None)).drop("row")
    rows = written(repeats.ranges(texts, byte_tokens, length, k, bits), "radix-rows")
    return texts, repeats.merged(repeats.repeated(rows, texts, byte_tokens, length, STEPS, False, bits), length)


def cut(data: bytes, starts, ends) -> tuple[int, bytes]:
    kept, at = [], 0
    for a, z in zip(starts, ends):
        kept.append(data[at:a])
        at = z
    kept.append(data[at:])
    left = b"".join(kept)
    return len(data) - len(left), left


def remove_repeats(docs: DataFrame, length: int = LENGTH, bits: int = 64) -> DataFrame:
    """Every row with n_bytes, n_removed, n_spans, kept_sha256 and ``kept`` (binary: a cut may fall
    inside a character).  Other columns of ``docs``, whatever their names, come as a struct ``row``.

    A null text is an empty one: nothing is removed.  A text shorter than ``length`` has no strings; an
    empty table gives no rows.  Equal texts repeat each other, so both are removed whole if long enough.
    Very long texts are worked on in segments; ranges of windows, never windows, are kept for them."""
    _, found = spans(docs, length, bits=bits)
    both = repeats.with_spans(_keyed(docs, F.struct(*docs.columns)), found).select("row", "text", "starts", "ends")
    return both.mapInArrow(_cutter(True), _schema(both, True))


def _schema(df: DataFrame, kept: bool) -> str:
    return f"row {df.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept


def _cutter(keep: bool):
    def run(batches):
        for b in batches:
            rows, all_ = b.column(0), b.column(1).to_pylist()
            starts, ends = b.column(2).to_pylist(), b.column(3).to_pylist()
            for at, part in parts(all_):
                out = [[], [], [], [], []]
                for i, x in enumerate(part, at):
                    data = utf8(x)
                    gone, left = cut(data, starts[i] or (), ends[i] or ())
                    for o, v in zip(out, (len(data), gone, len(starts[i] or ()), hashlib.sha256(left).hexdigest(), left)):
                        o.append(v)
                names = ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                cols = [pa.array(o, k) for o, k in zip(out, kinds)]
                yield pa.RecordBatch.from_arrays([rows.slice(at, len(part)), *cols][: 5 + keep], names[: 5 + keep])

    return run


def op9_radix_suffix(spark, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir).select("doc_id", "text")
    _, found = spans(docs)
    both = repeats.with_spans(_keyed(docs, F.struct("doc_id")), found).select("row", "text", "starts", "ends")
    return both.mapInArrow(_cutter(False), _schema(both, False)).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
