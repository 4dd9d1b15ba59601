"""Shared helpers of the operators: row identity, documents in, UTF-8 chunks for Arrow tasks.

Convention: an operator packs the caller's row into one struct column ``row`` and adds its own columns beside
it, so columns of the input never clash with its own. ``k1, k2`` is a 128-bit row identity over id and text; rows
that agree in both are the same document and get the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHUNK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def packed(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``row`` (every input column), ``doc`` (the id), ``body`` (text, null as empty)."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id}`").alias("doc"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))


def row_keys(doc: str = "doc", body: str = "body") -> list[Column]:
    """Two independent 64-bit hashes of (id, text)."""
    return [F.xxhash64(doc, body).alias("k1"), F.xxhash64(F.lit(1), body, doc).alias("k2")]


def keyed(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``doc``, ``body``, ``k1``, ``k2``: the input of a task that returns rows per document."""
    return packed(docs, text, id).select("doc", "body", *row_keys())


def hash_pair(value: Column) -> list[Column]:
    """128 bits of a string as two longs."""
    return [F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(1), value).alias("h2")]


def with_text(row_type, text: str, value: Column) -> Column:
    """The packed row with its text replaced and ``n_chars`` (if there) recounted."""
    out = F.col("row").withField(f"`{text}`", value)
    return out.withField("n_chars", F.length(value).cast(row_type["n_chars"].dataType)) if "n_chars" in row_type.names else out


def row_type(df: DataFrame):
    return df.schema["row"].dataType


def chunks(batches: Iterator[pa.RecordBatch], column: str = "body", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches whose texts hold about ``limit`` bytes (one row at least), with the texts as UTF-8."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = [len(x) for x in (v.as_buffer() if v.is_valid else b"" for v in batch.column(at))]
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield _slice(batch, at, start, i)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield _slice(batch, at, start, len(sizes))


def _slice(batch: pa.RecordBatch, at: int, start: int, end: int) -> tuple[pa.RecordBatch, list[bytes]]:
    part = batch.slice(start, end - start)
    return part, [v.as_buffer().to_pybytes() if v.is_valid else b"" for v in part.column(at)]
