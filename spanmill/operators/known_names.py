"""Known names inside texts: a search for many patterns as a hash lookup of grams, verified where it is found.

Every name is looked up by one of its grams (16, 8, 4, 2 or 1 bytes of UTF-8, the longest that fits), the one fewest names
share. Tasks over the texts hash the window at every byte with numpy and meet the names in blocks of a fixed size, one broadcast each: the
texts are read once a block and never shuffled, and a task returns one count per column and name.

Null and empty texts hold no name, null and empty names are none; repeated names count once; matching is by code points and
case-sensitive. Results count cells (an element of an array or a map is a cell), however often a cell holds the name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAMS = [16, 8, 4, 2, 1]
PIECE = 1 << 20  # windows that a task hashes at once
BLOCK_ROWS, BLOCK_BYTES = 200_000, 32 << 20


def _tagged(values: Column, tag: Column, name: str) -> Column:
    return F.transform(values, lambda x: F.struct(tag, x.alias(name)))


def text_cells(df: DataFrame) -> DataFrame:
    """(column, text): every string of a frame, elements of arrays and values of maps included."""
    parts = []
    for f in df.schema.fields:
        t, c = f.dataType.simpleString(), F.col("`" + f.name.replace("`", "``") + "`")
        if t in ("string", "array<string>", "map<string,string>"):
            vals = F.array(c) if t == "string" else c if t.startswith("array") else F.map_values(c)
            parts.append(_tagged(F.coalesce(vals, F.array().cast("array<string>")), F.lit(f.name).alias("column"), "text"))
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, text string")
    return df.select(F.explode(F.concat(*parts)).alias("c")).select("c.column", "c.text").filter("text <> ''")


def _grams(text: str, q: int) -> Column:
    # a look-ahead has no width, so every position gives its gram in one pass
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1)))


def _anchors(names: DataFrame) -> DataFrame:
    """(name, q, at): the gram a name is looked up by, as its bytes and where they start."""
    q = F.coalesce(*[F.when(F.octet_length("name") >= k, F.lit(k)) for k in GRAMS])
    n = names.select(F.col("name").cast("string").alias("name")).filter("name <> ''").distinct().withColumn("q", q)
    n = n.withColumn("raw", F.decode(F.encode("name", "UTF-8"), "ISO-8859-1"))  # a character for each byte
    all_grams = F.coalesce(*[F.when(F.col("q") == k, _grams("raw", k)) for k in GRAMS])
    each = n.select("name", "raw", "q", F.explode(all_grams).alias("gram"))
    shared = each.groupBy("q", "gram").agg(F.count("*").alias("n"))
    best = F.min(F.struct("n", "gram")).alias("b")
    return each.join(shared, ["q", "gram"]).groupBy("name", "raw", "q").agg(best).select("name", "q", (F.instr("raw", F.col("b.gram")) - 1).alias("at"))


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings in one array, and where each string starts (and the last one ends)."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), ends


def _windows(data: np.ndarray, start: int, n: int) -> np.ndarray:
    """The 8 bytes from each of ``n`` positions on, as integers; zeros behind the end."""
    held = np.zeros(-(-n // 8) * 8 + 8, np.uint8)
    part = data[start : start + len(held)]
    held[: len(part)] = part
    out = np.empty(len(held) - 8, "<u8")
    for i in range(8):
        out[i::8] = held[i : i + len(out)].view("<u8")
    return out[:n]


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _keys(w: np.ndarray, beyond: np.ndarray, q: int) -> np.ndarray:
    """One integer for ``q`` bytes: the bytes, or a hash of 16, whose last 8 are ``beyond``."""
    if q == 16:
        return (w * np.uint64(0xD6E8FEB86659FD93)) ^ (beyond * _MIX)
    return w if q == 8 else w & np.uint64((1 << 8 * q) - 1)


class Names:
    """A block of names by the keys of their grams."""

    def __init__(self, block: pa.Table):
        self.names = block.column("name").combine_chunks()
        self.data, ends = _utf8(self.names)
        self.start, self.size = ends[:-1], np.diff(ends)
        self.at, q_of = (block.column(c).to_numpy().astype(np.int64) for c in ("at", "q"))
        self.grams = {}
        for q in np.unique(q_of).tolist():
            ids = np.flatnonzero(q_of == q)
            w = np.zeros((len(ids), 16), np.uint8)
            w[:, :q] = self.data[(self.start + self.at)[ids][:, None] + np.arange(q)]
            key = _keys(*w.view("<u8").T, q)
            order = np.argsort(key, kind="stable")
            keys, first = np.unique(key[order], return_index=True)
            bits = min(22, max(10, int(len(keys)).bit_length() + 5))
            seen = np.zeros(1 << bits, bool)
            seen[(keys * _MIX) >> np.uint64(64 - bits)] = True
            self.grams[q] = keys, np.append(first, len(ids)), ids[order], seen, np.uint64(64 - bits)

    def found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, name) of every text that holds a name, once each."""
        data, ends = _utf8(texts)
        out = [np.empty(0, np.int64)]
        for start in range(int(ends[0]), int(ends[-1]), PIECE):
            n = min(PIECE, int(ends[-1]) - start)
            w = _windows(data, start, n + 8)
            for q, (keys, first, ids, seen, shift) in self.grams.items():
                k = _keys(w[:n], w[8:], q)
                at = np.flatnonzero(seen[(k * _MIX) >> shift])
                g = np.minimum(np.searchsorted(keys, k[at]), len(keys) - 1)
                hit = keys[g] == k[at]
                at, g = at[hit] + start, g[hit]
                many = first[g + 1] - first[g]
                base = np.repeat(first[g] - np.cumsum(many) + many, many)
                name = ids[base + np.arange(len(base))]
                row = np.repeat(np.searchsorted(ends, at, "right") - 1, many)
                at = np.repeat(at, many) - self.at[name]
                fits = (at >= ends[row]) & (at + self.size[name] <= ends[row + 1])
                out.append(self._equal(data, at[fits], name[fits], row[fits], q))
        both = np.unique(np.concatenate(out))
        return both // len(self.size), both % len(self.size)

    def _equal(self, data: np.ndarray, at: np.ndarray, name: np.ndarray, row: np.ndarray, q: int) -> np.ndarray:
        """row * names + name where the text at ``at`` is the name."""
        both = row * len(self.size) + name
        size, of = self.size[name], self.start[name]
        ok, i, left = np.ones(len(at), bool), 0, np.flatnonzero((size > q) | (q > 8))
        while len(left) and i < 64:
            same = data[at[left] + i] == self.data[of[left] + i]
            ok[left[~same]] = False
            i += 1
            left = left[same & (size[left] > i)]
        for x in left.tolist():
            ok[x] = np.array_equal(data[at[x] : at[x] + size[x]], self.data[of[x] : of[x] + size[x]])
        return np.unique(both[ok])


def _count(block, schema: pa.Schema):
    """Cells per column and name of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sums = block.value, {}
        for b in batches:
            row, name = names.found(b.column(b.schema.get_field_index("text")))
            columns = b.column(b.schema.get_field_index("column")).dictionary_encode()
            of = columns.indices.fill_null(-1).to_numpy(zero_copy_only=False)[row]
            for i in np.unique(of).tolist():
                column = None if i < 0 else columns.dictionary[i].as_py()
                sums[column] = sums.get(column, 0) + np.bincount(name[of == i], minlength=len(names.size))
        for column, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([column] * len(at), pa.string()), names.names.take(pa.array(at)).cast(pa.string()), pa.array(n[at])], schema=schema)
    return run


def names_in_cells(cells: DataFrame, names: DataFrame) -> DataFrame:
    """(column, name, cells): how many cells of a column hold a name; ``cells(column, text)``, ``names(name)``."""
    spark = cells.sparkSession
    from ..session import land
    a = land(_anchors(names))
    size = a.agg(F.count("*").alias("n"), F.sum(F.octet_length("name")).alias("bytes")).first()
    ddl = "column string, name string, cells bigint"
    if not size["n"]:
        return spark.createDataFrame([], ddl)
    blocks = max(-(-size["n"] // BLOCK_ROWS), -(-size["bytes"] // BLOCK_BYTES))
    schema, hits = pa.schema([("column", pa.string()), ("name", pa.string()), ("cells", pa.int64())]), []
    for b in range(blocks):
        part = (a if blocks == 1 else a.filter(F.pmod(F.xxhash64("name"), F.lit(blocks)) == b)).toArrow()
        if part.num_rows:
            hits.append(cells.select("column", "text").mapInArrow(_count(spark.sparkContext.broadcast(Names(part)), schema), ddl))
    return reduce(DataFrame.unionByName, hits).groupBy("column", "name").agg(F.sum("cells").alias("cells"))


def names_in_texts(df: DataFrame, names: DataFrame) -> DataFrame:
    """``names_in_cells`` over all strings of a frame."""
    return names_in_cells(text_cells(df), names)
