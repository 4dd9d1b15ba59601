"""Spelling variants: words that differ by one inserted, deleted or replaced letter, found by PartEnum signatures.

1. ``vocabulary`` counts the words of all documents; each task adds up its own before the shuffle.
2. A word's letters form a multiset, read as a binary vector over (letter, how many-th). One edit changes it in one place (insertion or
   deletion) or two (replacement), so near words have a Hamming distance of at most two, and exactly one if their lengths differ.
3. PartEnum: the letters are dealt to ``PARTS`` groups of about equal weight. Vectors within distance two agree on all groups but two, so
   each word enumerates the choices of two groups left out (one, across lengths); the hash of length, choice and the letters of the other groups is a
   signature. Near words of one length share one of 21 signatures, near words of neighbouring lengths one of 7.
4. Equal signatures meet in an equi-join, where the edit distance is verified, so only near pairs leave the join. A signature with more than
   ``BUCKET`` words is not compared in pairs: its words are dealt again by (signature, place, word without that letter), which only near words share.
5. ``groups`` takes each word's near word of largest count as its form, if that is ``ratio`` times as frequent, and follows forms to the root;
   counts rise by that factor at each step, so a chain has at most log(2^63) / log(ratio) steps and pointer doubling needs a few joins.

Cases: a null or empty text has no words; a null id is written as nothing before the colon of ``drop_every``; repeated rows count as
often as they occur; equal counts are decided by code-point order; words without near words have no form and are their own root; a very long text is
read in pieces of about 1 MB cut between words; a very long word is one row and must fit a task; empty tables give an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import land
from .common import CHUNK_BYTES, chunks, packed
from .substring_dedup import _arrow, _column
from .tokens import LOWER_ASCII, bounds, word_hashes

PARTS, BUCKET, HELD, SHORT = 7, 2048, 1 << 20, 64
WORDS = "word string, n long"

_crc = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _crc = np.where(_crc & 1, (_crc >> 1) ^ np.uint32(0xEDB88320), _crc >> 1)
# fixed values: bytes of ASCII letters, and of the two-byte letters U+00C0 to U+00FF (lead byte C3)
_ascii = np.zeros(256, bool)
_ascii[65:91] = _ascii[97:123] = True
_lead = 0xC3


def letter_runs(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of letters."""
    lead = buf == _lead
    inside = _ascii[buf] | lead
    inside[1:] |= lead[:-1]
    return bounds(inside.view(np.uint8), np.arange(256) > 0)


def run_crcs(buf: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each run, carried on from ``before``; all runs advance by one byte at a time, longest first."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    state = before[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    first, left = start[order], size[order]
    for i in range(min(SHORT, int(left[0]) if len(left) else 0)):
        k = int(np.searchsorted(-left, -i, "left"))  # runs longer than i
        state[:k] = _crc[(state[:k] ^ buf[first[:k] + i]) & 0xFF] ^ (state[:k] >> np.uint32(8))
    out = np.empty(len(size), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = zlib.crc32(buf[start[i] : end[i]].tobytes(), int(before[i]))
    return out


_BETWEEN = re.compile(rb"[^A-Za-z\xc3\x80-\xbf]")  # a byte that is in no letter and in no middle of a character


def pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts of a chunk, a long one cut between words: (numbers of the texts, pieces)."""
    if len(texts) > 1 or len(texts[0]) <= 2 * CHUNK_BYTES:
        yield list(range(len(texts))), texts
        return
    at, whole = 0, texts[0]
    while at < len(whole):
        m = _BETWEEN.search(whole, at + CHUNK_BYTES)
        end = m.start() if m else len(whole)
        yield [0], [whole[at:end]]
        at = end


def count_task(min_len: int, drop_every: int | None, schema: pa.Schema):
    """Counts of the task's words; more than HELD distinct ones are handed over in parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)

        for part, texts in chunks(batches):
            prefix = np.array([zlib.crc32(x.encode() + b":") for x in _column(part, "doc").to_pylist()], np.uint32)
            for numbers, some in pieces(texts):
                data = b" ".join(some).translate(LOWER_ASCII)
                buf = np.frombuffer(data, np.uint8)
                if not len(buf):
                    continue
                start, end = letter_runs(buf)
                leads = np.r_[0, np.cumsum(buf == _lead)]
                wide = leads[end] - leads[start]  # letters of two bytes
                long_enough = end - start - wide >= min_len
                start, end = start[long_enough], end[long_enough]
                if drop_every:
                    sizes = np.array([len(t) + 1 for t in some])
                    text = np.searchsorted(np.cumsum(sizes), start, "right")
                    h = run_crcs(buf, start, end, prefix[np.array(numbers)[text]])
                    hit = h % drop_every == 0
                    for a, b, x in zip(start[hit].tolist(), end[hit].tolist(), h[hit].tolist()):
                        word = data[a:b].decode()
                        i = x % len(word)
                        if len(word) > min_len:
                            word = (word[:i] + word[i + 1 :]).encode()
                            held[word] = held.get(word, 0) + 1
                    start, end = start[~hit], end[~hit]
                _, first, n = np.unique(word_hashes(buf, start, end), return_index=True, return_counts=True)
                for a, b, c in zip(start[first].tolist(), end[first].tolist(), n.tolist()):
                    word = data[a:b]
                    held[word] = held.get(word, 0) + c
                if len(held) >= HELD:
                    yield rows()
                    held.clear()
        yield rows()
    return run


def vocabulary(docs: DataFrame, text: str = "text", id: str = "doc_id", min_len: int = 6, min_count: int = 5, drop_every: int | None = None) -> DataFrame:
    """word, n: words of ``min_len`` letters or more that occur ``min_count`` times or more. With ``drop_every`` a run whose CRC-32 with
    its document's id it divides loses one letter first."""
    d = packed(docs, text, id).select(F.coalesce(F.col("doc").cast("string"), F.lit("")).alias("doc"), "body")
    c = d.mapInArrow(count_task(min_len, drop_every, _arrow(WORDS)), WORDS)
    return c.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def deal_letters(words: DataFrame, parts: int) -> list[str]:
    """The letters in groups of about equal weight; a row for each letter in use comes to the driver."""
    rows = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()
    out, load = [""] * parts, [0] * parts
    for c, n in sorted(rows, key=lambda r: (-r[1], r[0])):
        i = load.index(min(load))
        out[i] += c
        load[i] += n
    return out


def _parts(letters: list[str]) -> list[Column]:
    """The word's letters of each group, sorted."""
    in_order = F.array_join(F.array_sort(F.split("word", "")), "")
    return [F.translate(in_order, "".join(x for j, x in enumerate(letters) if j != i), "").alias(f"p{i}") for i in range(len(letters))]


def _signed(words: DataFrame, letters: list[str], left_out: int, size: Column) -> DataFrame:
    """s, word, n and the hashes of both halves of a word of ``size`` letters (a longer word leaves its middle open)."""
    size = size.cast("int")
    half = F.floor(size / 2).cast("int")
    d = words.select("word", "n", size.alias("size"), F.hash(F.left(F.col("word"), half)).alias("fore"),
                     F.hash(F.right(F.col("word"), size - half)).alias("aft"), *_parts(letters))
    keep = list(combinations(range(len(letters)), len(letters) - left_out))
    s = F.array(*[F.xxhash64(F.lit(i), "size", *[f"p{j}" for j in c]) for i, c in enumerate(keep)])
    return d.select(F.explode(s).alias("s"), "word", "n", "fore", "aft")


def _meet(a: DataFrame, b: DataFrame, key: str, extra: Column) -> DataFrame:
    near = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    return a.alias("a").join(b.alias("b"), (F.col(f"a.{key}") == F.col(f"b.{key}")) & extra & near).select(
        F.col("a.word").alias("a"), F.col("a.n").alias("na"), F.col("b.word").alias("b"), F.col("b.n").alias("nb"))


def _met(a: DataFrame, b: DataFrame, same: bool, bucket: int) -> list[DataFrame]:
    """Near pairs under equal signatures; both sides are one table if ``same``."""
    halves = (F.col("a.fore") == F.col("b.fore")) | (F.col("a.aft") == F.col("b.aft"))
    once = F.col("a.word") < F.col("b.word") if same else F.lit(True)
    sizes = a.select("s") if same else a.select("s").unionByName(b.select("s"))
    hot = land(sizes.groupBy("s").agg(F.count("*").alias("c")).filter(F.col("c") > bucket).select("s"))
    if hot.isEmpty():
        return [_meet(a, b, "s", halves & once)]
    cold = [x.join(hot, "s", "left_anti") for x in (a, b)]
    place = F.explode(F.sequence(F.lit(1), F.length("word")))
    without = F.concat(F.expr("left(word, i - 1)"), F.expr("substr(word, i + 1)"))
    b = b.join(hot, "s", "left_semi").select("word", "n", "s", place.alias("i"))
    if same:
        dealt = b.select("word", "n", F.xxhash64("s", "i", without).alias("v"))
        return [_meet(*cold, "s", halves & once), _meet(dealt, dealt, "v", once)]
    longer = b.select("word", "n", F.xxhash64("s", without).alias("v")).distinct()
    shorter = a.join(hot, "s", "left_semi").select("word", "n", F.xxhash64("s", "word").alias("v"))
    return [_meet(*cold, "s", halves), _meet(shorter, longer, "v", F.lit(True))]


def near_pairs(words: DataFrame, parts: int = PARTS, bucket: int = BUCKET) -> DataFrame:
    """a, na, b, nb: each pair of words (distinct in ``words``) with an edit distance of one, once."""
    letters = deal_letters(words, parts)
    size = F.length("word")
    level = _signed(words, letters, 2, size)
    shorter, longer = _signed(words, letters, 1, size), _signed(words, letters, 1, size - 1)
    out = _met(level, level, True, bucket) + _met(shorter, longer, False, bucket)
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0].groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"))


def groups(words: DataFrame, ratio: int = 5, parts: int = PARTS, bucket: int = BUCKET) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of ``words`` (word, n)."""
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, else forms may run in circles")
    words = land(words)
    p = near_pairs(words, parts, bucket)
    side = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")),
                             F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m"))))
    best = p.select(side.alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other"))).alias("best"))
    form = F.when(-F.col("best.m") >= ratio * F.col("n"), F.col("best"))
    r = land(words.join(best, "word", "left").select("word", form["other"].alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-form["m"]).alias("form_n")))
    step = land(r.filter("form is not null").select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(63 / math.log2(ratio) + 1))):
        further = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = land(step.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        step = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    return r.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
