"""Quality rules: hashed n-gram log-likelihood ratio between trusted texts and the raw corpus, and plain counts.

1. N-grams are words and pairs of neighbouring words, unchanged. A word's hash is the polynomial of its code points over ``BASE`` modulo
   ``PRIME``; a pair's hash joins the two; the bucket is the hash modulo ``buckets``.
2. Two multinomials over the buckets are counted over all documents: the trusted ones (``trusted`` holds their ids) and the raw corpus.
   The number of buckets grows with the corpus: the power of two at or above sqrt(bytes of text), between ``LEAST`` and ``MOST``. MOST bounds
   what is broadcast (4 bytes a bucket, 16 MB); it is reached at about 18 TB, from where on buckets are shared by more n-grams.
   Only trusted texts are shuffled, to meet their ids: a broadcast of at most ``SIEVE`` hashed ids (8 MB) keeps most others out before.
3. A bucket's weight is floor(10^6 ln((t + PRIOR) / (e + PRIOR))): t its trusted count, e = r T / R the count that the raw corpus would
   give in as many n-grams. PRIOR smooths both alike, so n-grams too rare to tell weigh about nothing.
4. A document's score is the sum of its n-grams' weights div their number, in integers, so it does not depend on order or partitions.
   The verdict is score >= ``threshold`` for every document (default: n-grams on average 9 % less likely in trusted texts).

Cases: a null text has no words, and a document without words fails; repeated rows count as often as they occur and get equal results;
repeated or null ids in ``trusted`` count once or not at all; a document with a null id is never trusted; without trusted
documents, or on an empty table, all weights are 0 (e is 0 too); a score on the threshold is kept; texts of any length are read whole, one chunk of
about 1 MB or one text at a time, so a text must fit a task's memory about 30 times; extra columns stay out of the way in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import land
from .common import chunks, packed
from .substring_dedup import _arrow, _column
from .tokens import SPACED, SPACES, Words

PRIME, BASE, JOIN = (1 << 31) - 1, 1_000_003, 69_069  # 2^31 - 1 and two odd multipliers below it (arbitrary)
LEAST, MOST, SIEVE, PRIOR, THRESHOLD = 1 << 16, 1 << 22, 1 << 20, 10, -90_000
MIN_WORDS, MAX_REPEAT = 50, 50
SYMBOLS = "#*$%&|<>"
FLUSH = 1 << 31
LONG = 2048
COUNTS = "bucket int, n long"
SCORES = "doc {id}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score long"

_pow = np.ones(LONG + 1, np.int64)
for _i in range(1, LONG + 1):
    _pow[_i] = _pow[_i - 1] * BASE % PRIME
_blank = np.zeros(33, bool)
_blank[list(SPACES)] = True
_symbol = np.isin(np.arange(128), [ord(c) for c in SYMBOLS])


class Grams:
    """Words of some texts as code points: start, length and hash of each, and the bucket of every n-gram."""

    def __init__(self, texts: list[bytes], buckets: int):
        self.points = np.frombuffer(b" ".join(texts).decode().encode("utf-32-le"), np.uint32)
        inside = np.zeros(len(self.points) + 2, np.int8)
        inside[1:-1] = ~_blank[np.minimum(self.points, 32)] | (self.points > 32)
        step = np.diff(inside)
        self.start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.length = end - self.start
        sizes = np.array([len(t.decode()) + 1 for t in texts], np.int64)
        self.first_point = np.cumsum(sizes) - sizes
        first = np.searchsorted(self.start, self.first_point)
        self.count = np.diff(np.r_[first, len(self.start)])
        self.text = np.repeat(np.arange(len(texts)), self.count)
        h = self._hash()
        pair = np.flatnonzero(self.text[1:] == self.text[:-1]) if len(h) > 1 else np.empty(0, np.int64)
        self.bucket = np.r_[h, (h[pair] * JOIN + h[pair + 1] + 1) % PRIME] % buckets
        self.gram_text = np.r_[self.text, self.text[pair]]

    def _hash(self) -> np.ndarray:
        if not len(self.start):
            return np.empty(0, np.int64)
        i = np.arange(self.length.sum())
        head = np.cumsum(self.length) - self.length
        left = np.repeat(self.length + head, self.length) - 1 - i  # code points to the word's end
        point = self.points[i + np.repeat(self.start - head, self.length)].astype(np.int64)
        h = np.add.reduceat(point * _pow[np.minimum(left, LONG)] % PRIME, head) % PRIME
        for w in np.flatnonzero(self.length > LONG).tolist():
            x = 0
            word = self.points[self.start[w] : self.start[w] + self.length[w]].astype(np.int64)
            for lo in range(0, len(word), LONG):
                c = word[lo : lo + LONG]
                x = (x * int(_pow[len(c)]) + int((c * _pow[len(c) - 1 :: -1][: len(c)] % PRIME).sum())) % PRIME
            h[w] = x
        return h


def count_task(buckets: int, schema: pa.Schema):
    """Counts of the task's n-grams per bucket; a bucket has a row for each task that holds it."""
    def rows(counts: np.ndarray) -> pa.RecordBatch:
        b = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(counts[b], pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = np.zeros(buckets, np.uint32), 0
        for _, texts in chunks(batches):
            some = Grams(texts, buckets).bucket
            if held + len(some) >= FLUSH:
                yield rows(counts)
                counts[:], held = 0, 0
            held += len(some)
            at, n = np.unique(some, return_counts=True)
            counts[at] += n.astype(np.uint32)
        yield rows(counts)
    return run


def repeated_words(w: Words, n: int = 3) -> np.ndarray:
    """Per text, the words inside an ``n``-word window whose words occur twice or more in that text."""
    at, h = w.runs(n, 0)
    text = w.text[at]
    order = np.lexsort((h, text))
    same = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    some = order[np.r_[same, False] | np.r_[False, same]]
    at2, h2 = w.runs(n, 1)
    some = some[np.lexsort((h2[some], h[some], text[some]))]  # the second hash decides among windows with one first hash
    same = (h[some][1:] == h[some][:-1]) & (h2[some][1:] == h2[some][:-1]) & (text[some][1:] == text[some][:-1])
    hit = at[some[np.r_[same, False] | np.r_[False, same]]] if len(some) else some
    cover = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + n, -1)
    return np.bincount(w.text[np.cumsum(cover[:-1]) > 0], minlength=len(w.count))


def measures(texts: list[bytes], weight: np.ndarray) -> list[np.ndarray]:
    """Per text: words, code points in words, symbols, repeated lines, repeated words, score."""
    g, m = Grams(texts, len(weight)), len(texts)
    total, chars = np.zeros(m, np.int64), np.zeros(m, np.int64)
    np.add.at(total, g.gram_text, weight[g.bucket].astype(np.int64))
    np.add.at(chars, g.text, g.length)
    grams = np.bincount(g.gram_text, minlength=m)
    marks = np.flatnonzero(_symbol[np.minimum(g.points, 127)])
    marks = np.bincount(np.searchsorted(g.first_point, marks, "right") - 1, minlength=m)
    lines = [[x for x in t.split(b"\n") if x.strip(SPACES)] for t in texts]
    return [g.count, chars, marks, np.array([len(x) - len(set(x)) for x in lines]), repeated_words(Words(texts, SPACED)), total // np.maximum(grams, 1)]


def score_task(weights, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([_column(part, "doc"), *[pa.array(c, pa.int64()) for c in measures(texts, weights.value)]], schema=schema)
    return run


def buckets_for(size: int) -> int:
    """The power of two at or above sqrt(size), between LEAST and MOST."""
    b = LEAST
    while b < MOST and b * b < size:
        b *= 2
    return b


def train(docs: DataFrame, trusted: DataFrame, text: str = "text", id: str = "doc_id", trusted_id: str | None = None):
    """The weights (int32 per bucket, broadcast) from counts over all documents and all trusted ones."""
    d = packed(docs, text, id).select("doc", "body")
    size = d.agg(F.coalesce(F.sum(F.octet_length("body").cast("long")), F.lit(0))).first()[0]
    buckets = buckets_for(size)
    ids = land(trusted.select(F.col(f"`{trusted_id or id}`").alias("doc")).dropna().distinct())
    spot = F.pmod(F.xxhash64("doc"), F.lit(SIEVE)).alias("spot")
    good = d.withColumn("spot", spot).join(F.broadcast(ids.select(spot).distinct()), "spot", "left_semi").join(ids.hint("merge"), "doc", "left_semi")
    parts = [x.select("body").mapInArrow(count_task(buckets, _arrow(COUNTS)), COUNTS).select("bucket", r.alias("raw"), t.alias("trusted"))
             for x, r, t in ((d, F.col("n"), F.lit(0)), (good, F.lit(0), F.col("n")))]
    c = land(parts[0].unionByName(parts[1]).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")))
    raw, good = c.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("trusted"), F.lit(0))).first()
    expected = F.col("raw").cast("double") * F.lit(float(good)) / F.lit(float(max(raw, 1)))
    w = c.select("bucket", F.floor(F.lit(1e6) * F.log((F.col("trusted") + F.lit(float(PRIOR))) / (expected + F.lit(float(PRIOR))))).cast("int").alias("w")).toArrow()
    weights = np.zeros(buckets, np.int32)
    weights[w.column("bucket").to_numpy()] = w.column("w").to_numpy()
    return d.sparkSession.sparkContext.broadcast(weights)


def failed() -> Column:
    """Too few words, or too many inside repeated three-word windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def judge(docs: DataFrame, weights, text: str = "text", id: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """doc, the counts, ``score`` (millionths of a nat an n-gram), ``base_failed``, ``kept``: one row per document."""
    d = packed(docs, text, id).select("doc", "body")
    ddl = SCORES.format(id=d.schema["doc"].dataType.simpleString())
    s = d.mapInArrow(score_task(weights, _arrow(ddl)), ddl).withColumn("base_failed", failed())
    return s.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def keep_good(docs: DataFrame, weights, text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the verdict keeps, all columns as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, text):
            n, _, _, _, repeat, score = measures(texts, weights.value)
            yield part.filter(pa.array((n >= MIN_WORDS) & (100 * repeat <= MAX_REPEAT * n) & (score >= threshold)))
    return docs.mapInArrow(run, docs.schema)


SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
size as (select sum(strlen(text)) as bytes from d),
b as (select min(2 ** k)::bigint as buckets from size, range(16, 23) as r(k) where 2 ** k * 2 ** k >= bytes or k = 22),
u as (select w, list_reduce(list_prepend(0::bigint, list_transform(regexp_extract_all(w, '(?s).'), lambda c: unicode(c)::bigint)),
                            lambda a, c: (a * 1000003 + c) % 2147483647) as h from (select distinct unnest(w) as w from d)),
o as (select doc_id, unnest(w) as w, generate_subscripts(w, 1) as i from d),
p as (select doc_id, i, h, lead(h) over (partition by doc_id order by i) as h2 from o join u using (w)),
g as (select doc_id, h % buckets as bucket from p, b union all select doc_id, ((h * 69069 + h2 + 1) % 2147483647) % buckets from p, b where h2 is not null),
t as (select bucket, count(*) as raw, count(*) filter (doc_id in (select doc_id from labels where quality = 1)) as good from g group by bucket),
m as (select sum(raw) as raw, sum(good) as good from t),
x as (select bucket, floor(1000000.0::double * ln((t.good + 10.0::double) / (t.raw::double * m.good::double / m.raw::double + 10.0::double)))::bigint as weight from t, m),
s as (select doc_id, floor(sum(weight)::double / count(*)) as score, sum(weight)::bigint as total, count(*) as n from g join x using (bucket) group by doc_id),
l as (select doc_id, count(line) - count(distinct line) as dup from (select doc_id, unnest(string_split(text, chr(10))) as line from d)
      where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
v as (select doc_id, i, w, lead(w) over k as w2, lead(w, 2) over k as w3 from o window k as (partition by doc_id order by i)),
r as (select doc_id, i, count(*) over (partition by doc_id, w, w2, w3) as c from v where w3 is not null),
c as (select doc_id, count(distinct i + j) as repeat from r, unnest(range(0, 3)) as q(j) where c >= 2 group by doc_id),
f as (select d.doc_id, len(w) as n_words, coalesce(len(array_to_string(w, '')), 0) as word_chars,
             len(text) - len(translate(text, '#*$%&|<>', '')) as n_symbols, coalesce(dup, 0) as n_dup_lines, coalesce(repeat, 0) as n_repeat_words,
             len(w) < 50 or 100 * coalesce(repeat, 0) > 50 * len(w) as base_failed, coalesce((total - ((total % n) + n) % n) // n, 0) as score
      from d left join l using (doc_id) left join c using (doc_id) left join s using (doc_id))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
       n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and score >= -90000 as kept, score::bigint as score from f
"""
