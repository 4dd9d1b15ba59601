"""Line de-duplication: lines found in many documents go from every document.

Explode normalised lines, hash them (128 bits), count distinct documents per hash, drop lines over the threshold,
reassemble the others by position. Only hashes and positions are shuffled for the count; the text moves at most once,
in the join that brings each document its dropped positions.

Cases: a null or empty text is one empty line; an empty key (only spaces) is never dropped unless ``min_key`` is 0;
repeated rows of one id count once; rows with a null id count together as one document; equal rows get equal results;
an empty table gives an empty result; extra columns stay inside ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import land
from .common import LOWER, UPPER, hash_pair, packed, row_keys

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def frequent_lines(d: DataFrame, min_docs: int, min_key: int) -> DataFrame:
    """(h1, h2) of the keys that occur in at least ``min_docs`` documents."""
    key = d.select("doc", F.explode(F.split("body", "\n", -1)).alias("line")).select("doc", line_key(F.col("line")).alias("key"))
    occ = key.filter(F.length("key") >= min_key).select(F.coalesce(F.xxhash64("doc"), F.lit(0)).alias("doc"), *hash_pair(F.col("key")))
    return occ.groupBy("h1", "h2").agg(F.countDistinct("doc").alias("docs")).filter(F.col("docs") >= min_docs).select("h1", "h2")


def dedup_lines(docs: DataFrame, text: str = "text", id: str = "doc_id", min_docs: int = 10, min_key: int = 1) -> DataFrame:
    """``row`` (the input row), ``n_lines``, ``n_dropped``, ``kept`` (the text without the frequent lines)."""
    d = packed(docs, text, id).select("*", *row_keys())
    frequent = land(frequent_lines(d, min_docs, min_key))
    at = d.select("k1", "k2", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
    at = at.select("k1", "k2", "pos", *hash_pair(line_key(F.col("line"))))
    drop = at.join(frequent, ["h1", "h2"], "left_semi").groupBy("k1", "k2").agg(F.collect_set("pos").alias("drop"))
    j = d.select("row", "k1", "k2", F.split("body", "\n", -1).alias("lines")).join(drop, ["k1", "k2"], "left")
    keep = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("drop", F.array().cast("array<int>")))
    whole = F.array_join("lines", "\n")
    return j.select("row", F.size("lines").cast("long").alias("n_lines"),
                    F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
                    F.when(F.col("drop").isNull(), whole)
                    .otherwise(F.array_join(F.transform(keep, lambda i: F.get("lines", i)), "\n")).alias("kept"))


SQL = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (f.key is not null) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (f.key is null), '')) as kept_sha256
from k left join f on k.key = f.key group by doc_id
"""
