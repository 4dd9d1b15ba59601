"""Secret scan: three base patterns, and password values by guess cost.

The base patterns are matched leftmost and non-overlapping per kind; matches that fail their length test are dropped after they
have used up their text. On top, a value in a credential context ("password is ...", "pwd: ...") is a secret when guessing it would be
expensive: a dynamic program finds the cheapest segmentation into words, dates, repeats, keyboard walks, sequences, pronounceable spans
and brute-force characters, in log10 guesses, and values at or over ``MIN_COST`` count (kind ``guess``). Words are ranked by a short fixed list and, behind
it, by how often the documents use them (``common_words``: the ``TOP`` most frequent, counted over all documents, so at most about 1 MB is sent to the tasks). A guess span
that lies inside a base span is not repeated; a value that is a call or an index expression (``get(x)``, ``env[``) is no literal.

The program is the exact minimum over values of any length in one pass: repeats (units of up to ``UNIT`` characters), walks and sequences are carried along as open
runs, of which only starts that can still win are kept; pronounceable spans are a sliding minimum. It stops once no segmentation can stay under the threshold.

Cases: a null or empty text has no spans; texts and values of any length are read whole; repeated rows get equal results; equal ranks are decided by code-point
order; positions count code points; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator, Mapping
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import land
from .common import packed
from .spelling import vocabulary

# fixed values: the base patterns
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "guess")
HINTS = ("pass", "pwd", "secret", "token", "api", "credential", "login", "pin")

# a key word anywhere in an identifier (db_password, secretKey, MYSQL_PWD); the short ones only at the end of a part (dbpass, PIN_CODE, not passenger)
KEY = re.compile(r"(?i:pass(?:word|wd|phrase|code|key)|pwd|secret|token|api[_ -]?key|credential|login)|(?i:pass|pin)(?![A-Za-z])|(?:[Pp]ass|[Pp]in)(?=[A-Z])")
CONTEXT = re.compile(r"([A-Za-z0-9_-]*+)[\"'`]?\s*+(?:is|was|=>|->|:=|[:=])\s*+[\"'`]?([^\s\"'`<>]{6,})")
IDENTIFIER = re.compile(r"[A-Za-z0-9_-]*+")
MIN_COST, UNIT, TOP, JOIN = 10.0, 24, 20_000, 0.3
CODE = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*[(\[]")

# fixed values: frequent password words, most frequent first
WORDS = ("password pass admin root user login welcome secret letmein qwerty dragon monkey master shadow sunshine princess football baseball "
         "summer winter spring autumn hello freedom whatever trust love money test guest default changeme example required invalid optional "
         "http https www com org net html token key none null true false undefined incorrect expired missing wrong unknown empty reset server system service account").split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
# fixed values: rows of common keyboards, and letters that stand for others
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "qwertzuiopü", "azertyuiop")
LEET = str.maketrans("4@3105$7!", "aaeiosstl")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d")
VOWELS = set("aeiouyäöüáéíóúñèê")
_NEXT: dict[str, set[str]] = {}
for _row in ROWS:
    for _a, _b in zip(_row, _row[1:]):
        _NEXT.setdefault(_a, set()).add(_b)
        _NEXT.setdefault(_b, set()).add(_a)


def _case(s: str) -> float:
    """log10 ways to write the word's capitals."""
    if s.islower() or not s.isalpha():
        return 0.0
    return 0.3 if s[0].isupper() and s[1:].islower() or s.isupper() else min(len(s), 8) * 0.3


def _dir(a: str, b: str) -> int:
    for row in ROWS:
        if a in row and b in row:
            return row.index(b) - row.index(a)
    return 0


def _alphabet(s: str) -> int:
    """Number of characters an attacker has to try per place."""
    n = 10 * any(c.isdigit() for c in s) + 26 * any(c.islower() for c in s) + 26 * any(c.isupper() for c in s) + 33 * any(not c.isalnum() for c in s)
    return max(n, 10)


class Runs:
    """Open starts of one kind of run; a run of m characters costs its start's key plus log10(m / unit)."""

    def __init__(self, unit: int, least: int):
        self.unit, self.least, self.open = unit, least, []

    def step(self, start: int, key: float, end: int) -> float:
        """One more character, up to ``end``; adds a start and returns the cheapest key with its length."""
        log = math.log10
        keep: list[tuple[float, int]] = []
        for k, i in [*self.open, (key, start)]:
            # later starts gain on an earlier one as lengths grow alike: one that has not won by now never will, unless its own key is lower
            if not any(k - k1 >= log((end - i1) / (end - i)) for k1, i1 in keep):
                if end - i >= self.least:
                    keep = [(k1, i1) for k1, i1 in keep if k1 < k]
                keep.append((k, i))
        self.open = keep
        return min((k + log((end - i) / self.unit) for k, i in keep if end - i >= self.least), default=math.inf)


def _one(c: str) -> str:
    low = c.lower()
    return low if len(low) == 1 else c


def guess_cost(value: str, stop: float = math.inf, rank: Mapping[str, int] = RANK) -> float:
    """Minimum log10 guesses over all segmentations, ``JOIN`` more for each segment behind the first; at least ``stop`` if it is not less.

    Words: log10(rank + 1), 0.5 for look-alike digits, their capitals; dates 4.2 (a year 2.1); a unit repeated: its brute-force cost and log10 of the times; walks 1.7,
    0.5 a turn; sequences 1.4, both and log10 of the length; three or more pronounceable letters: 4 + 0.2 each (a vowel, no four consonants in a row);
    capitals in walks and pronounceable spans: 0.3 for a first one and for each change.
    """
    n = len(value)
    low = "".join(map(_one, value))
    plain = low.translate(LEET)
    per = math.log10(_alphabet(value))
    longest = max(map(len, rank), default=0)
    cost, capital = [0.0], [c.isupper() for c in value]
    change = [0, *accumulate(a != b and value[i].isalpha() and value[i + 1].isalpha() for i, (a, b) in enumerate(zip(capital, capital[1:])))]
    repeats = [Runs(u, max(3, 2 * u)) for u in range(1, min(UNIT, n // 2) + 1)]
    walk, steps = Runs(1, 3), {d: Runs(1, 3) for d in (-2, -1, 0, 1, 2)}
    turns, before = 0, None  # of the walk up to here, and the direction of its last step
    spoken: deque[tuple[float, int]] = deque()  # starts of pronounceable spans, keys rising
    waiting: deque[tuple[float, int]] = deque()  # starts with no vowel, or less than three letters, behind them yet
    least_start, vowel, consonants = 0, -1, 0
    for j in range(n):
        end = j + 1
        at = cost[j]
        best = at + per
        enter = lambda i: cost[i] + (JOIN if i else 0)
        for i in range(max(0, end - longest), j):
            w = low[i:end]
            r = rank.get(w)
            s = 0.0
            if r is None and (r := rank.get(plain[i:end])) is not None:
                s = 0.5
            if r is not None:
                best = min(best, enter(i) + math.log10(r + 1) + _case(value[i:end]) + s)
        if value[j].isdigit():
            for i in range(max(0, end - 10), end - 3):
                if DATE.fullmatch(value, i, end):
                    best = min(best, enter(i) + (2.1 if end - i == 4 else 4.2))
        for u, run in enumerate(repeats, 1):
            if j >= u and value[j] == value[j - u]:
                best = min(best, run.step(j - u, enter(j - u) + u * math.log10(_alphabet(value[j - u : j])), end))
            elif run.open:
                run.open = []
        if j:
            a, b = low[j - 1], low[j]
            if a == b or b in _NEXT.get(a, ()):
                way = _dir(a, b)
                turns += before is not None and way != before
                before = way
                best = min(best, walk.step(j - 1, enter(j - 1) + 1.7 - 0.5 * turns - 0.3 * (change[j - 1] - capital[j - 1]), end) + 0.5 * turns + 0.3 * change[j])
            else:
                walk.open, before = [], None
            for d, run in steps.items():
                if ord(value[j]) - ord(value[j - 1]) == d:
                    best = min(best, run.step(j - 1, enter(j - 1) + 1.4, end))
                elif run.open:
                    run.open = []
        c = low[j]
        if c.isalpha():
            waiting.append((enter(j) + 4 - 0.2 * j - 0.3 * (change[j] - capital[j]), j))
            consonants = 0 if c in VOWELS else consonants + 1
            vowel = vowel if consonants else j
            if consonants > 3:
                least_start = j - 2
            while waiting and waiting[0][1] <= min(vowel, j - 2):
                k = waiting.popleft()
                while spoken and spoken[-1][0] >= k[0]:
                    spoken.pop()
                spoken.append(k)
            while spoken and spoken[0][1] < least_start:
                spoken.popleft()
            while waiting and waiting[0][1] < least_start:
                waiting.popleft()
            if spoken:
                best = min(best, spoken[0][0] + 0.2 * end + 0.3 * change[j])
        else:
            spoken.clear(), waiting.clear()
            least_start, vowel, consonants = end, -1, 0
        cost.append(best)
        if best >= stop and min(cost[max(0, end - max(longest, 10)) :]) >= stop:
            # segments that are still open: none may have begun cheaply enough
            began = [i for r in (*repeats, walk, *steps.values()) for _, i in r.open] + [i for _, i in (*spoken, *waiting)] + list(range(max(0, end - 2 * UNIT), end))
            if min(cost[i] for i in began) >= stop:
                return stop
            if stop < math.inf and min((k for r in (*repeats, *steps.values()) for k, _ in r.open), default=math.inf) >= stop and not walk.open and min(
                    [k + 0.2 * end + 0.3 * change[j] for k, _ in (*spoken, *waiting)], default=math.inf) >= stop and min(cost[max(0, end - 2 * UNIT) :]) >= stop:
                return stop
    return cost[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base kinds."""
    low = text.lower()
    out = []
    if any(k in low for k in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    # only maximal runs are long enough, so asking for the length at once finds the same ones
    out += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(out)


_LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)


def guess_spans(text: str, base: list[tuple[int, int, int]], min_cost: float = MIN_COST, rank: Mapping[str, int] = RANK) -> list[tuple[int, int, int]]:
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    out = []
    starts, reach = [x[0] for x in base], list(accumulate((x[2] for x in base), max))
    run = used = 0  # ends of the last identifier looked at and of the last value found
    for key in KEY.finditer(text):
        if key.end() <= run:
            continue
        m = CONTEXT.match(text, key.end())
        if m is None:
            run = IDENTIFIER.match(text, key.end()).end()
            continue
        run = m.end(1)
        value = m.group(2).rstrip(".,;:!?)]}")
        start, end = m.start(2), m.start(2) + len(value)
        i = bisect_right(starts, start)
        if len(value) < 6 or start < used or i and reach[i - 1] >= end or CODE.match(value):
            continue
        if guess_cost(value, min_cost, rank) >= min_cost:
            out.append((start, 3, end))
            used = end
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan_task(schema: pa.Schema, min_cost: float, words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = RANK | {w: len(RANK) + i + 1 for i, w in enumerate(words.value) if w not in RANK}
        for b in batches:
            n, digest, spans = ([], [], []), [], []
            for v in b.column(b.schema.get_field_index("body")):
                text = v.as_py() or ""
                base = base_spans(text)
                for k in range(3):
                    n[k].append(sum(s[1] == k for s in base))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + guess_spans(text, base, min_cost, rank)))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc")), *(pa.array(x, pa.int64()) for x in n),
                                              pa.array(digest, pa.string()), pa.array(spans, pa.string())], schema=schema)
    return run


def common_words(docs: DataFrame, text: str = "text", id: str = "doc_id", top: int = TOP) -> list[str]:
    """The ``top`` most frequent words of four to twenty letters, counted over all documents."""
    v = land(vocabulary(docs, text, id, min_len=4, min_count=5).filter(F.length("word") <= 20))
    least, held = 0, 0
    for power, n in sorted(v.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().collect(), reverse=True):  # 63 rows at most
        least, held = 1 << power, held + n
        if held >= top:
            break
    # so only words at least as frequent as a power of two that leaves about ``top`` of them are sorted
    return [r[0] for r in v.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(top).select("word").collect()]


def scan_secrets(docs: DataFrame, text: str = "text", id: str = "doc_id", min_cost: float = MIN_COST, words: list[str] | None = None) -> DataFrame:
    """doc, n_assign, n_access, n_hex, base_sha256, spans: one row per document. ``words``: most frequent first; None counts them here."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    words = docs.sparkSession.sparkContext.broadcast(common_words(docs, text, id) if words is None else words)
    d = packed(docs, text, id).select("doc", "body")
    ddl = f"doc {d.schema['doc'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return d.mapInArrow(scan_task(to_arrow_schema(StructType.fromDDL(ddl)), min_cost, words), ddl)
