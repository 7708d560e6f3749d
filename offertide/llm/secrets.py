"""Secret scans: fixed patterns, and a guess-cost search for values in credential contexts.

Three patterns give the base spans. Beyond them, a value that stands where a password
belongs (after password, secret, token, pwd, bearer and the like, also at the end of a longer
name, or as the password of a URL) is cut into the pieces that make it cheapest to guess:
words, dates, repeats, keyboard walks and brute force. The cheapest cut is found by dynamic programming over its characters, and
the value is a secret if even that cut takes LEAST_LOG10 or more powers of ten of guesses.
Words are ranked by a short list of frequent passwords, then by the corpus itself: its most frequent
runs of letters, RANKED_WORDS at most, that occur LEAST_SEEN times or more, counted over all texts. That list is all
that passes through the driver. A keyboard walk goes from key to neighbouring key and pays for each turn.
Such spans are of kind "guess"; they never overlap a base span, and base spans stay. Of a
value that a base span covers in part, the rest is a span: scored with the whole value if that
is closed by a quote or is in a URL, and alone otherwise. Unquoted values end at , ; < or >. Quoted values may hold single blanks, unless a
comma, full stop or the like before a blank shows them to be sentences.
Values have no upper length; the search takes time in proportion to it.

Offsets are code points, ends exclusive. A null text is empty and has no spans. Repeated rows
are scanned alike. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offertide.llm.common import written

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # 16 or more in all
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex")

# Where a credential stands besides the base patterns.
CONTEXT = re.compile(
    r"""(?:password|passwd|secret|token|api[_-]?key|(?<![A-Z0-9])(?:pwd|pass|passphrase|passcode|pin_code|credentials?|(?:private|access|client|auth|secret)[_-]?key|bearer))"""
    r"""["']?(?:\x20*[:=]\x20*|\x20+(?<=bearer\x20))(?="((?=[^"]{6})[^\s"]+(?:(?<![.,;:!?])\x20[^\s"]+)*)"|'((?=[^']{6})[^\s']+(?:(?<![.,;:!?])\x20[^\s']+)*)'|["']?([^\s"'<>,;]{6,}))""",
    re.ASCII | re.IGNORECASE)
USERINFO = re.compile(r"://[^\s/:@]+:([^\s/:@]{6,})@")
CONTEXT_WORDS = ("pwd", "pass", "pin_code", "credential", "key", "bearer", "secret", "token")
LEAST_LOG10 = 9.0

# Common words of passwords, by rank.
WORDS = ("password pass secret admin welcome login letmein dragon monkey master shadow sunshine princess "
         "football baseball superman batman trust love hello freedom whatever flower summer winter spring autumn "
         "monday friday january december london paris computer internet server test user root guest demo sample "
         "example change default temp home money star pepper ginger cookie tiger eagle hunter ranger soccer "
         "hockey killer angel jordan michael jennifer thomas robert daniel andrew charlie george jessica "
         "the and for you not with key token qwerty").split()
KEYBOARD_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")

RANKED_WORDS = 20_000
LEAST_SEEN = 20
LONGEST_WORD = 24
"""Words of the corpus that count in a cut: at most so many, so frequent, of 3 to so many letters."""

LONGEST_WALK = 40
"""Keys of one walk; a longer one is several pieces."""

_KEYS = {k: (x, y) for y, row in enumerate(KEYBOARD_ROWS) for x, k in enumerate(row)}
_STEPS = {(1, 0), (-1, 0), (0, 1), (0, -1), (-1, 1), (1, -1)}  # each row stands half a key right of the one above
_LEET = str.maketrans("043157$@!", "oaelstsai")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d")


def word_ranks(corpus_words: Sequence[str] = ()) -> dict[str, int]:
    """Ranks from 1: the fixed list, then `corpus_words` by falling frequency."""
    return {w: r + 1 for r, w in enumerate(dict.fromkeys([*WORDS, *corpus_words]))}


FIXED_RANKS = word_ranks()


def frequent_words(df: DataFrame, text_col: str = "text", most: int = RANKED_WORDS) -> list[str]:
    """The most frequent words of all texts by falling count, ties by the word itself.

    Counts fall into classes, 16 to a doubling. The list holds the highest classes that
    together have at most `most` words, so no task or driver has to hold more.
    """
    found = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"\p{L}+"), F.lit(0))
    words = df.select(F.explode(found).alias("word")).where(F.length("word").between(3, LONGEST_WORD))
    often = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SEEN)
    counted = written(often.withColumn("class", F.floor(16 * F.log2("n"))), "word-counts")
    total, least = 0, None
    for r in sorted(counted.groupBy("class").count().collect(), reverse=True):  # at most 16 classes for each bit of a count
        total += r["count"]
        if total > most:
            break
        least = r["class"]
    if least is None:
        return []
    kept = counted.where(F.col("class") >= F.lit(least)).select("word", "n").collect()
    return [r["word"] for r in sorted(kept, key=lambda r: (-r["n"], r["word"]))]


def _walk_ends(plain: str, i: int):
    """(end, turns) of the keyboard walks of three keys or more that begin at `i`."""
    here, way, turns = _KEYS.get(plain[i]), None, 0
    for j in range(i + 1, min(len(plain), i + LONGEST_WALK)):
        there = _KEYS.get(plain[j])
        if here is None or there is None:
            return
        step = (there[0] - here[0], there[1] - here[1])
        if step not in _STEPS:
            return
        turns += way is not None and step != way
        here, way = there, step
        if j - i >= 2:
            yield j + 1, turns


def guess_cost(value: str, ranks: Mapping[str, int] = FIXED_RANKS) -> float:
    """log10 of the guesses that the cheapest cut of `value` takes."""
    n, plain = len(value), value.lower()
    if len(plain) != n:  # a letter that becomes two when lowered
        plain = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    unleet = plain.translate(_LEET)
    pool = math.log10(sum(size for size, found in (
        (26, re.search("[a-z]", value)), (26, re.search("[A-Z]", value)), (10, re.search("[0-9]", value)),
        (33, re.search("[^A-Za-z0-9]", value))) if found) or 1)
    best, runs = [0.0] + [float("inf")] * n, {}
    for i in range(n):
        here = best[i]
        best[i + 1] = min(best[i + 1], here + pool)  # brute force, one character
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            rank = ranks.get(plain[i:j]) or 2 * ranks.get(unleet[i:j], 0)
            if rank:
                cased = 1 + sum(c.isupper() for c in value[i:j])
                best[j] = min(best[j], here + math.log10(2 * rank * cased) + 1)
        if m := _DATE.match(value, i):
            best[m.end()] = min(best[m.end()], here + math.log10(365 * 120 if m.end() - i > 4 else 120) + 1)
        for width in (1, 2, 3, 4):
            # A repeat that begins later in the same run is tried only where it can be cheaper than
            # the earlier one, so a long run is not walked from each of its characters.
            from_, until = runs.get((width, i % width), (0, 0))
            if i + width <= until and here - best[from_] >= math.log10((i - from_) // width + 1):
                continue
            unit, j = plain[i:i + width], i + width
            if len(unit) < width:
                break
            if width > 1 and (unit == unit[0] * width or unit == unit[:2] * 2):
                continue  # the shorter unit is cheaper
            while plain.startswith(unit, j):
                j += width
                if j - i >= 3:
                    best[j] = min(best[j], here + width * pool + math.log10((j - i) // width) + 0.5)
            runs[width, i % width] = (i, j)
        for j, turns in _walk_ends(plain, i):
            best[j] = min(best[j], here + math.log10(94 * (j - i)) + turns * math.log10(5) + 0.5)
    return float(best[n])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order; kind counts in KINDS."""
    out = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def guessed_spans(text: str, taken: list[tuple[int, int, int]],
                  ranks: Mapping[str, int] = FIXED_RANKS) -> list[tuple[int, int]]:
    """Values in credential contexts that are hard to guess and outside the spans in `taken`."""
    lower, found = text.lower(), []
    if any(w in lower for w in CONTEXT_WORDS):
        found += [(*m.span(m.lastindex), m.lastindex < 3) for m in CONTEXT.finditer(text)]
    if "://" in text and "@" in text:
        found += [(*m.span(1), True) for m in USERINFO.finditer(text)]
    out, last = [], -1
    for a, b, closed in sorted(set(found)):
        if a < last:
            continue
        inside = [(s, e) for s, _, e in taken if s < b and e > a]
        rests, at = [], a
        for s, e in inside:
            if s > at:
                rests.append((at, s))
            at = max(at, e)
        if at < b:
            rests.append((at, b))
        # Where a closing mark shows that all of it is the value, the value counts as a whole.
        hard = bool(rests) and closed and guess_cost(text[a:b], ranks) >= LEAST_LOG10
        more = [(s, e) for s, e in rests if hard or guess_cost(text[s:e], ranks) >= LEAST_LOG10]
        if more:
            out += more
            last = b
    return out


def secret_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: counts of base spans, their digest, and all spans."""
    schema = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
        T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_guess", T.LongType())])

    shared = df.sparkSession.sparkContext.broadcast(frequent_words(df, text_col))

    def scan(batches):
        ranks = word_ranks(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for text in part.column("text").to_pylist():
                    base = base_spans(text or "")
                    more = guessed_spans(text or "", base, ranks)
                    told = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
                    every = sorted([*base, *((a, 3, b) for a, b in more)])
                    rows.append((*[sum(x[1] == k for x in base) for k in range(3)],
                                 hashlib.sha256(told.encode()).hexdigest(),
                                 ",".join(f"{(*KINDS, 'guess')[k]}:{a}:{b}" for a, k, b in every), len(more)))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=schema.names)

    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).mapInArrow(scan, schema)
