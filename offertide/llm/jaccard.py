"""Near duplicates: an exact n-gram Jaccard self-join with PartEnum signatures.

A document's set holds the hashes of its five-word shingles. Two sets of sizes a and b link
when 100 * |both| >= 75 * |either|, that is, when they differ in at most (a + b) / 7
elements; the sizes then are within a factor of 4/3, and either set of size s differs from a partner
in at most s / 3 elements.

Signatures. Sizes fall into levels; within one, the domain of hashes is cut into the same
number of ranges, and a set's part in a range is a signature of that range. An element in which two sets
differ spoils one range, so of N ranges at least N - H hold equal parts. If all sets
put their parts in one common order, two linked sets must share a part among the first
H + 1 of each, so only floor(s / 3) + 1 subsets are enumerated. The order prefers parts
that tell much: parts with an element that isn't common in a bounded sample come first, then larger
parts; empty parts come last. A set whose larger partner may be in the next level is enumerated there too.
The order and the sample change the work, never the result.

Links. Sets with a signature in common are tied to one of them, their leader, then once more to
leaders drawn anew where a signature is still shared by more than one component. Where that leaves
components apart, every pair of a signature's sets from different components counts, if at most
HOT_MEMBERS sets share it. The sets of more common signatures, such as those of a template, are enumerated
once more, by the rarest elements among them: for each band of partners' sizes, so many that two linked sets must
share one. Sets that have little but the template in common don't meet there. All pairs are
first held against a sketch of one parity bit for each range of a finer cut: sets differ in at least as many elements as sketches
differ in bits. Where signatures or rare elements meet, the join itself does so: the comparisons may grow with the square of a
family of unlinked variants, the rows that leave the join don't. Pairs that pass are checked on the sets themselves. So no link between
components is lost, though a group of thousands of copies is never expanded into pairs.
Equal sets are one node from the start. Memory: a task holds one chunk of signatures and
one leader for each distinct signature of its bucket, whatever the size of a group.

Words are split at ASCII white space and lower-cased in A-Z. Fewer than five words make one shingle
of their own kind. Null or wordless texts are empty and linked with nothing. A component is named by
its smallest id; null ids don't name one unless they are alone. Repeated rows share a node. Whole
texts count, however long. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offertide.llm.common import attach_groups, connected, sparing, written
from offertide.llm.exact_dedup import known_slots, marked

WORDS = 5
NUMERATOR, DENOMINATOR = 3, 4
"""The similarity 0.75. The bounds below are written for it."""

FIRST_LEVEL = 64
RATIO = 4
SMALL_RANGES = 1 << 16
"""Ranges for sets under FIRST_LEVEL elements: so many that their elements are alone."""

SAMPLE_ROWS = 10_000
COMMON_ROWS = 8
MOST_COMMON = 200_000
"""Elements in COMMON_ROWS of about SAMPLE_ROWS sampled rows are common; at most MOST_COMMON are kept."""

DRAWS = 4
"""Leaders drawn for a signature that several components share."""

BRIEF = 16
LEAST_BUCKETS = 16
BUCKET_BYTES = 8 << 20
"""Text for each bucket of signatures, so that a task's share stays the same however large the table is.
Signatures of many documents travel packed, in one row for each bucket."""

HOT_MEMBERS = 256
"""Sets behind one signature from which they are compared by their rarest elements and not pair by pair."""
BANDS = 20
"""Bands of set sizes for each factor of e, that is, some 5 % wide."""

CHUNK = 1_000_000
PACKED = 1 << 17
"""Signatures, a megabyte, that a task collects before it sends them to their buckets."""
REMEMBERED = 200_000
KNOWN_WORDS = 200_000
"""Word hashes that a worker keeps, some 40 MB."""

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text."""

    def __init__(self) -> None:
        self.known = _WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        codes = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        width = min(WORDS, len(words))
        rolled = np.full(len(codes) - width + 1, width, np.uint64)
        for k in range(width):
            rolled = (rolled + codes[k:len(codes) - width + 1 + k]) * _ODD
            rolled ^= rolled >> np.uint64(32)
        return np.unique(_mixed(rolled))


def node_of(shingles: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()))))


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """Parities of the elements in each of a power of two of ranges, at least four times as many as elements."""
    bits = 64
    while bits < 4 * len(shingles):
        bits *= 2
    counts = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def levels_of(size: int) -> list[tuple[int, int]]:
    """(level, ranges) in which a set of this size is enumerated."""
    level, top, ranges = 0, FIRST_LEVEL, SMALL_RANGES
    while size >= top:
        level, ranges, top = level + 1, 2 * top, top * RATIO
    out = [(level, ranges)]
    if size * DENOMINATOR // NUMERATOR >= top:
        out.append((level + 1, 2 * top))
    return out


def _tag(level: int, empty: int) -> np.uint64:
    """Keeps levels, and empty parts, apart: ranges are fewer than 2 ** 40."""
    return np.uint64((2 * level + empty + 1) << 40)


def signatures(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The enumerated parts of a set, hashed with their level and range."""
    size = len(shingles)
    if size < 3:  # such a set is linked only with its equals
        return np.zeros(0, np.uint64)
    need, out = size // 3 + 1, []
    rare = np.ones(size, bool)
    if len(common):
        rare = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] != shingles
    mixed = _mixed(shingles ^ _ODD)
    for level, ranges in levels_of(size):
        part = ((shingles >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)  # rises with the hash
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        counts = np.diff(np.r_[starts, size])
        tags = _mixed(part[starts] + _tag(level, 0))
        tokens = _mixed(np.add.reduceat(mixed, starts) ^ tags)
        if len(tokens) > need:
            known = ~np.logical_or.reduceat(rare, starts)
            tokens = tokens[np.lexsort((tokens, -counts, known))[:need]]
        elif len(tokens) < need:  # rare: then the first empty parts count as well
            empty = np.setdiff1d(np.arange(min(ranges, len(tokens) + need), dtype=np.uint64), part[starts])
            tokens = np.r_[tokens, _mixed(empty[:need - len(tokens)] + _tag(level, 1))]
        out.append(tokens)
    return np.concatenate(out)


def _common_elements(texts: DataFrame, n: int, sample_rows: int) -> np.ndarray:
    """Elements of many rows in a bounded sample of the `n` rows, to order parts by."""
    share = min(1.0, sample_rows / max(n, 1))
    some = texts.where(F.pmod(F.col("k"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1)).select("text")

    def elements(batches):
        make = Shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [make(t) for t in batch.column("text").slice(at, 512).to_pylist()]
                yield pa.RecordBatch.from_pydict({"h": pa.array(np.concatenate(sets).view(np.int64))})

    often = some.mapInArrow(sparing(elements), "h long").groupBy("h").count().where(F.col("count") >= COMMON_ROWS)
    got = often.orderBy(F.desc("count"), "h").limit(MOST_COMMON).select("h").toArrow()
    return np.sort(got.column("h").to_numpy().astype(np.int64).view(np.uint64))


def _packed(nodes: list[int], sizes: list[int], parts: list[np.ndarray], buckets: int):
    """(bucket, sets, bytes) with a blob for each bucket: nodes, sizes and counts of its sets, then their signatures."""
    sigs = np.concatenate(parts)
    own = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    to = (sigs >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(to, kind="stable")
    to, own, sigs = to[order], own[order], sigs[order]
    runs = np.flatnonzero(np.r_[True, (to[1:] != to[:-1]) | (own[1:] != own[:-1])])
    ends = np.r_[runs[1:], len(sigs)]
    node, n = np.array(nodes, np.int64)[own[runs]], np.array(sizes, np.int32)[own[runs]]
    counts, place = (ends - runs).astype(np.int32), to[runs]
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    for x, y in zip(first, [*first[1:], len(runs)], strict=True):
        yield int(place[x]), int(y - x), b"".join(
            [node[x:y].tobytes(), n[x:y].tobytes(), counts[x:y].tobytes(), sigs[runs[x]:ends[y - 1]].tobytes()])


def _unpacked(sets: int, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of a blob, each with its node and size."""
    node, n, counts = (np.frombuffer(blob, t, sets, at * sets) for t, at in ((np.int64, 0), (np.int32, 8), (np.int32, 12)))
    return np.frombuffer(blob, np.uint64, offset=16 * sets), np.repeat(node, counts), np.repeat(n, counts).astype(np.int64)


def _enumerate(texts: DataFrame, common: np.ndarray, buckets: int) -> DataFrame:
    """Rows (bucket, k, node, n, sketch) for each document, and packed (bucket, node: number of sets, sigs) for many at once."""
    shared = texts.sparkSession.sparkContext.broadcast(common)
    schema = pa.schema([("bucket", pa.int32()), ("k", pa.int64()), ("node", pa.int64()), ("n", pa.int64()),
                        ("sketch", pa.list_(pa.int64())), ("sigs", pa.binary())])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def emit(batches):
        make, seen, waiting = Shingler(), set(), 0
        nodes, sizes, parts = [], [], []

        def pack():
            yield batch_of([(bucket, 0, sets, 0, None, blob) for bucket, sets, blob in _packed(nodes, sizes, parts, buckets)])

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = []
                for key, text in zip(part.column("k").to_pylist(), part.column("text").to_pylist(), strict=True):
                    shingles = make(text)
                    node, n = node_of(shingles), len(shingles)
                    rows.append((node % buckets, key, node, n, sketch_of(shingles), None))
                    if node in seen:  # a copy of what this task has enumerated
                        continue
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    seen.add(node)
                    sigs = signatures(shingles, shared.value)
                    if len(sigs):
                        nodes.append(node), sizes.append(n), parts.append(sigs)
                        waiting += len(sigs)
                yield batch_of(rows)
                if waiting >= PACKED:
                    yield from pack()
                    nodes, sizes, parts, waiting = [], [], [], 0
        if waiting:
            yield from pack()

    return texts.mapInArrow(sparing(emit), "bucket int, k long, node long, n long, sketch array<long>, sigs binary")


class _Leaders:
    """Ties the nodes of each signature to the first one met, a chunk at a time."""

    def __init__(self) -> None:
        self.sig, self.node, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def tie(self, sig: np.ndarray, node: np.ndarray, n: np.ndarray):
        order = np.lexsort((node, sig))
        sig, node, n = sig[order], node[order], n[order]
        new = np.r_[True, sig[1:] != sig[:-1]]
        keep = new | np.r_[True, node[1:] != node[:-1]]
        sig, node, n, new = sig[keep], node[keep], n[keep], new[keep]
        run = np.cumsum(new) - 1
        first, lead, size = sig[new], node[new], n[new]
        if len(self.sig):
            at = np.minimum(np.searchsorted(self.sig, first), len(self.sig) - 1)
            known = self.sig[at] == first
            lead, size = np.where(known, self.node[at], lead), np.where(known, self.n[at], size)
            order = np.argsort(np.r_[self.sig, first[~known]], kind="stable")
            self.sig, self.node, self.n = (np.r_[a, b[~known]][order] for a, b in (
                (self.sig, first), (self.node, lead), (self.n, size)))
        else:
            self.sig, self.node, self.n = first, lead, size
        other = lead[run] != node
        return sig[other], lead[run][other], size[run][other], node[other], n[other]


def _tie(enumerated: DataFrame, buckets: int) -> DataFrame:
    """Documents (k, node, n, sketch; sig null) and ties (sig, lead, lead_n, node, n) in one stored table."""
    schema = pa.schema([("k", pa.int64()), ("sig", pa.int64()), ("lead", pa.int64()), ("lead_n", pa.int64()),
                        ("node", pa.int64()), ("n", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def reduce(batches):
        leaders: dict[int, _Leaders] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            bucket, sig, node, n = (np.concatenate(c) for c in zip(*held, strict=True))
            for b in np.unique(bucket):
                own = bucket == b
                got = leaders.setdefault(int(b), _Leaders()).tie(sig[own], node[own], n[own])
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(got[0]), pa.int64()), *[pa.array(c.view(np.int64)) for c in got],
                     pa.nulls(len(got[0]), schema.field("sketch").type)], schema=schema)

        for batch in batches:
            raw = batch.column("sigs")
            plain = raw.is_null().to_numpy(zero_copy_only=False)
            if plain.any():
                docs = batch.filter(pa.array(plain))
                empty = pa.nulls(docs.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([docs.column("k"), empty, empty, empty, docs.column("node"), docs.column("n"),
                                                  docs.column("sketch")], schema=schema)
            if not plain.all():
                rows = batch.filter(pa.array(~plain))
                for bucket, sets, blob in zip(*(rows.column(c).to_pylist() for c in ("bucket", "node", "sigs")), strict=True):
                    sig, node, n = _unpacked(sets, blob)
                    held.append((np.full(len(sig), bucket, np.int32), sig, node, n))
                    size += len(sig)
                if size >= CHUNK:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    dealt = enumerated.repartition(buckets, "bucket")
    return written(dealt.mapInArrow(sparing(reduce), "k long, sig long, lead long, lead_n long, node long, n long, sketch array<long>"), "jaccard-ties")


def _near_size(a: str = "a_n", b: str = "b_n") -> str:
    return f"{NUMERATOR} * greatest({a}, {b}) <= {DENOMINATOR} * least({a}, {b})"


def _alike(a: str = "a", b: str = "b") -> str:
    """That the sketches leave a link possible. The longer one is folded to the length of the other."""
    differ = lambda x, y: f"aggregate(zip_with({x}, {y}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    half = lambda x: (f"zip_with(slice({x}, 1, size({x}) div 2), slice({x}, size({x}) div 2 + 1, size({x}) div 2), (x, y) -> x ^ y)")
    x, y = f"{a}_sketch", f"{b}_sketch"
    bits = (f"CASE WHEN size({x}) = size({y}) THEN {differ(x, y)} WHEN size({x}) > size({y}) THEN {differ(half(x), y)} "
            f"ELSE {differ(x, half(y))} END")
    return f"{_near_size(f'{a}_n', f'{b}_n')} AND 7 * ({bits}) <= {a}_n + {b}_n"


class _Checker:
    """Compares pairs of nodes on their sets, each made once from the text of one document."""

    def __init__(self, texts: DataFrame, nodes: DataFrame) -> None:
        self.texts, self.nodes, self.sets = texts, nodes, None

    def fetch(self, asked: DataFrame) -> DataFrame:
        """Stored sets that include those of the distinct nodes `asked(node)`."""
        if self.sets is not None:
            asked = asked.join(self.sets.select("node"), "node", "left_anti")
        new = self._make(written(asked.join(self.nodes.select("node", "k"), "node").select("k"), "jaccard-asked"))
        self.sets = new if self.sets is None else self.sets.union(new)
        return self.sets

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of stored `pairs` that link."""
        self.fetch(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        a = self.sets.select(F.col("node").alias("a"), F.col("set").alias("_x"))
        b = self.sets.select(F.col("node").alias("b"), F.col("set").alias("_y"))
        both = F.size(F.array_intersect("_x", "_y")).cast("long")
        either = F.size("_x").cast("long") + F.size("_y") - both
        return written(pairs.select("a", "b").join(a, "a").join(b, "b").where(
            both * DENOMINATOR >= either * NUMERATOR).select("a", "b"), "jaccard-links")

    def _make(self, wanted: DataFrame) -> DataFrame:
        """Sets of the documents `wanted(k)`. A filter of their keys keeps all other texts from the shuffle."""

        def sets(batches):
            make = Shingler()
            for batch in batches:
                for at in range(0, batch.num_rows, 128):
                    got = [make(t) for t in batch.column("text").slice(at, 128).to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([node_of(s) for s in got], pa.int64()),
                         pa.array([s.view(np.int64) for s in got], pa.list_(pa.int64()))], names=["node", "set"])

        n = wanted.count()
        if not n:
            return wanted.sparkSession.createDataFrame([], "node long, set array<long>")
        words, slots = known_slots(wanted.select(F.col("k").alias("_hash")), n)
        near = marked(self.texts.withColumn("_hash", F.col("k")), words, slots).where("_suspect")
        found = near.join(wanted, "k", "left_semi").select("text")
        return written(found.mapInArrow(sparing(sets), "node long, set array<long>"), "jaccard-sets")


def _with_root(rows: DataFrame, roots: DataFrame, node: str, name: str) -> DataFrame:
    got = roots.select(F.col("node").alias(node), F.col("root").alias(name))
    return rows.join(got, node, "left").withColumn(name, F.coalesce(name, node))


def _with_sketches(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    for x in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch")), x)
    return pairs


def _members(ties: DataFrame) -> DataFrame:
    return ties.select("sig", "node", "n").union(ties.select("sig", F.col("lead").alias("node"), F.col("lead_n").alias("n"))).distinct()


def _mixed_signatures(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Stored (sig, node, n, root) of the signatures in `members(sig, node, n)` that components share; equal memberships once."""
    placed = _with_root(members, roots, "node", "root")
    mixed = placed.groupBy("sig").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("many"),
        F.bit_xor(F.xxhash64("node")).alias("print")).where("low <> high")
    sigs = mixed.groupBy("many", "print").agg(F.min("sig").alias("sig")).select("sig")
    return written(placed.join(sigs, "sig", "left_semi"), "jaccard-mixed")


def _drawn_pairs(mixed: DataFrame, draws: int) -> DataFrame:
    """Pairs (a, b) of nodes with leaders drawn for each signature, if their sizes are near enough."""
    drawn = None
    for salt in range(draws):
        lead = mixed.groupBy("sig").agg(F.min_by(F.struct("node", "root", "n"), F.xxhash64(F.lit(salt), "node")).alias("l"))
        pairs = mixed.join(lead, "sig").where(f"root <> l.root AND {_near_size('l.n', 'n')}").select(
            F.greatest("node", "l.node").alias("a"), F.least("node", "l.node").alias("b"))
        drawn = pairs if drawn is None else drawn.union(pairs)
    return drawn.distinct()


def _remaining_pairs(mixed: DataFrame, nodes: DataFrame, checker: _Checker) -> DataFrame:
    """Pairs (a, b) from different components with a signature in common and brief sketches near enough.

    A node stands here once for each of its signatures, so it carries its sketch folded to
    at most BRIEF words and its first BRIEF signatures; the whole sketches decide afterwards.
    """
    words = (f"transform(sequence(0, {BRIEF - 1}), i -> aggregate(filter(sketch, (x, j) -> j % {BRIEF} = i), 0L, (s, x) -> s ^ x))")
    brief = nodes.selectExpr("node", "n", f"IF(size(sketch) <= {BRIEF}, sketch, {words}) AS sketch")
    hot = written(mixed.groupBy("sig").count().where(F.col("count") > HOT_MEMBERS).select("sig"), "jaccard-hot")
    mixed = mixed.drop("n")
    few = mixed.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, BRIEF).alias("sigs"))
    cold = mixed.join(hot, "sig", "left_anti")
    rows = written(cold.join(brief, "node").join(few, "node"), "jaccard-remaining")
    side = lambda x: rows.select("sig", F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "root", "sketch", "sigs")])
    # Of a pair's common signatures among the first of each, only the first gives the pair; if that is a hot one, it does below.
    once = "sig = coalesce(array_min(array_intersect(a_sigs, b_sigs)), sig)"
    pairs = side("a").join(side("b"), "sig").where(
        f"a > b AND a_root <> b_root AND {_near_size()} AND {once} AND {_alike()}").select("a", "b").distinct()
    if hot.isEmpty():
        return pairs
    members = written(mixed.join(hot, "sig", "left_semi").select("node", "root").distinct().join(brief, "node"), "jaccard-members")
    return pairs.union(_pairs_by_rarest(members, checker.fetch(members.select("node")))).distinct()


def _pairs_by_rarest(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of stored `members(node, root, n, sketch)` that may link, from their rarest elements.

    Linked sets of sizes a and b have t = 3 * (a + b) / 7 elements in common, so in one order of all
    elements they share one among the first a - t + 1 and b - t + 1. The order is by rarity
    among the members. A set stands under each band of sizes that a partner may have, with as many elements
    as the smallest size of that band asks for. Elements of one set alone count in the order only.
    """
    once = sets.dropDuplicates(["node"])  # repeated rows give a set more than once
    held = members.select("node").join(once, "node").select("node", F.explode("set").alias("e"))
    often = written(held.groupBy("e").agg(F.count("*").alias("often")).where("often > 1"), "jaccard-often")
    order = Window.partitionBy("node").orderBy(F.coalesce("often", F.lit(1)), "e")
    ranked = held.join(often, "e", "left").withColumn("place", F.row_number().over(order)).where("often > 1").drop("often")
    band = lambda x: f"CAST(floor({BANDS} * ln({x})) AS INT)"
    least = f"greatest(1, CAST(floor(exp(other / {BANDS}.0D)) AS BIGINT) - 1)"  # at most the smallest size of the band
    other = F.explode(F.expr(f"sequence({band(f'greatest(1, n * {NUMERATOR} div {DENOMINATOR} - 1)')}, {band(f'n * {DENOMINATOR} div {NUMERATOR} + 1')})"))
    placed = ranked.join(members.select("node", "root", "n"), "node").withColumn("other", other).where(
        f"place <= n - (3 * (n + {least}) + 6) div 7 + 1").selectExpr("node", "root", "e", f"{band('n')} AS own", "other")
    key = ["e", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")]
    stored = written(placed.select(*key, "own", "other", "node", "root"), "jaccard-rarest")
    # An element whose holders all look for partners of a size that none of them has gives no pair.
    mixed = stored.groupBy("e", "low", "high").agg(
        F.min("root").alias("r"), F.max("root").alias("s"), F.min("own").alias("least"), F.max("own").alias("most"),
    ).where("r <> s AND least = low AND most = high").select("e", "low", "high")
    rows = written(stored.join(mixed, ["e", "low", "high"], "left_semi").join(members.select("node", "n", "sketch"), "node"), "jaccard-sketched")
    side = lambda x, own, other: rows.select(
        "e", F.col(own).alias("own"), F.col(other).alias("other"), F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "root", "sketch")])
    # The sketches decide where a pair meets, so only pairs that may link become rows.
    return side("a", "own", "other").join(side("b", "other", "own"), ["e", "own", "other"]).where(
        f"a > b AND a_root <> b_root AND {_alike()}").select("a", "b").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of `df`: id, n_shingles, component_id, and _text_hash of the row."""
    return _grouped(df, id_col, text_col, sample_rows).select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", F.col("_id")).alias("component_id"), F.col("k").alias("_text_hash"))


def _grouped(df: DataFrame, id_col: str, text_col: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """_id, k (hash of id and text) and n of each row; of its group, if it has several rows, the first id and k, null ids last."""
    keyed = df.select(F.col(id_col).alias("_id"), F.xxhash64(id_col, text_col).alias("k"), F.col(text_col).alias("text"))
    texts = keyed.select("k", "text")
    rows, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    buckets = LEAST_BUCKETS + size // BUCKET_BYTES
    stored = _tie(_enumerate(texts, _common_elements(texts, rows, sample_rows), buckets), buckets)
    docs = stored.where("sig IS NULL").select("k", "node", "n", "sketch")
    ties = stored.where("sig IS NOT NULL").select("sig", "lead", "lead_n", "node", "n")

    involved = ties.select("node").union(ties.select(F.col("lead").alias("node"))).distinct()
    nodes = written(docs.join(involved, "node", "left_semi").groupBy("node").agg(
        F.min("k").alias("k"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "jaccard-nodes")
    checker = _Checker(texts, nodes)
    check = lambda pairs: checker.links(written(
        _with_sketches(pairs, nodes).where(_alike()).select("a", "b"), "jaccard-pairs"))

    tied = ties.where(_near_size("lead_n", "n")).select(
        F.greatest("lead", "node").alias("a"), F.least("lead", "node").alias("b")).distinct()
    links = check(tied)
    roots = connected(links, rounds=2)
    mixed = _mixed_signatures(_members(ties), roots)
    links = links.union(check(_drawn_pairs(mixed, DRAWS)))
    roots = connected(links, rounds=2)
    # Components only grow, so a signature that they don't share by now stays so.
    mixed = _mixed_signatures(mixed.select("sig", "node", "n"), roots)
    links = links.union(check(_remaining_pairs(mixed, nodes, checker)))
    roots = connected(links)

    total = docs.count()
    named = _with_root(docs.drop("sketch"), roots, "node", "_group")
    ids = written(keyed.select("k", "_id").join(named.dropDuplicates(["k"]), "k"), "jaccard-documents")
    groups = written(ids.where("n > 0").groupBy("_group").agg(
        F.count("*").alias("_n"), F.min("_id").alias("component_id"),
        F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("k").alias("k")))["k"].alias("_kept"),
    ).where("_n > 1"), "jaccard-groups")
    return attach_groups(ids, groups, ["_group"], "_n", total)


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates: the smallest id, null last, then by a hash of the text. Other rows stay."""
    found = _grouped(df, id_col, text_col).where("_kept IS NOT NULL").select("k", (F.col("k") == F.col("_kept")).alias("first"))
    dropped = found.where("NOT first").select(F.col("k").alias("_text_hash")).distinct()
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_all"),
                      F.xxhash64(id_col, text_col).alias("_text_hash"))
    rest = keyed.join(dropped, "_text_hash", "left_anti")
    repeated = written(found.where("first").groupBy(F.col("k").alias("_text_hash")).count().where("count > 1").drop("count"),
                       "jaccard-repeated")
    if not repeated.isEmpty():  # rows with the same id and text
        rest = rest.join(repeated, "_text_hash", "left_anti").unionByName(
            rest.join(repeated, "_text_hash", "left_semi").dropDuplicates(["_text_hash"]))
    return rest.select("_all.*")
