"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of each language in a bounded sample of labelled rows, at most
`train_rows` of a language, chosen by a hash of the id. The log-probabilities are a matrix
of BUCKETS rows and one column per language: its size doesn't depend on the data, and it is
broadcast. Scoring is sparse: a text's n-grams select rows of the matrix, which numpy adds
up a batch at a time. Texts are lower-cased, and runs of characters that aren't letters
become one space. Whole texts are scored, long ones in segments that carry the last characters on, so
that no n-gram is lost between them. All languages are equally likely beforehand. More than MOST_LANGUAGES
labels raise a ValueError, as the matrix would have no bound.

A text that is null or has no letter is "und" with score 0. Ties go to the language that
sorts first. Without any labelled text everything is "und". The score is the posterior
probability of the predicted language among the learned ones only: it is near 1 for nearly any
text of more than a few words, so `keep_identified` in effect rejects texts without letters and
near ties, not texts in a language that was not learned, nor letter noise. Repeated rows are scored alike. An empty table
gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offertide.llm.common import sparing

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 15
TRAIN_ROWS = 8_000
SMOOTHING = 0.5
SEGMENT = 1 << 18
BATCH_GRAMS = 1 << 18
"""A batch is scored whenever it has so many n-grams, whatever the length of its texts."""
MOST_LANGUAGES = 500
"""More labels than this are not languages; the matrix would no longer be small."""

UNKNOWN = "und"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages
    prior: np.ndarray


class _Grams:
    """Turns texts into bucket numbers of their n-grams."""

    def __init__(self, orders: tuple[int, ...], buckets: int) -> None:
        self.orders, self.shift = orders, np.uint64(64 - int(buckets).bit_length() + 1)
        every = np.arange(0x110000, dtype=np.uint32)
        self.letter = np.fromiter((chr(c).isalpha() for c in every), bool, len(every))

    def has_letter(self, text: str) -> bool:
        return any(map(str.isalpha, text))

    def segments(self, text: str):
        """Bucket numbers of the n-grams of `text`, a part at a time."""
        carried = np.zeros(0, np.uint64)
        for at in range(0, len(text), SEGMENT):
            codes = np.frombuffer(text[at:at + SEGMENT].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            codes = np.where(self.letter[codes], codes, np.uint32(32))
            blank = codes == 32
            after_blank = np.r_[bool(len(carried)) and carried[-1] == 32, blank[:-1]]
            codes = np.r_[carried, codes[~(blank & after_blank)].astype(np.uint64)]
            yield self.buckets(codes, len(carried))
            carried = codes[max(0, len(codes) - max(self.orders) + 1):]

    def buckets(self, codes: np.ndarray, known: int) -> np.ndarray:
        """Of the n-grams that end after the first `known` characters."""
        out, rolled = [], np.zeros(len(codes), np.uint64)
        for n in range(1, max(self.orders) + 1):
            if len(codes) < n:
                break
            rolled = (rolled[:len(codes) - n + 1] + codes[n - 1:]) * _MULTIPLIER
            if n in self.orders:
                new = rolled[max(0, known - n + 1):]
                out.append((new ^ (new >> np.uint64(29))) * _MULTIPLIER >> self.shift)
        return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
          train_rows: int = TRAIN_ROWS, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> Model:
    """Fit on at most about `train_rows` rows of each label of `labelled`; null labels and texts don't count."""
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(label_col).count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0))
    draw = F.pmod(F.xxhash64(F.lit("train"), F.col(id_col)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    share = F.element_at(F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, train_rows / sizes[k])))]), F.col(label_col))
    sample = rows.where(draw < share).select(F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    column = {k: i for i, k in enumerate(languages)}

    def count(batches):
        grams, sums = _Grams(orders, buckets), np.zeros((len(languages), buckets), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for label, text in zip(part.column("label").to_pylist(), part.column("text").to_pylist(), strict=True):
                    for got in grams.segments(text):
                        sums[column[label]] += np.bincount(got, minlength=buckets)
        which, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_pydict({"which": pa.array(which), "bucket": pa.array(bucket), "n": pa.array(sums[which, bucket])})

    counts = sample.mapInArrow(sparing(count), "which long, bucket long, n long").groupBy("which", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow()  # at most languages x buckets rows
    table = np.full((buckets, len(languages)), SMOOTHING)
    table[got.column("bucket").to_numpy(), got.column("which").to_numpy()] += got.column("n").to_numpy()
    weights = np.log(table) - np.log(table.sum(axis=0))
    return Model(languages, weights.astype(np.float32), np.zeros(len(languages)))


def predict(df: DataFrame, model: Model, text_col: str = "text", orders: tuple[int, ...] = ORDERS,
            inside: str | None = None) -> DataFrame:
    """`df` with lang_pred and score added; its own columns stay. The text is a field of column `inside`, if that is named."""
    names = [c for c in df.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((model.languages, model.weights, model.prior))

    def score(batches):
        languages, weights, prior = shared.value
        grams, by_language = _Grams(orders, len(weights)), np.ascontiguousarray(weights.T)

        def add(totals, owners, held):
            """One product of the batch's n-gram counts with the matrix: its rows, summed over each text's stretch."""
            cells = np.concatenate(held)
            starts = np.r_[0, np.cumsum([len(h) for h in held])[:-1]]
            for k, column in enumerate(by_language):
                np.add.at(totals[:, k], owners, np.add.reduceat(column[cells], starts, dtype=np.float64))

        def judge(texts):
            known = np.array([t is not None and bool(languages) and grams.has_letter(t) for t in texts], bool)
            totals = np.tile(prior, (len(texts), 1))
            owners, held, size = [], [], 0
            for i in np.flatnonzero(known):
                for got in grams.segments(texts[i]):
                    if len(got):
                        owners.append(i)
                        held.append(got)
                        size += len(got)
                    if size >= BATCH_GRAMS:
                        add(totals, owners, held)
                        owners, held, size = [], [], 0
            if held:
                add(totals, owners, held)
            if not languages:
                return [UNKNOWN] * len(texts), np.zeros(len(texts))
            best = totals.argmax(axis=1)
            top = totals[np.arange(len(texts)), best]
            scores = np.where(known, 1.0 / np.exp(totals - top[:, None]).sum(axis=1), 0.0)
            return [languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], scores

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(text_col) if inside is None else pc.struct_field(part.column(inside), text_col)
                labels, scores = judge(texts.to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in names], pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                    names=[*names, "lang_pred", "score"])

    return df.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(sparing(score), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """A third of the ids, which training never sees."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def language_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the rows that aren't held out; one row per row of `df` with its prediction."""
    labelled = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    model = train(labelled.where(~held_out("_id")), "_id", "_text", "_lang")
    out = predict(df.select(F.col(id_col).alias(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text")), model, "_text")
    return out.drop("_text")


def keep_identified(df: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str = "lang") -> DataFrame:
    """The rows whose language has a posterior of at least `least` among the learned ones, as they are."""
    labelled = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    model = train(labelled.where(~held_out("_id")), "_id", "_text", "_lang")
    wide = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_all"))
    return predict(wide, model, text_col, inside="_all").where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("_all.*")
