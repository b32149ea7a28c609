"""Language identification: multinomial naive Bayes over hashed character n-grams.

`fit` counts hashed n-grams per label in tasks, adds the counts up by (label, feature) and keeps one matrix of
log-probabilities; its size is labels x FEATURES floats, checked against MOST_LABELS. `predict` broadcasts that matrix
and scores whole texts in numpy batches, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factbase.llm.words import lean_stream, mix, pieces, utf8

FEATURES = 1 << 15
ORDERS = (1, 2, 3, 4)
MOST_LABELS = 1000        # 131 MB of matrix
STEP = 2 << 20            # bytes of text that are scored at a time
UNKNOWN = "und"
_KEYS = mix(np.arange(11, 11 + max(ORDERS), dtype=np.uint64)) | np.uint64(1)


@dataclass
class LanguageModel:
    labels: list[str]
    weights: np.ndarray   # labels x FEATURES log-probabilities
    prior: np.ndarray     # log-probability of each label


def _letters() -> np.ndarray:
    """Lower case of code points below 0x3000; everything that is no letter there becomes a space."""
    return np.array([ord(c.lower()[0]) if (c := chr(i)).isalpha() else 32 for i in range(0x3000)], np.uint32)


def _points(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row and where each text begins."""
    data, offsets = utf8(column)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    small = points < len(table)
    return np.where(small, table[np.where(small, points, 0)], points), heads[offsets]


def _grams(points: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the feature of the n-gram from each code point on, and FEATURES where it leaves its text."""
    n = len(points)
    for order in ORDERS:
        code = np.zeros(n, np.uint64)
        for j in range(min(order, n)):
            code[: n - j] += points[j:] * _KEYS[j]
        code ^= code >> np.uint64(31)
        code *= _KEYS[order - 1]
        feature = (code >> np.uint64(49)).astype(np.int32)
        for j in range(1, order):  # the last order - 1 of each text
            at = first[1:] - j
            feature[at[at >= first[:-1]]] = FEATURES
        yield feature


def fit(docs: DataFrame, label: str = "lang", text: str = "text", where: Column | None = None,
        id_col: str = "doc_id", max_rows_per_label: int = 20_000, smoothing: float = 0.5) -> LanguageModel:
    """Learn from rows with a label and a text.

    Of each label about `max_rows_per_label` rows are used at most, chosen by a hash of `id_col`; their texts are
    counted whole. Rows without id, label or text teach nothing. Without any row the model has no labels.
    """
    spark = docs.sparkSession
    known = docs.select(F.col(id_col).alias("i"), F.col(label).cast("string").alias("l"), F.col(text).alias("t"),
                        (where if where is not None else F.lit(True)).alias("w"))
    known = known.where("w and i is not null and l is not null and t is not null")
    sizes = sorted((r["l"], r["n"]) for r in known.groupBy("l").agg(F.count("*").alias("n"))
                   .limit(MOST_LABELS + 1).collect())
    if len(sizes) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    labels = [x for x, _ in sizes]
    if not labels:
        return LanguageModel([], np.zeros((0, FEATURES), np.float32), np.zeros(0))
    scale = 1 << 20
    share = F.create_map(*[F.lit(v) for x, n in sizes
                           for v in (x, min(scale, max(1, scale * max_rows_per_label // n)))])
    chosen = known.where(F.pmod(F.xxhash64("i", F.lit("fit")), F.lit(scale)) < share[F.col("l")])
    number = {x: i for i, x in enumerate(labels)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, total = _letters(), np.zeros(len(labels) * (FEATURES + 1), np.int64)
        for batch in batches:
            kinds = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for a, b in pieces(batch.column(1), STEP):
                points, first = _points(batch.column(1).slice(a, b - a), lower)
                base = np.repeat(kinds[a:b] * (FEATURES + 1), np.diff(first))
                for feature in _grams(points, first):
                    total += np.bincount(base + feature, minlength=len(total))
        kind, feature = np.divmod(np.flatnonzero(total), FEATURES + 1)
        inside = feature < FEATURES
        kind, feature = kind[inside], feature[inside]
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind, pa.int32()), pa.array(feature, pa.int32()),
             pa.array(total.reshape(len(labels), -1)[kind, feature], pa.int64())], names=["kind", "feature", "n"])

    summed = (chosen.select("l", "t").mapInArrow(lean_stream(count), "kind int, feature int, n long")
              .groupBy("kind", "feature").agg(F.sum("n").alias("n")).toArrow())
    counts = np.zeros((len(labels), FEATURES))
    counts[summed["kind"].to_numpy(), summed["feature"].to_numpy()] = summed["n"].to_numpy()
    weights = np.log((counts + smoothing) / (counts.sum(1, keepdims=True) + smoothing * FEATURES))
    rows = np.array([n for _, n in sizes], float)
    return LanguageModel(labels, weights.astype(np.float32), np.log(rows / rows.sum()))


def predict(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """`keep` columns (doc_id) of each row, lang_pred, score (posterior probability of lang_pred).

    A null text, a text without a letter and every text under a model without labels get `und` with score 0. Equal
    posteriors go to the label that sorts first. Columns beside `keep` and `text` are not looked at.
    """
    keep = ["doc_id"] if keep is None else keep
    own = [c for c in keep if c != text]  # the text goes through the tasks once
    source = docs.select(*[F.col(c) for c in own], F.col(text).rlike(r"\p{L}").alias("__any"), F.col(text).alias("__text"))
    kept = source.schema.fields[:-2] + ([docs.schema[text]] if text in keep else [])
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast((model.labels, model.weights, model.prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, weights, prior = held.value
        weights = np.concatenate([weights, np.zeros((len(labels), 1), np.float32)], axis=1)
        lower = _letters()
        for batch in batches:
            for a, b in pieces(batch.column(batch.num_columns - 1), STEP):
                part = batch.slice(a, b - a)
                best, score = [UNKNOWN] * (b - a), np.zeros(b - a)
                if labels:
                    points, first = _points(part.column(part.num_columns - 1), lower)
                    sums = np.tile(prior, (b - a, 1))
                    full = np.flatnonzero(np.diff(first))
                    for feature in _grams(points, first) if len(full) else []:
                        for i in range(len(labels)):
                            sums[full, i] += np.add.reduceat(weights[i][feature], first[full], dtype=np.float64)
                    top = sums.argmax(1)
                    sums = np.exp(sums - sums.max(1, keepdims=True))
                    score = sums[np.arange(b - a), top] / sums.sum(1)
                    some = part.column(part.num_columns - 2).fill_null(False).to_numpy(zero_copy_only=False)
                    best = [labels[t] if ok else UNKNOWN for t, ok in zip(top.tolist(), some.tolist())]
                    score = np.where(some, score, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-2], *([part.columns[-1]] if text in keep else []), pa.array(best, pa.string()), pa.array(score, pa.float64())],
                    names=[f.name for f in schema.fields])

    return source.mapInArrow(lean_stream(run), schema).select(*keep, "lang_pred", "score")
