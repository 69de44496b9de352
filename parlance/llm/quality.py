"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight for each hashed text feature is shared by all grades; ordered
thresholds cut the score into grades: P(grade > k) = sigmoid(score - theta_k).
The expected grade and the tail probabilities serve for selection.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes

BITS = 18
#: Labelled documents of each grade that the model is fitted on, the first by a hash of the id.
SAMPLE = 4000
#: A feature counts if its rate in a lower grade is higher by so many standard errors.
LEAST_Z = 8.0
#: A document is kept if its probability of the top grade is at least this share of a text's with nothing against it.
KEEP = 0.65
#: Words whose weights a worker remembers.
MEMORY = 500_000


def word_features(word: bytes) -> tuple[int, ...]:
    """Hashed features of a word: itself, its first 4 and 6 letters, and its shape."""
    lower = word.lower()
    digest = xxhash.xxh32_intdigest
    most = (1 << BITS) - 1
    shape = b"%d%d%d" % (word.isupper(), word[-1:].isalnum() or word[-1] > 127, sum(c < 128 and not 48 <= c < 58 and not 65 <= (c & 95) < 91 for c in word[-4:]))
    return tuple({digest(lower, 1) & most, digest(lower[:4], 2) & most, digest(lower[:6], 3) & most, digest(shape, 4) & most})


def form_features(words: list[bytes]) -> tuple[int, ...]:
    """How many tenths of the words, if any, repeat the one before; and how few tenths of 20 or more words are distinct, under five."""
    if len(words) < 2:
        return ()
    again = 10 * sum(map(operator.eq, words, words[1:])) // len(words)
    distinct = 10 * len(set(words)) // len(words) if len(words) >= 20 else 9
    digest, most = xxhash.xxh32_intdigest, (1 << BITS) - 1
    return tuple([digest(b"%d" % k, 5) & most for k in range(1, again + 1)] + [digest(b"%d" % k, 6) & most for k in range(distinct, 5)])


def text_features(text: bytes) -> np.ndarray:
    """The distinct features of a text: of its words, and of its form."""
    words = text.split()
    found = set(form_features(words))
    for w in set(words):
        found.update(word_features(w))
    return np.array(sorted(found), np.int32)


def grade(quality: str = "quality", toxic: str = "toxic"):
    """Graded rating of a label: 0 for low quality, 1 for good text that is toxic, 2 for good text; null without a quality."""
    return F.when(F.col(quality) == 0, 0).when(F.col(quality) == 1, F.when(F.coalesce(F.col(toxic), F.lit(0)) == 1, 1).otherwise(2))


@dataclass
class OrdinalModel:
    """Weights by feature and ordered thresholds; ``bias`` is the score of a text without features."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -40, 40)))

    def least_tail(self, keep: float = KEEP) -> float:
        """The probability of the top grade from which documents are kept; a text with nothing against it always is."""
        return float(keep * self.tails(np.zeros(1))[0, -1])


def fit_ordinal(features: list[np.ndarray], grades: np.ndarray, steps: int = 300, ridge: float = 0.3, rate: float = 0.1, levels: int = 3) -> OrdinalModel:
    """Penalized maximum likelihood by full-batch Adam; every grade weighs the same.

    Features count that are more frequent in a lower grade by ``LEAST_Z``
    standard errors; all others have weight zero.  Weights are at most zero: a
    text's features can speak against it, but more words don't speak for it,
    so scores don't grow with the length.  If fewer than two of the ``levels``
    grades have examples, nothing speaks against any text: all weights are
    zero, and so are the scores.
    """
    if len(np.unique(grades)) < 2:
        return OrdinalModel(np.zeros(1 << BITS), np.arange(levels - 1) - float(levels - 1))
    n = np.array([max(1, (grades == g).sum()) for g in range(levels)], float)
    counts = np.zeros((levels, 1 << BITS))
    for f, g in zip(features, grades, strict=True):
        counts[g, f] += 1
    keep = np.zeros(1 << BITS, bool)
    for a in range(levels):
        for b in range(a):
            p = (counts[a] + counts[b]) / (n[a] + n[b])
            se = np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n[a] + 1 / n[b]))
            keep |= (counts[b] / n[b] - counts[a] / n[a] > LEAST_Z * se) & (counts[a] + counts[b] >= 5)
    kept = [f[keep[f]] for f in features]
    flat = np.concatenate(kept).astype(np.int64) if kept else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(kept)), [len(k) for k in kept])
    weight = (1 / n)[grades] / levels
    w, m, v = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(1 << BITS)
    # Thresholds as the first one and the logarithms of the gaps stay ordered.
    t = np.concatenate([[-1.0], np.zeros(levels - 2)])
    tm, tv = np.zeros_like(t), np.zeros_like(t)
    for step in range(1, steps + 1):
        theta = t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))])
        score = np.bincount(owner, w[flat], len(kept))
        above = 1 / (1 + np.exp(-np.clip(score[:, None] - theta, -40, 40)))
        full = np.concatenate([np.ones((len(score), 1)), above, np.zeros((len(score), 1))], axis=1)
        rows = np.arange(len(score))
        upper, lower = full[rows, grades], full[rows, grades + 1]
        prob = np.maximum(upper - lower, 1e-12)
        # d log P / d score, with slope p (1 - p) at either cut
        ds = weight * (upper * (1 - upper) - lower * (1 - lower)) / prob
        gw = -np.bincount(flat, ds[owner], 1 << BITS) + ridge * w / len(kept)
        gtheta = np.zeros(levels - 1)
        np.add.at(gtheta, np.minimum(grades, levels - 2), np.where(grades < levels - 1, -weight * lower * (1 - lower) / prob, 0))
        np.add.at(gtheta, np.maximum(grades - 1, 0), np.where(grades > 0, weight * upper * (1 - upper) / prob, 0))
        gt = np.concatenate([[gtheta.sum()], [gtheta[k:].sum() * np.exp(t[k]) for k in range(1, levels - 1)]])
        for x, g, first, second in ((w, gw, m, v), (t, gt, tm, tv)):
            first *= 0.9
            first += 0.1 * g
            second *= 0.999
            second += 0.001 * g * g
            x -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        w[~keep] = 0
        np.minimum(w, 0, out=w)
    return OrdinalModel(w, t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> OrdinalModel:
    """The model of a bounded, reproducible sample of the labelled documents.

    Of each grade the ``sample`` ids with the smallest hash are taken.  An id
    with several labels has its lowest grade, one with several rows the text
    whose features come first; labels without a quality or of ids that ``docs``
    lacks don't count.  Only features reach the driver, of ``3 * sample``
    documents at most.  Without documents or labels, or with those of one grade
    only, all texts score 0 (:func:`fit_ordinal`) and none is rejected.
    """
    rated = labels.select(F.col(id_col).alias("id"), grade().alias("grade")).dropna().groupBy("id").agg(F.min("grade").alias("grade"))
    chosen = None
    for g in range(3):
        part = rated.where(F.col("grade") == g).orderBy(F.xxhash64("id"), "id").limit(sample)
        chosen = part if chosen is None else chosen.unionAll(part)
    # 3 * sample ids at most
    joined = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                packed = pa.array([text_features(t).tobytes() for t in part.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("grade"), packed], names=["id", "grade", "features"])

    rows = joined.mapInArrow(run, "id long, grade int, features binary").groupBy("id").agg(F.min("grade").alias("grade"), F.min("features").alias("features")).toArrow().sort_by([("id", "ascending"), ("grade", "ascending")])
    features = [np.frombuffer(f, np.int32) for f in rows.column("features").to_pylist()]
    return fit_ordinal(features, np.array(rows.column("grade").to_pylist(), np.int64))


def _scorer(model: OrdinalModel):
    """A function from texts to scores: each distinct feature of a text counts once."""
    weights = model.weights
    nonzero = weights != 0
    memory: dict[bytes, tuple[int, ...]] = {}

    def score(texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            words = text.split()
            found = {f for f in form_features(words) if nonzero[f]}
            for w in set(words):
                got = memory.get(w)
                if got is None:
                    got = tuple(f for f in word_features(w) if nonzero[f])
                    if len(memory) >= MEMORY:
                        memory.clear()
                    memory[w] = got
                if got:
                    found.update(got)
            out[i] = weights[sorted(found)].sum() if found else 0.0
        return out

    return score


def score_documents(df: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, expected_grade, p_above_0, p_above_1, ..., grade) of every row.

    ``grade`` is the likeliest one.  A null or empty text has no features and
    the score 0.  Repeated rows are scored alike; other columns don't matter;
    an empty table gives no rows.
    """
    k = len(model.thresholds)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = f"id long, score double, expected_grade double, {', '.join(f'p_above_{i} double' for i in range(k))}, grade int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                s = score(part.column("text").to_pylist())
                tails = shared.value.tails(s)
                full = np.concatenate([np.ones((len(s), 1)), tails, np.zeros((len(s), 1))], axis=1)
                best = (full[:, :-1] - full[:, 1:]).argmax(axis=1).astype(np.int32)
                cols = [part.column("id"), pa.array(s), pa.array(tails.sum(axis=1)), *(pa.array(tails[:, i].copy()) for i in range(k)), pa.array(best)]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "score", "expected_grade", *(f"p_above_{i}" for i in range(k)), "grade"])

    out = df.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def keep_good(df: DataFrame, model: OrdinalModel, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of ``df``, with all columns, whose probability of the top grade is high enough (:meth:`OrdinalModel.least_tail`).

    A null or empty text has the score 0, like one of unknown words only, and
    is kept.  Repeated rows are judged alike; columns of any name are kept as
    they are; an empty table gives no rows.
    """
    least = model.least_tail(keep)
    shared = df.sparkSession.sparkContext.broadcast(model)
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).withColumn("text", text_bytes(f"c{df.columns.index(text_col)}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                p = shared.value.tails(score(part.column("text").to_pylist()))[:, -1]
                yield part.select(part.schema.names[:-1]).filter(pa.array(p >= least))

    return numbered.mapInArrow(run, numbered.drop("text").schema).toDF(*df.columns)
