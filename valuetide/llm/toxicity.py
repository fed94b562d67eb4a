"""Toxicity severity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the learning sample: documents per flag.
SAMPLE_ROWS = 1500
#: A feature is used if so many sample documents have it, if its share differs between flags by so many standard errors and by such a factor.
LEAST_DOCS, LEAST_Z, LEAST_RATIO = 5, 4.0, 3.0
#: Letters of a word's stem feature.
STEM = 4

_LETTERS = re.compile(r"[^\W\d_]+")
_OUTPUT = "doc_id long, severity double, p_toxic double, grade int, toxic boolean"


def words_of(text: str | None) -> set[str]:
    """Distinct runs of letters, lower-cased."""
    return set(_LETTERS.findall(text.lower())) if text else set()


def features_of(text: str | None) -> set[str]:
    """Distinct words and, of longer words, stems (marked with a hyphen)."""
    words = words_of(text)
    return words | {w[:STEM] + "-" for w in words if len(w) > STEM}


@dataclass
class OrdinalModel:
    """P(grade >= k) = logistic(sum of the weights of the features present - threshold k), weights shared by all k."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def score(self, text: str | None) -> tuple[float, float, int]:
        """(expected grade, probability of a grade above 0, most likely grade)."""
        if not self.thresholds:
            return 0.0, 0.0, 0
        get = self.weights.get
        words = words_of(text)
        stems = {w[:STEM] for w in words if len(w) > STEM}
        total = sum(sorted(v for v in [get(w, 0.0) for w in words] + [get(s + "-", 0.0) for s in stems] if v))
        above = 1 / (1 + np.exp(np.clip(np.array(self.thresholds) - total, -40, 40)))
        each = -np.diff(np.concatenate(([1.0], above, [0.0])))
        return float(above.sum()), float(above[0]), int(each.argmax())


def select_features(texts: list[str | None], flags: np.ndarray) -> list[str]:
    """Features that differ clearly between flagged and other documents. Only counts are held, not the documents' features."""
    n1, n0 = int(flags.sum()), int((~flags).sum())
    with_flag, without = Counter(), Counter()
    for text, flag in zip(texts, flags):
        (with_flag if flag else without).update(features_of(text))
    chosen = []
    for name in with_flag.keys() | without.keys():
        a, b = with_flag[name], without[name]
        if a + b < LEAST_DOCS:
            continue
        p1, p0, p = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1), (a + b) / (n1 + n0)
        z = abs(a / n1 - b / n0) / max(np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)), 1e-12)
        if z >= LEAST_Z and max(p1 / p0, p0 / p1) >= LEAST_RATIO:
            chosen.append(name)
    return sorted(chosen)


def grades_from_flags(hits: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Grade 0 without the flag; with it, 1 below and 2 from the median number of indicative features on."""
    if not flags.any():
        return np.zeros(len(flags), int)
    middle = np.median(hits[flags])
    return np.where(flags, 1 + (hits > middle), 0)


def fit_ordinal(row: np.ndarray, col: np.ndarray, n_features: int, grades: np.ndarray, steps: int = 400, rate: float = 0.1, shrink: float = 1e-3):
    """(weights, thresholds) that minimise the mean ordinal log loss; (row, col) are the features present."""
    levels = int(grades.max())
    n = len(grades)
    # params: weights, the first threshold, logarithms of the gaps to the next ones
    params = np.zeros(n_features + levels)
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        weights, low, gaps = params[:n_features], params[n_features], np.exp(params[n_features + 1 :])
        cuts = low + np.concatenate(([0.0], np.cumsum(gaps)))
        total = np.bincount(row, weights[col], n)
        above = 1 / (1 + np.exp(np.clip(cuts[None, :] - total[:, None], -40, 40)))
        ext = np.concatenate((np.ones((n, 1)), above, np.zeros((n, 1))), axis=1)
        slope = ext * (1 - ext)
        at = np.arange(n)
        a, b = slope[at, grades], slope[at, grades + 1]
        p = np.maximum(ext[at, grades] - ext[at, grades + 1], 1e-12)
        d_total = -(a - b) / p / n
        d_cut = np.zeros(levels + 2)
        np.add.at(d_cut, grades, a / p / n)
        np.add.at(d_cut, grades + 1, -b / p / n)
        d_cut = d_cut[1:-1]
        tail = np.cumsum(d_cut[::-1])[::-1]
        grad = np.concatenate((np.bincount(col, d_total[row], n_features) + shrink * weights, [tail[0]], tail[1:] * gaps))
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        params = params - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    gaps = np.exp(params[n_features + 1 :])
    return params[:n_features], params[n_features] + np.concatenate(([0.0], np.cumsum(gaps)))


def fit(texts: list[str | None], flags: list[bool], grades: list[int] | None = None) -> OrdinalModel:
    """A model from whole texts with flags, or with grades from 0 up (flag: grade above 0)."""
    flag = np.array(flags, bool)
    if not flag.any() or flag.all():
        return OrdinalModel()
    chosen = select_features(texts, flag)
    place = {name: k for k, name in enumerate(chosen)}
    found = [sorted(place[x] for x in features_of(t) if x in place) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    col = np.array([k for f in found for k in f], int)
    rising = np.array([0.0] * len(chosen))
    share = flag.mean()
    if len(col):
        rising = (np.bincount(col, flag[row], len(chosen)) / np.bincount(col, minlength=len(chosen)) > share).astype(float)
    hits = np.bincount(row, rising[col] if len(col) else None, len(texts))
    graded = np.array(grades, int) if grades is not None else grades_from_flags(hits, flag)
    weights, cuts = fit_ordinal(row, col, len(chosen), graded)
    return OrdinalModel({name: float(w) for name, w in zip(chosen, weights)}, [float(c) for c in cuts])


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", flag_col: str = "toxic") -> OrdinalModel:
    """Fit on at most ``rows`` labelled documents per flag, the same ones at every run.

    A document with several labels has the greatest of them.
    """
    flags = labels.where(F.col(flag_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(flag_col) > 0).alias("_flag"))
    order = [F.xxhash64("_id"), F.col("_id")]
    sample = flags.where("_flag").orderBy(*order).limit(rows).unionByName(flags.where("NOT _flag").orderBy(*order).limit(rows))
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id").collect()  # twice ``rows`` at most
    found.sort(key=lambda r: (r["_id"], r["_text"] or ""))
    return fit([r["_text"] for r in found], [r["_flag"] for r in found])


def score_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, severity, p_toxic, grade, toxic`` of every whole text of ``docs``.

    ``severity`` is the expected grade, ``toxic`` says that a grade above 0 is at least as likely
    as grade 0. Null and empty texts have no feature and get the score of the thresholds alone; an
    empty model (no labels, or only one kind) calls nothing toxic. Repeated rows each get their
    row, other columns are ignored. There is no shuffle; the model that goes to the tasks is
    bounded by the learning sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for batch in batches:
            got = []
            for at in range(0, batch.num_rows, 256):
                got += [score(t) for t in batch.column(1).slice(at, 256).to_pylist()]
            severity, p, grade = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(severity, pa.float64()), pa.array(p, pa.float64()), pa.array(grade, pa.int32()), pa.array([x >= 0.5 for x in p], pa.bool_())],
                ["doc_id", "severity", "p_toxic", "grade", "toxic"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _OUTPUT)


def drop_toxic_rows(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text the model does not call toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield part.filter(pa.array([score(t)[1] < 0.5 for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
