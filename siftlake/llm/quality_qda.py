"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text is reduced to a few statistics, transformed by logs and log-odds.
Per class, count, sum and sum of outer products are added up over all labelled
training rows, in each Arrow batch and then over the batches, so no rows are
collected.  Class covariances are shrunk towards the pooled one and towards a
multiple of the identity; their Cholesky factors are computed once and kept in
the model.  The margin is the difference of the two Mahalanobis log-densities
plus the log prior odds.  As the statistics are not Gaussian, margins are too
sure of themselves: one training fold is kept for calibration, its margins are
counted by label in a histogram, and a score is the logistic of the straight
line through the margin that fits these counts best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, on_workers, release, text_slices

# Byte classes that are counted (non-ASCII characters by their first byte).
_CLASSES = {
    "lower": range(97, 123),
    "upper": range(65, 91),
    "digit": range(48, 58),
    "space": (9, 11, 12, 13, 32),
    "line": (10,),
    "stop": b".?!;:",
    "comma": b",'\"-()",
    "bar": b"|",
    "symbol": b"#*$%&<>@^_=+~/\\[]{}`",
    "shout": b"!?",
    "wide": range(192, 256),
    "character": (*range(128), *range(192, 256)),
}
_BY_BYTE = np.zeros((256, len(_CLASSES)))
for _k, _members in enumerate(_CLASSES.values()):
    _BY_BYTE[list(_members), _k] = 1
FEATURES = ("log_words", "log_word_length", "log_word_length_spread", "upper", "digit", "space", "stop", "comma", "bar", "symbol", "shout", "wide", "short_words", "log_line_words", "repeated_lines", "variety", "top_word", "entropy")


def _odds(part: np.ndarray | float, whole: np.ndarray | float) -> float:
    """Log-odds of a share, smoothed by half a count."""
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def statistics(text: bytes | None) -> list[float]:
    """The transformed statistics of one whole text; of an empty one for null."""
    text = text or b""
    by_byte = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    c = dict(zip(_CLASSES, by_byte @ _BY_BYTE, strict=True))
    n_chars = c["character"]
    words = text.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    p = by_byte[by_byte > 0] / max(1, len(text))
    return [
        float(np.log1p(n)),
        float(np.log1p(lengths.mean())) if n else 0.0,
        float(np.log1p(lengths.std())) if n else 0.0,
        _odds(c["upper"], c["upper"] + c["lower"]),
        _odds(c["digit"], n_chars),
        _odds(c["space"], n_chars),
        _odds(c["stop"], n_chars),
        _odds(c["comma"], n_chars),
        _odds(c["bar"], n_chars),
        _odds(c["symbol"], n_chars),
        _odds(c["shout"], n_chars),
        _odds(c["wide"], n_chars),
        _odds(int((lengths <= 3).sum()), n),
        float(np.log1p(n / max(1, len(lines)))),
        _odds(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(len(seen)) - np.log1p(n)),
        _odds(max(seen.values(), default=0), n),
        float(-(p * np.log(p)).sum()),
    ]


@dataclass
class QuadraticDiscriminant:
    """Two classes with shrunk covariances; ``fit`` takes class moments."""

    shrink_pooled: float = 0.2
    shrink_identity: float = 0.005
    prior_weight: float = 1.0
    line: tuple[float, float] = (1.0, 0.0)
    _means: list[np.ndarray] = field(default_factory=list)
    _factors: list[np.ndarray] = field(default_factory=list)
    _offsets: list[float] = field(default_factory=list)

    def fit(self, counts: np.ndarray, sums: np.ndarray, outers: np.ndarray) -> QuadraticDiscriminant:
        """``counts`` (2), ``sums`` (2, d), ``outers`` (2, d, d).  With fewer than two rows of a class every score is the smoothed share of class 1."""
        d = sums.shape[1]
        self._log_odds = float(np.log(counts[1] + 1) - np.log(counts[0] + 1)) * self.prior_weight
        if min(counts) < 2:
            return self
        means = sums / counts[:, None]
        scatter = outers - counts[:, None, None] * means[:, :, None] * means[:, None, :]
        pooled = scatter.sum(axis=0) / max(1, counts.sum() - 2)
        # all statistics are brought to one scale, so that the identity means the same for each
        self._scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        pooled = pooled / np.outer(self._scale, self._scale)
        for k in (0, 1):
            own = scatter[k] / (counts[k] - 1) / np.outer(self._scale, self._scale)
            mixed = (1 - self.shrink_pooled) * own + self.shrink_pooled * pooled
            shrunk = (1 - self.shrink_identity) * mixed + self.shrink_identity * np.trace(mixed) / d * np.eye(d)
            factor = np.linalg.cholesky(shrunk + 1e-9 * np.eye(d))
            self._means.append(means[k] / self._scale)
            self._factors.append(np.linalg.inv(factor))
            self._offsets.append(-float(np.log(np.diag(factor)).sum()))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of ``x``."""
        slope, offset = self.line
        return 1 / (1 + np.exp(-np.clip(slope * self.margin(x) + offset, -500, 500)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1 before calibration."""
        difference = np.full(len(x), self._log_odds)
        if self._means:
            for k, sign in ((0, -1.0), (1, 1.0)):
                z = (x / self._scale - self._means[k]) @ self._factors[k].T
                difference += sign * (self._offsets[k] - 0.5 * np.einsum("ij,ij->i", z, z))
        return difference

    def calibrate(self, margins: np.ndarray, counts: np.ndarray) -> QuadraticDiscriminant:
        """Fit the line to ``counts`` (n, 2) of labels at ``margins`` by Newton's method, with targets smoothed by a count of one.

        Nothing changes without counts of both labels; the line never falls.
        """
        total = counts.sum(axis=0)
        if not self._means or min(total) < 1:
            return self
        low, high = 1 / (total[0] + 2), (total[1] + 1) / (total[1] + 2)
        weight, hits = counts.sum(axis=1), counts[:, 0] * low + counts[:, 1] * high
        scale = max(1.0, float(np.abs(margins[weight > 0]).max()))
        z = np.stack([margins / scale, np.ones(len(margins))], axis=1)
        at = np.array([0.0, np.log(hits.sum() / (weight.sum() - hits.sum()))])

        def loss(w: np.ndarray) -> float:
            v = z @ w
            return float((weight * np.logaddexp(0, v) - hits * v).sum() + 1e-6 * w @ w)

        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ at, -500, 500)))
            gradient = z.T @ (weight * p - hits) + 2e-6 * at
            step = np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + 2e-6 * np.eye(2), gradient)
            size = 1.0
            while size > 1e-6 and loss(at - size * step) > loss(at):
                size /= 2
            at = at - size * step
            if np.abs(size * step).max() < 1e-9:
                break
        if at[0] > 0:
            self.line = (float(at[0] / scale), float(at[1]))
        return self


#: Margins are counted to a quarter between these bounds.
_MARGIN_STEP, _MARGIN_STEPS = 0.25, 2000


def _margins(rows: DataFrame, model: QuadraticDiscriminant) -> tuple[np.ndarray, np.ndarray]:
    """Margins, and how many rows of each label in ``rows(x, label)`` have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            margin = model.margin(np.array(batch.column(0).flatten()).reshape(-1, len(FEATURES)))
            at = np.clip(np.rint(margin / _MARGIN_STEP), -_MARGIN_STEPS, _MARGIN_STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], names=["at", "label"])

    counts = np.zeros((2 * _MARGIN_STEPS + 1, 2))
    for at, label, n in on_workers(rows).mapInArrow(run, "at int, label int").groupBy("at", "label").count().collect():  # a row a step and label at most
        counts[at + _MARGIN_STEPS, label] = n
    return np.arange(-_MARGIN_STEPS, _MARGIN_STEPS + 1) * _MARGIN_STEP, counts


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class counts, sums and sums of outer products of ``rows(x, label)``; one small row a batch is added up by Spark."""
    d = len(FEATURES)
    size = 2 * (1 + d + d * d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            x = np.array(batch.column(0).flatten()).reshape(-1, d)
            label = np.array(batch.column(1))
            parts = []
            for k in (0, 1):
                own = x[label == k]
                parts += [np.array([len(own)], dtype=float), own.sum(axis=0), (own.T @ own).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(np.concatenate(parts))], names=["at", "value"])

    added = dict(on_workers(rows).mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value")).collect())  # a fixed number of rows
    flat = np.array([added.get(i, 0.0) for i in range(size)]).reshape(2, -1)
    return flat[:, 0], flat[:, 1 : 1 + d], flat[:, 1 + d :].reshape(2, d, d)


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", folds: int = 5, cut: float = 0.3, model: QuadraticDiscriminant | None = None) -> DataFrame:
    """``id, held_out, score, predicted`` for every row of ``docs``.

    Rows whose ``crc32`` of the id as text is a multiple of ``folds`` are held out;
    all other rows with a label 0 or 1 are learned from, those of remainder 1 for
    calibration (``folds`` is at least 3).  Several labels of one id count as
    their least; null labels and ids teach nothing (a null id is not held
    out).  A null or empty text is scored like any other.  Repeated rows each
    give a row; other columns are not read; without labels of both classes
    every score is the smoothed share of class 1 (0.5 without any).
    """
    model = model or QuadraticDiscriminant()
    id_type = docs.schema[id_column].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            rows = [statistics(t) for _, _, texts in text_slices(batch.column(1)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["id", "x"])

    measured = on_workers(docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))).mapInArrow(measure, f"id {id_type}, x array<double>")
    fold = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(folds))
    measured = materialize(measured.withColumn("held_out", F.coalesce(fold == 0, F.lit(False))))
    known = labels.filter(F.col(label_column).isin(0, 1)).groupBy(F.col(id_column).alias("id")).agg(F.min(label_column).cast("int").alias("label"))
    learned = measured.filter("not held_out").join(known, "id")
    fitted = model.fit(*_moments(learned.filter(fold != 1).select("x", "label")))
    fitted = fitted.calibrate(*_margins(learned.filter(fold == 1).select("x", "label"), fitted))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = fitted.score(np.array(batch.column(2).flatten()).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= cut).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    return on_workers(measured.select("id", "held_out", "x")).mapInArrow(judge, f"id {id_type}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_column)
