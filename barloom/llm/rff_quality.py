"""Quality classifier: a Gaussian kernel over document statistics by random Fourier features.

Every text gives a fixed list of statistics (lengths, shares of kinds of characters, repetition, line
ends). Standardised, they are mapped to ``FEATURES`` cosines whose products approximate a Gaussian
kernel. Each partition of the training rows adds up its normal equations; the sums, of a size that the
input does not change, give the ridge weights. An isotonic regression, fitted by Spark on rows that the
ridge has not seen, turns raw values into probabilities of label 1.

Learning takes a bounded sample of labelled rows (``SAMPLE``, chosen by a hash of the id); scoring reads
every text whole, in one pass and without a shuffle.

Defined results: a NULL text is empty, and empty texts have a score like others; without labelled rows
the score is 0.5; labels other than 0 and 1 and NULL labels are left out; repeated label rows count as
often as they stand there; no rows give no rows; columns with names of result columns are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from barloom.llm.common import release, small_batches, stored
from barloom.llm.string_kernel_lid import sample_rows

#: Labelled rows that are learned from, at most about so many for each label.
SAMPLE = 12_000
FEATURES = 384
RIDGE = 1e-4
SEED = 7
TASKS = 8
THRESHOLD = 0.3

_KIND = np.zeros(256, dtype=np.int64)  # 0: beyond ASCII
_KIND[[*range(0, 33), 127]] = 1
_KIND[48:58] = 2
_KIND[65:91] = 3
_KIND[97:123] = 4
_KIND[[i for i in range(33, 127) if not chr(i).isalnum()]] = 5
_SPACE, _MARK = _KIND == 1, _KIND == 5

STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "distinct_words", "top_word",
    "same_as_before", "beyond_ascii", "spaces", "digits", "upper", "lower", "marks", "top_mark",
    "marks_before_space", "two_marks", "lone_marks", "capital_words", "entropy", "log_line", "line_spread",
    "distinct_lines", "lines_closed", "longest_word",
)


def statistics(text: str | None) -> list[float]:
    """The values named in ``STATISTICS``; zeros for an empty text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    words = (text or "").split()
    if not words:
        return [float(np.log1p(len(raw)))] + [0.0] * (len(STATISTICS) - 1)
    counts = np.bincount(raw, minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=6) / len(raw)
    share = counts[counts > 0] / len(raw)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    tally = Counter(words)
    mark, space = _MARK[raw], _SPACE[raw]
    after = np.append(space[1:], True)
    before = np.append(True, space[:-1])
    lines = text.split("\n")
    line_lengths = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    n = len(words)
    return [
        float(np.log1p(len(raw))), float(np.log1p(n)), float(lengths.mean()), float(lengths.std()), len(tally) / n,
        max(tally.values()) / n, sum(map(str.__eq__, words, words[1:])) / n, kinds[0], kinds[1], kinds[2], kinds[3], kinds[4], kinds[5],
        float(counts[_MARK].max()) / len(raw), float((mark & after).sum()) / n, float((mark[1:] & mark[:-1]).sum()) / n,
        float((mark & after & before).sum()) / n, sum(w[0].isupper() for w in words) / n, float(-(share * np.log2(share)).sum()),
        float(np.log1p(line_lengths.mean())), float(np.log1p(line_lengths.std())), len(set(lines)) / len(lines),
        sum(x[-1:] in (".", "!", "?") for x in lines) / len(lines), float(np.log1p(lengths.max())),
    ]


def statistics_column(text: Column) -> Column:
    """``statistics`` of a text as an array of double."""

    @arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(texts[i].as_py()) for i in range(len(texts))], type=pa.list_(pa.float64()))

    return of(text)


@dataclass(frozen=True)
class Model:
    """What turns statistics into scores."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def features(self, values: np.ndarray) -> np.ndarray:
        flat = np.clip((values - self.mean) / self.scale, -6.0, 6.0)
        return np.hstack([np.cos(flat @ self.waves + self.phases) * np.sqrt(2.0 / len(self.phases)), np.ones((len(flat), 1))])

    def score(self, values: np.ndarray) -> np.ndarray:
        raw = self.features(values) @ self.weights
        return np.clip(np.interp(raw, *self.steps), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model | None:
    """Learns from the rows of ``labels`` where ``learn`` holds (over its columns); None if there are none.

    The sample's ids are bounded (at most twice ``sample`` for each label), so they are broadcast and
    no text is shuffled to meet its label.
    """
    rows = labels.where(learn & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("label"))
    chosen = stored(sample_rows(rows, "label", ["_id"], sample))
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    part = F.pmod(F.xxhash64("_doc", F.lit("calibrate")), F.lit(3)) == 0
    train = texts.select(statistics_column(F.col("_text")).alias("x"), "label", part.alias("held")).limit(4 * sample)
    train = stored(train.repartition(TASKS))
    ridge = train.where("not held")
    moments = ridge.agg(
        F.count("*").alias("n"),
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(STATISTICS))],
        *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(len(STATISTICS))],
    ).first()
    if not moments["n"]:
        return None
    mean = np.array([moments[f"m{i}"] for i in range(len(STATISTICS))])
    spread = np.array([moments[f"s{i}"] for i in range(len(STATISTICS))])
    rng = np.random.default_rng(SEED)
    width = np.sqrt(len(STATISTICS))
    waves = rng.normal(size=(len(STATISTICS), FEATURES)) / width
    phases = rng.uniform(0, 2 * np.pi, FEATURES)
    start = Model(mean, np.where(spread > 1e-9, spread, 1.0), waves, phases, np.zeros(FEATURES + 1), (np.zeros(1), np.zeros(1)))

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            if batch.num_rows:
                z = start.features(matrix(batch.column("x")))
                left += z.T @ z
                right += z.T @ batch.column("label").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()]), pa.array([right.tobytes()])], names=["l", "r"])

    left, right = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
    for row in ridge.select("x", "label").coalesce(TASKS).mapInArrow(sums, "l binary, r binary").collect():  # TASKS rows
        left += np.frombuffer(row["l"]).reshape(left.shape)
        right += np.frombuffer(row["r"])
    weights = np.linalg.solve(left + RIDGE * moments["n"] * np.eye(len(left)), right)
    raw = _column(Model(start.mean, start.scale, waves, phases, weights, (np.array([-1e9, 1e9]), np.array([-1e9, 1e9]))), "raw")
    pairs = train.where("held").select(raw(F.col("x")).alias("raw"), "label")
    if not pairs.head(1):
        pairs = ridge.select(raw(F.col("x")).alias("raw"), "label")
    pairs = pairs.select("label", array_to_vector(F.array("raw")).alias("features"))
    curve = IsotonicRegression(featuresCol="features", labelCol="label").fit(pairs)
    steps = (np.array(curve.boundaries.toArray()), np.array(curve.predictions.toArray()))
    return Model(start.mean, start.scale, waves, phases, weights, steps)


def _column(model: Model, what: str):
    """A function from statistics to the raw value or the score."""

    @arrow_udf("double")
    def of(rows: pa.Array) -> pa.Array:
        values = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
        return pa.array(model.features(values) @ model.weights if what == "raw" else model.score(values))

    return of


def score(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (probability of label 1) and ``predicted`` (1 if it reaches ``threshold``)."""
    docs = docs.drop("score", "predicted")
    small_batches(docs.sparkSession)
    if model is None:
        value = F.lit(0.5)
    else:

        @arrow_udf("double")
        def of(texts: pa.Array) -> pa.Array:
            values = np.array([statistics(texts[i].as_py()) for i in range(len(texts))]).reshape(-1, len(STATISTICS))
            release()
            return pa.array(model.score(values))

        value = of(F.col(text_col).cast("string"))
    return docs.withColumn("score", value).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))
