"""Language ID: blended-spectrum string kernels, Nyström landmarks, one-versus-rest kernel ridge regression.

A text is the set of its character n-grams (n from 1 to 4) over lower-cased letters, every run of other
characters being one boundary. The kernel of two texts is the number of n-grams that both hold, divided
by the root of the product of their numbers. N-grams are known by a slot (2^16 for each n; those that
share a slot count as one in all texts).

Fit: landmarks are labelled texts, as many of each language. Kernel values of a bounded sample of
labelled texts to the landmarks, whitened by the landmarks' own kernel matrix, are summed up to normal
equations in each partition; the ridge solution of every language against the rest follows on the
driver from sums whose size depends on the number of landmarks alone.

Score: kernel rows times coefficients. As the kernel is a product of presence vectors, landmarks and
coefficients are multiplied once into a matrix of slots by languages, and a batch of texts is scored by
one product of its (sparse) presence matrix with that. Texts are read whole and never shuffled.

A text of no learned language still gets the nearest one. How much of it is known says the share of its
3- and 4-grams that the landmarks hold (``EVEN`` more count as held, so that short texts are not judged by a
few). A fit keeps, as the least share to trust, ``TRUST`` times that of the lowest hundredth of the sampled
texts that are not landmarks.

Defined results: NULL, or no letter: ``und``, score 0, also if nothing could be learned. The score is
the winning language's regression value moved from [-1, 1] to [0, 1] and clipped. Ties go to the language
that sorts first. Equal texts get equal results; no rows give no rows; columns with names of result
columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from barloom.llm.common import free_name, release, small_batches, stored

ORDERS = (1, 2, 3, 4)
SLOT_BITS = 16
SLOTS = len(ORDERS) << SLOT_BITS
#: Labelled texts of each language that are learned from, at most about so many.
SAMPLE = 1000
#: Landmarks of each language, and of all together at most about so many.
LANDMARKS, ALL_LANDMARKS = 64, 1024
RIDGE = 1e-3
TASKS = 8
#: Texts whose presence matrix stands in memory at once.
BATCH = 64
UNKNOWN = "und"
EVEN, TRUST = 8, 0.7
#: Multipliers that spread n-grams over slots.
SPREAD = (np.uint32(1), np.uint32(1), np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B))


class Presence:
    """Slots of the n-grams that a text holds."""

    def __init__(self):
        letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
        # Classes of letters: distinct within the first 255 code points, shared beyond.
        self.classes = np.where(letters, 1 + np.arange(0x110000) % 255, 0).astype(np.uint8)
        self.seen = np.zeros(SLOTS, dtype=bool)

    def slots(self, text: str | None) -> np.ndarray:
        """Sorted slots; none if the text has no letter."""
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        code = self.classes[points]
        if not code.any():
            return np.zeros(0, dtype=np.int64)
        code = np.concatenate([[np.uint8(0)], code, [np.uint8(0)]])
        code = code[(code > 0) | np.append(True, code[:-1] > 0)].astype(np.uint32)
        self.seen[code] = True
        self.seen[0] = False
        gram = code
        for k, n in enumerate(ORDERS[1:], 1):
            gram = (gram[:-1] << np.uint32(8)) | code[n - 1 :]
            if len(gram):
                spread = gram if n == 2 else (gram * SPREAD[k]) >> np.uint32(32 - SLOT_BITS)
                self.seen[spread.astype(np.int64) + (k << SLOT_BITS)] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found


@dataclass(frozen=True)
class Model:
    """``weights``: slots by languages; ``held``: slots of the landmarks; ``least``: share of known n-grams to trust."""

    languages: tuple[str, ...]
    weights: np.ndarray
    held: np.ndarray
    least: float


def known_share(slots: np.ndarray, held: np.ndarray) -> float:
    long = slots[slots >= 2 << SLOT_BITS]
    return (int(held[long].sum()) + EVEN) / (len(long) + EVEN)


def sample_rows(rows: DataFrame, group: str, keys: list[str], bound: int) -> DataFrame:
    """About ``bound`` rows of each ``group``, chosen by a hash of ``keys``; never over twice as many in all."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("_size"))
    sizes = {r[group]: r["_size"] for r in sizes.collect()}
    if not sizes:
        return rows.limit(0)
    rate = F.lit(0.0)
    for value, size in sizes.items():
        rate = F.when(F.col(group) == F.lit(value), F.lit(min(1.0, bound / size))).otherwise(rate)
    share = F.pmod(F.xxhash64(*keys, F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(share < rate).limit(2 * bound * len(sizes))


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Learns from the rows where ``learn`` holds and the language is known; None if there are none."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    chosen = stored(sample_rows(rows, "lang", ["id"], sample).repartition(TASKS))
    languages = tuple(sorted(r["lang"] for r in chosen.select("lang").distinct().collect()))
    if not languages:
        return None

    @arrow_udf("binary")
    def presence(texts: pa.Array) -> pa.Array:
        find, out = Presence(), []
        for text in texts:
            bits = np.zeros(SLOTS, dtype=bool)
            bits[find.slots(text.as_py())] = True
            out.append(np.packbits(bits).tobytes() if bits.any() else None)
        return pa.array(out, type=pa.binary())

    each = max(4, min(LANDMARKS, ALL_LANDMARKS // len(languages)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit("landmark")), "text")
    marks = chosen.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each).select(presence("text").alias("bits"))
    packed = np.array([np.frombuffer(r["bits"], dtype=np.uint8) for r in marks.where("bits IS NOT NULL").collect()])
    if not len(packed):
        return None
    count = np.bitwise_count(packed).sum(axis=1).astype(np.float64)
    own = np.empty((len(packed), len(packed)))
    for i, row in enumerate(packed):
        own[i] = np.bitwise_count(packed & row).sum(axis=1) / np.sqrt(count * count[i])
    values, vectors = np.linalg.eigh(own)
    good = values > 1e-8 * values[-1]
    white = vectors[:, good] / np.sqrt(values[good])  # Nyström features: kernel row times this

    held = np.unpackbits(np.bitwise_or.reduce(packed, axis=0), count=SLOTS).astype(bool)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, size = Presence(), white.shape[1]
        left, right, n, shares = np.zeros((size, size)), np.zeros((size, len(languages))), 0, []
        marked = np.unpackbits(packed, axis=1, count=SLOTS).T.copy()
        for batch in batches:
            kernel, target = [], []
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                slots = find.slots(text.as_py())
                if len(slots):
                    shares.append(known_share(slots, held))
                    kernel.append(marked[slots].sum(axis=0, dtype=np.int64) / np.sqrt(count * len(slots)))
                    target.append([1.0 if lang == x else -1.0 for x in languages])
            if kernel:
                features = np.array(kernel) @ white
                left += features.T @ features
                right += features.T @ np.array(target)
                n += len(kernel)
        yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()]), pa.array([right.tobytes()]), pa.array([n]), pa.array([shares], type=pa.list_(pa.float64()))], names=["l", "r", "n", "s"])

    left, right, n, shares = 0.0, 0.0, 0, []
    for row in chosen.select("text", "lang").mapInArrow(sums, "l binary, r binary, n long, s array<double>").collect():  # TASKS rows
        left = left + np.frombuffer(row["l"]).reshape(white.shape[1], -1)
        right = right + np.frombuffer(row["r"]).reshape(white.shape[1], -1)
        n += row["n"]
        shares += [s for s in row["s"] if s < 1]  # the landmarks' own are 1
    if not n:
        return None
    solved = white @ np.linalg.solve(left + RIDGE * n * np.eye(len(left)), right) / np.sqrt(count)[:, None]
    weights = np.zeros((SLOTS, len(languages)), dtype=np.float32)
    for row, coefficients in zip(packed, solved):
        weights[np.flatnonzero(np.unpackbits(row, count=SLOTS))] += coefficients.astype(np.float32)
    return Model(languages, weights, held, TRUST * float(np.quantile(shares or [1.0], 0.01)))


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", known_col: str | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, and the share of known n-grams in ``known_col`` if it is named."""
    docs = docs.drop("lang_pred", "score")
    if model is None:
        known = {known_col: F.lit(0.0)} if known_col else {}
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), **known})
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.held))  # slots by languages, whatever the input

    @arrow_udf("lang_pred string, score double, known double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        languages, weights, held = shared.value
        find = Presence()
        for texts in batches:
            best, top, known = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts))
            for at in range(0, len(texts), BATCH):
                sets = [find.slots(texts[i].as_py()) for i in range(at, min(at + BATCH, len(texts)))]
                sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
                some = np.flatnonzero(sizes)
                if len(some):
                    # The batch's presence matrix (a one in every listed slot) times the weights.
                    starts = (np.cumsum(sizes) - sizes)[some]
                    raw = np.add.reduceat(weights[np.concatenate(sets)], starts, axis=0, dtype=np.float64)
                    raw /= np.sqrt(sizes[some])[:, None]
                    if known_col:
                        known[at + some] = [known_share(sets[i], held) for i in some]
                    best[at + some] = raw.argmax(axis=1)
                    top[at + some] = np.clip((raw.max(axis=1) + 1) / 2, 0.0, 1.0)
            release()
            names = pa.array([languages[b] if b >= 0 else UNKNOWN for b in best.tolist()])
            yield pa.StructArray.from_arrays([names, pa.array(top), pa.array(known)], names=["lang_pred", "score", "known"])

    found = free_name(docs, "_found")
    return docs.withColumn(found, of(F.col(text_col).cast("string"))).select("*", f"{found}.lang_pred", f"{found}.score", *([F.col(f"{found}.known").alias(known_col)] if known_col else [])).drop(found)
