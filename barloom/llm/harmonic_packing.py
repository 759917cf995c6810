"""Packing: token ids of documents into sequences of a fixed capacity, by harmonic classes.

A class stands for a piece length ``L`` and takes exactly ``capacity // L`` pieces per sequence, the
reciprocal of its size. Documents are cut so that every piece has the exact length of a class: whole
sequences first, then the longest class length that still fits the rest. Lengths are ``capacity // j``
for ``j`` up to 64 and every length below 64, so a sequence of a class lacks fewer than 64 tokens.

Placement needs no look at other classes and no order between workers: pieces are numbered inside
``(class, bucket)``, bucket counts are added up, and a piece's number divided by the class's count is
its sequence. What does not fill a sequence of its class (fewer pieces than one sequence per class,
a number that does not grow with the input) is put together by the longest piece that fits.

Defined results: a NULL text is empty; an empty text is its end id alone; repeated rows are packed
each for itself; no rows give no pieces; only the named columns are read, so other columns of any
name do not matter; a NULL id is an id like any other.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized, normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from barloom.llm.common import ranges, release, slices, small_batches, stored

CAPACITY = 4096
RECIPROCALS = 64
END_ID = 2
#: Parts of words kept with their ids in a Python worker; beyond that the memory starts anew.
REMEMBERED = 400_000
#: Bytes of text whose words are looked up together.
SLICE = 6 << 20
#: Pieces that one task numbers in one go.
BUCKET_ROWS = 50_000

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, _task int, _row long"


def class_lengths(capacity: int) -> tuple[int, ...]:
    """The lengths a piece may have, longest first."""
    return tuple(sorted({capacity // j for j in range(1, RECIPROCALS + 1) if capacity >= j} | set(range(1, min(RECIPROCALS, capacity) + 1)), reverse=True))


class Cutter:
    """Cuts numbers of tokens into lengths of classes; how a rest is cut is remembered."""

    def __init__(self, capacity: int):
        self.capacity, self.lengths = capacity, class_lengths(capacity)
        self.rests: dict[int, list[int]] = {}

    def cut(self, n: int) -> list[int]:
        whole, rest = divmod(n, self.capacity)
        if rest not in self.rests:
            left, out = rest, []
            for length in self.lengths:
                out += [length] * (left // length)
                left %= length
            self.rests[rest] = out
        return [self.capacity] * whole + self.rests[rest]


@lru_cache(100_000)
def firm(c: str) -> bool:
    """Whether a word that ends in ``c`` ends in a letter or digit after it is normalized and lowered."""
    return c.isalnum() and (c.isascii() or normalize("NFC", c).lower()[-1].isalnum())


class WordIds:
    """Ids of texts by a tokenizer that never joins anything across white space, or across a letter or
    digit and a following mark (as they are after normalizing and lowering).

    Texts are cut at spaces and line feeds, and words before their trailing marks. The parts that a
    slice holds are looked up, or encoded once; the ids of a text are taken from theirs. Parts are kept
    between slices, up to a bounded number. ASCII parts are lowered beforehand where the tokenizer lowers
    letters itself.
    """

    MARKS = "!\"#$%&()*+,-./:;?@[]^_`{|}~"

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.lowers = self._ids(["Aa"]) == self._ids(["aa"])
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, dtype=bool)
        self.ends[[i for w, i in words.items() if suffix and w.endswith(suffix)]] = True
        # The same merges on words that need no splitting; used if it agrees on words of letters.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        self.spell = {b: c for b, c in enumerate(self._byte_characters())}
        probes = ["the", "Packing", "équeê", "Straße", "ÑANDÚ", "слово"]
        self.plain = self.ends.any() and self._ids(probes) == [self._merged([p])[0].tolist() for p in probes]
        self.clear()

    @staticmethod
    def _byte_characters() -> list[str]:
        """The characters by which byte-level vocabularies spell bytes: printable ones stand for themselves."""
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        return [chr(b if b in own else next(rest)) for b in range(256)]

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers of words of letters, encoded as one text of lowered words spelt in bytes."""
        text = " ".join(words).lower()
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.spell).replace(self.spell[32], " ")
        found = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
        return found, np.diff(np.flatnonzero(self.ends[found]), prepend=-1)

    def clear(self) -> None:
        self.part: dict[str, int] = {"": 0}
        self.ids = np.zeros(0, dtype=np.uint32)
        self.counts = np.zeros(1, dtype=np.int64)

    def _ids(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> None:
        """Encodes new parts. Parts of letters only are encoded many in one text: each ends in a token that ends a word."""
        plain = []
        if self.plain:
            for p in parts:
                # Lowering must be letter by letter, and leave nothing to normalize.
                if p.isalpha() and (p.isascii() or ("Σ" not in p and len(low := p.lower()) == len(p) and low.isalpha() and is_normalized("NFC", p))):
                    plain.append(p)
        ids, counts, done = [], [], []
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            found, sizes = self._merged(some)
            if len(sizes) == len(some) and sizes.sum() == len(found):
                ids.append(found)
                counts.append(sizes)
                done += some
        known = set(done)
        rest = [p for p in parts if p not in known]
        if rest:
            lists = self._ids(rest)
            ids.append(np.array([x for y in lists for x in y], dtype=np.uint32))
            counts.append(np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)))
        first = len(self.part)
        self.part.update(zip(done + rest, range(first, first + len(parts))))
        self.ids = np.concatenate([self.ids, *ids])
        self.counts = np.concatenate([self.counts, *counts])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each text."""
        if len(self.part) > REMEMBERED:
            self.clear()
        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        words = pc.split_pattern(texts, " ")
        coded = words.flatten().dictionary_encode()
        distinct, marks = coded.dictionary.to_pylist(), self.MARKS
        cores = [w.rstrip(marks) for w in distinct]
        cores = [c if firm(c[-1:]) else w for c, w in zip(cores, distinct)]
        tails = [w[len(c) :] for c, w in zip(cores, distinct)]
        if self.lowers:
            cores = [c.lower() if c.isascii() else c for c in cores]
        cut = [i for i, t in enumerate(tails) if t]
        numbers = list(map(self.part.get, cores))
        new = {c for c, n in zip(cores, numbers) if n is None}.union(tails).difference(self.part)
        if new:
            self._learn(list(new))
            numbers = list(map(self.part.__getitem__, cores))
        both = np.zeros((len(distinct), 2), dtype=np.int64)  # part 0 is the empty one
        both[:, 0] = numbers
        both[cut, 1] = [self.part[tails[i]] for i in cut]
        used = both[coded.indices.to_numpy(zero_copy_only=False)].ravel()
        counts = self.counts[used]
        flat = self.ids[ranges((np.cumsum(self.counts) - self.counts)[used], counts)]
        before = np.concatenate([[0], np.cumsum(counts)])
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
        return flat, np.diff(before[2 * offsets])


def cut_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, doc_tokens, ids`` (little-endian 32-bit ids).

    ``_task, _row`` number the pieces; write the table before they are used.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, cutter = WordIds(vocabulary), Cutter(capacity)
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            valid = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for a, b in slices(texts, SLICE):
                flat, counts = words.encode(texts.slice(a, b - a))
                flat = np.insert(flat, np.cumsum(counts), end_id).astype("<u4")
                counts = counts + 1
                cuts = [cutter.cut(int(n)) for n in counts]
                per_doc = np.fromiter(map(len, cuts), dtype=np.int64, count=len(cuts))
                lengths = np.array([x for c in cuts for x in c], dtype=np.int64)
                ends = np.cumsum(lengths)
                first = np.repeat(np.cumsum(counts) - counts, per_doc)
                at = np.concatenate([[0], ends]) * 4
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
                owner = pa.array(np.repeat(keys[a:b], per_doc), mask=~np.repeat(valid[a:b], per_doc), from_pandas=False).cast(pa.int64())
                release()
                numbers = [pa.array(np.full(len(lengths), task, dtype=np.int32)), pa.array(np.arange(made, made + len(lengths)))]
                made += len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [owner, pa.array(ends - lengths - first), pa.array(lengths), pa.array(np.repeat(counts, per_doc)), ids, *numbers],
                    names=["doc_id", "start", "length", "doc_tokens", "ids", "_task", "_row"],
                )

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


def _fill(counts: dict[int, int], capacity: int) -> list[list[int]]:
    """Lengths of the sequences made of the given numbers of pieces, longest fitting piece first."""
    out = []
    while counts:
        room, lengths = capacity, []
        for length in sorted(counts, reverse=True):
            n = min(counts[length], room // length)
            lengths += [length] * n
            room -= n * length
            counts[length] -= n
            if not counts[length]:
                del counts[length]
        out.append(lengths)
    return out


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns beside ``length``, ``_task`` and ``_row``) with ``sequence_id`` and ``offset``.

    Buckets go by the numbers of the pieces, so equal rows spread like others. ``pieces`` is read several times, so hand over a stored table. Lengths must be those of
    ``class_lengths``.
    """
    keys = ["_task", "_row"]
    buckets = max(1, math.ceil(pieces.count() / BUCKET_ROWS))
    rows = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        rows.groupBy("length", "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_all", F.sum("_n").over(Window.partitionBy("length")))
    )
    per_class = sizes.groupBy("length").agg(F.max("_all").alias("_all")).withColumn("_bins", F.expr(f"_all div ({capacity} div length)"))
    bases = per_class.withColumn("_base", F.coalesce(F.sum("_bins").over(Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offsets = sizes.select("length", "_bucket", "_before").join(F.broadcast(bases.select("length", "_bins", "_base")), "length")
    numbered = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*keys)))
    numbered = (
        numbered.join(offsets, ["length", "_bucket"])
        .withColumn("_number", F.col("_before") + F.col("_rank") - 1)
        .withColumn("_per", F.expr(f"{capacity} div length"))
        .withColumn("_full", F.col("_number") < F.col("_bins") * F.col("_per"))
    )
    # Left over: for every class fewer pieces than one sequence holds. Their places follow from the counts alone.
    left = per_class.select("length", F.expr(f"_all - _bins * ({capacity} div length)").alias("n"), "_bins").collect()
    made = sum(r["_bins"] for r in left)
    spots, given = [], {r["length"]: r["_bins"] * (capacity // r["length"]) for r in left}
    for k, lengths in enumerate(_fill({r["length"]: r["n"] for r in left if r["n"]}, capacity)):
        offset = 0
        for length in lengths:
            spots.append((length, given[length], made + k, offset))
            given[length] += 1
            offset += length
    spot = pieces.sparkSession.createDataFrame(spots, "length long, _number long, _sequence long, _offset long")
    return numbered.join(F.broadcast(spot), ["length", "_number"], "left").select(
        *[c for c in pieces.columns if c not in keys],
        F.when(F.col("_full"), F.expr("_base + _number div _per")).otherwise(F.col("_sequence")).alias("sequence_id"),
        F.when(F.col("_full"), F.expr("(_number % _per) * length")).otherwise(F.col("_offset")).alias("offset"),
    )


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Packed pieces with their ids; without ``keep_ids`` a checksum stands for them in what is stored and shuffled."""
    pieces = cut_documents(docs, vocabulary, id_col, text_col, capacity, end_id).withColumn("ids_crc32", F.crc32("ids"))
    return place(stored(pieces if keep_ids else pieces.drop("ids")), capacity)


def assemble(packed: DataFrame) -> DataFrame:
    """One row per sequence: ``sequence_id, n_tokens, ids`` (all pieces' ids in order, without padding)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("_parts")).select(
        "sequence_id", "n_tokens", F.aggregate("_parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")
    )
