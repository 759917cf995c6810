"""Spelling variants: words of a vocabulary that differ by one code point, and the form each stands for.

Every word's neighbourhood of one edit is generated and probed against Bloom filters of the vocabulary, one
set of blocks per word length. Only what the filters let through is shuffled, to a join with the vocabulary
that removes false positives, so the result does not depend on the filters. Deletions are probed among the
words that are one shorter and replacements by a larger letter among those of the same length; insertions
and the other replacements are the same pairs seen from the other side.

Hashes are polynomials over a word's letters, so that those of all its edits follow from its own without
spelling them out; an edit is spelt only where a filter holds it. A block is one 64-bit word of which a
key sets ``KEY_BITS`` bits. Filters are broadcast in groups of at most ``FILTER_BYTES``: a length whose words need
more is dealt over several groups by hash, and each group is one pass over the vocabulary.

A word's form is its most frequent near word if that is ``times`` as frequent or more. Forms are followed by
doubling; as counts grow tenfold at each step, the number of rounds follows from the largest count.

Defined results: a NULL text has no words; a NULL id counts as the empty text in ``<id>:<run>``; repeated rows
count each for itself; ties between forms go to the word that is smaller in code points; no words give no
rows; only the named columns are read, so other columns of any name do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import LOWER, UPPER, stored

#: What words are made of, after A-Z are lowered.
LETTERS = "a-zÀ-ÿ"
LEAST_LENGTH = 7
LEAST_COUNT = 2
TIMES = 10
#: Of so many runs one loses a letter, where the query asks for it.
DAMAGED = 31

#: Bytes of filters that are broadcast at a time.
FILTER_BYTES = 32 << 20
BITS_PER_WORD = 20
KEY_BITS = 5
#: Words whose edits are probed at once.
TOGETHER = 2000

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
#: Its inverse modulo 2^64.
UNBASE = U(pow(int(BASE), -1, 1 << 64))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """``doc_id, run``: maximal runs of letters of at least that length in whole texts, A-Z lowered."""
    lowered = F.translate(F.col(text_col).cast("string"), UPPER.decode(), LOWER.decode())
    return docs.select(
        F.col(id_col).cast("string").alias("doc_id"),
        F.explode(F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"),
    )


def damaged(doc_id: Column, run: Column) -> Column:
    """The run, without one letter where the CRC-32 of ``<doc_id>:<run>`` is a multiple of 31."""
    h = F.crc32(F.concat(F.coalesce(doc_id, F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % DAMAGED == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words (column ``word``) that are long and frequent enough."""
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _matrix(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row per word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), -1).astype(U)


def _powers(length: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(length, BASE, U)]))


def _mixed(h: np.ndarray) -> np.ndarray:
    """Bits of the polynomials stirred, so that blocks and bits are taken evenly."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _place(h: np.ndarray, blocks: int, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, block in the group, and bits in the block, of polynomials."""
    h = _mixed(h)
    at = (h >> U(32)) % U(blocks * groups)
    bits = np.zeros(h.shape, U)
    rest = h & U(0xFFFFFFFF)
    for _ in range(KEY_BITS):
        bits |= U(1) << (rest & U(63))
        rest >>= U(6)
    return (at // U(blocks)).astype(np.int64), (at % U(blocks)).astype(np.int64), bits


def _hash(letters: np.ndarray) -> np.ndarray:
    return (letters * _powers(letters.shape[1])[: letters.shape[1]]).sum(axis=1, dtype=U)


class Layout:
    """How filters of each length are cut into groups: blocks of 64 bits per group, and the number of groups."""

    def __init__(self, counts: dict[int, int], limit: int = FILTER_BYTES):
        self.blocks, self.groups = {}, {}
        self.passes: list[list[tuple[int, int]]] = []  # (length, group) that are broadcast together
        room = 0
        for length, n in sorted(counts.items()):
            need = max(1, math.ceil(n * BITS_PER_WORD / 64))
            groups = self.groups[length] = math.ceil(8 * need / limit)
            blocks = self.blocks[length] = math.ceil(need / groups)
            for group in range(groups):
                if 8 * blocks > room:
                    self.passes.append([])
                    room = limit
                self.passes[-1].append((length, group))
                room -= 8 * blocks


def _filters(words: DataFrame, layout: Layout, wanted: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """The blocks of some filters; their size is bounded by the layout, whatever the number of words."""
    some = set(wanted)
    blocks, groups = layout.blocks, layout.groups

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_length: dict[int, list[str]] = {}
            for word in batch.column(0).to_pylist():
                by_length.setdefault(len(word), []).append(word)
            for length, found in by_length.items():
                group, block, mask = _place(_hash(_matrix(found)), blocks[length], groups[length])
                mine = np.isin(group, [g for n, g in some if n == length])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(mine.sum(), length)), pa.array(group[mine]), pa.array(block[mine]), pa.array(mask[mine].view(np.int64))],
                    names=["length", "group", "block", "bits"],
                )

    lengths = sorted({n for n, _ in some})
    keys = words.where(F.char_length("word").isin(lengths)).select("word")
    rows = keys.mapInArrow(bits, "length long, group long, block long, bits long").groupBy("length", "group", "block").agg(F.bit_or("bits").alias("bits")).toArrow()
    length, group, block, mask = (rows[c].to_numpy() for c in ("length", "group", "block", "bits"))
    out = {}
    for n, g in wanted:
        out[n, g] = np.zeros(blocks[n], U)
        mine = (length == n) & (group == g)
        out[n, g][block[mine]] = mask[mine].view(U)
    return out


class Neighbours:
    """Probes the edits of words and spells those that a filter holds."""

    def __init__(self, filters: dict[tuple[int, int], np.ndarray], layout: Layout, letters: list[int]):
        self.filters, self.layout, self.letters = filters, layout, np.array(letters, dtype=U)
        self.lengths = {n for n, _ in filters}

    def held(self, h: np.ndarray, length: int) -> np.ndarray:
        """Indices of the polynomials that a filter of this pass holds."""
        group, block, bits = _place(h, self.layout.blocks[length], self.layout.groups[length])
        found = np.zeros(len(h), dtype=bool)
        for (n, g), blocks in self.filters.items():
            if n == length:
                mine = slice(None) if self.layout.groups[length] == 1 else np.flatnonzero(group == g)
                found[mine] = (blocks[block[mine]] & bits[mine]) == bits[mine]
        return np.flatnonzero(found)

    def shorter(self, words: list[str], letters: np.ndarray) -> Iterator[tuple[int, str]]:
        """Words without one letter; of equal letters in a row the first goes, as the others would leave the same."""
        m, length = letters.shape
        if length - 1 not in self.lengths:
            return
        terms = letters * _powers(length)[:length]
        before = np.cumsum(terms, axis=1, dtype=U) - terms
        whole = terms.sum(axis=1, dtype=U)[:, None]
        h = before + (whole - before - terms) * UNBASE
        first = np.ones((m, length), dtype=bool)
        first[:, 1:] = letters[:, 1:] != letters[:, :-1]
        at = np.flatnonzero(first.ravel())
        for i in at[self.held(h.ravel()[at], length - 1)].tolist():
            word, place = words[i // length], i % length
            yield i // length, word[:place] + word[place + 1 :]

    def replaced(self, words: list[str], letters: np.ndarray) -> Iterator[tuple[int, str]]:
        """Words with one letter replaced by a larger one."""
        m, length = letters.shape
        if length not in self.lengths:
            return
        powers, whole = _powers(length), _hash(letters)
        for place in range(length):
            old = letters[:, place]
            h = whole[:, None] + (self.letters[None, :] - old[:, None]) * powers[place]
            at = np.flatnonzero((self.letters[None, :] > old[:, None]).ravel())
            for i in at[self.held(h.ravel()[at], length)].tolist():
                row, letter = divmod(i, len(self.letters))
                word = words[row]
                yield row, word[:place] + chr(int(self.letters[letter])) + word[place + 1 :]

    def of(self, words: list[str]) -> tuple[list[str], list[str]]:
        """Pairs of a word and an edit of it that may be a word."""
        left, right = [], []
        by_length: dict[int, list[str]] = {}
        for word in words:
            by_length.setdefault(len(word), []).append(word)
        for some in by_length.values():
            letters = _matrix(some)
            for edits in (self.shorter(some, letters), self.replaced(some, letters)):
                for row, edit in edits:
                    left.append(some[row])
                    right.append(edit)
        return left, right


def near_pairs(words: DataFrame, limit: int = FILTER_BYTES) -> DataFrame:
    """``word, n, near, near_n``: all pairs of words one edit apart, each seen from both sides.

    ``words`` (``word, n``) is read several times, so hand over a stored table.
    """
    spark = words.sparkSession
    layout = Layout({r["length"]: r["n"] for r in words.groupBy(F.char_length("word").alias("length")).agg(F.count("*").alias("n")).collect()}, limit)
    letters = sorted(r["c"] for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect())
    letters = [ord(c) for c in letters]
    tables = []
    for wanted in layout.passes:
        filters = spark.sparkContext.broadcast(_filters(words, layout, wanted))

        def probe(batches: Iterator[pa.RecordBatch], filters=filters) -> Iterator[pa.RecordBatch]:
            neighbours = Neighbours(filters.value, layout, letters)
            for batch in batches:
                found, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a in range(0, len(found), TOGETHER):
                    n = dict(zip(found[a : a + TOGETHER], counts[a : a + TOGETHER]))
                    left, right = neighbours.of(list(n))
                    yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array([n[w] for w in left], pa.int64()), pa.array(right, pa.string())], names=["word", "n", "near"])

        lengths = {n for n, _ in wanted}
        tables.append(words.where(F.char_length("word").isin(sorted(lengths | {n + 1 for n in lengths}))).select("word", "n").mapInArrow(probe, "word string, n long, near string"))
    if not tables:
        return words.select("word", "n", F.lit("").alias("near"), F.col("n").alias("near_n")).limit(0)
    maybe = tables[0]
    for more in tables[1:]:
        maybe = maybe.unionAll(more)
    pairs = maybe.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")
    ways = F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return pairs.select(ways.alias("p")).select("p.*")


def variants(words: DataFrame, times: int = TIMES, limit: int = FILTER_BYTES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a stored vocabulary ``word, n``."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_pairs(words, limit).groupBy("word").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), best.alias("best"))
    frequent = -F.col("best.less") >= times * F.col("n")
    near = stored(near.select("word", "n_near", F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n")))
    led = near.where("form IS NOT NULL")
    highest = led.agg(F.max("form_n")).first()[0] or 0
    # A chain of k forms ends in a word with a count of 10^k or more.
    steps = int(math.log(highest, times)) + 1 if highest else 0
    roots = led.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps else 0):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stored(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return (
        words.join(near, "word", "left")
        .join(roots, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: bool = False, limit: int = FILTER_BYTES) -> DataFrame:
    """Words of whole texts grouped by spelling; with ``damage`` some runs lose a letter first."""
    found = runs(docs, id_col, text_col)
    word = damaged(F.col("doc_id"), F.col("run")) if damage else F.col("run")
    return variants(stored(vocabulary(found.select(word.alias("word")))), limit=limit)
