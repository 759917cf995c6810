"""LM scoring: a hierarchical Pitman-Yor model of words given the word before.

Every word before has a restaurant (words are known by 64 bits, 52 of a hash and 12 of their ending; their
number grows with the input) whose customers are the tokens that follow it. Its tables are customers of the
restaurant of its ending: a hash bucket (``CONTEXTS`` in all) of its last two characters, or the start of the
text. The tables of those are customers of one parent restaurant, whose own parent is the uniform distribution
over the known words and one unknown word.

A customer sits down at a table of its word or opens one, by the rule of the Chinese restaurant. Gibbs
sweeps take all customers of a word out of a restaurant and seat them again one by one, given all other
words and restaurants as they are. Every word's seating depends on other words by the restaurants' totals
only, so words are resampled in parallel, the totals being renewed after each sweep; a level is resampled
against the one above as the sweep found it. A pair of words that occurs once has one table whatever is
drawn, and a word that occurs once one at its ending and one at the parent, so only the others are resampled.
Beyond ``SINGLY`` customers of a word in a restaurant, they are seated in rows of a 64th of those that sit
already. The first ``BURN`` sweeps are passed over. Probabilities of endings are averaged over the others; so
are the tables of pairs, with which they are put together.

Jobs: words are dealt to blocks by their bits, and rows are arrays of a block. Each slice of text sends every
block the pairs of its words with their counts; a block adds them up and keeps them sorted. In a sweep, a block
seats its pairs and its words at endings and at the parent. For that it asks the blocks of the words before how
many tables these have: a word is followed as often as it stands, so its tables are its count without the
customers who did not open one, and only pairs that occur again have such. Those numbers and the seating of words
that occur again are all that is shuffled. For scoring, each slice of text sends the blocks its pairs and the
places of their texts, and gets sums for each text back. The ``FREQUENT`` most frequent words before are sent to
all tasks; tokens after others are joined with their tables by key. No text is shuffled. Discounts come from the
numbers of words (or pairs) that occur once and twice.

Defined results: a NULL text is empty, which is one end token; with nothing to learn from every token has
probability 1, as the only known distribution is over the unknown word alone; rows of equal text get equal
results; rows are told apart even if ids repeat or are NULL; no rows give no rows; only the named columns are read.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import ASCII_LOWER, Numbers, discard, forget_shuffles, release, slices, small_batches, stored

CONTEXTS = 4096
SWEEPS, BURN = 6, 3
#: Frequent words before that are sent to all tasks.
FREQUENT = 2_000_000
SINGLY = 32
STRENGTH = (10.0, 10.0, 2.0)  # of the parent, of the endings, and of the words before
#: Bytes of text whose words are counted or scored together.
SLICE = 4 << 20
#: Bytes of text for each block: the first up to some hundred blocks, the second beyond.
BLOCK, LARGE_BLOCK = 12 << 20, 48 << 20
#: Texts are scored in so many rounds, as the pairs of a round are on disk at once.
ROUNDS = 2
#: Rows of pairs that a block gathers before it adds them up.
GATHERED = 2_000_000
SEED = 11
END = b""
#: Bits of a word that are its hash; the ones above are its ending.
HASH = np.uint64(52)
#: Kinds of rows, in the order in which a block takes them.
REST, COUNTS, STATE, INFO, ASK = range(5)
KINDS = {"block": pa.int32(), "kind": pa.int32(), "origin": pa.int64(), "data": pa.binary(), "rest": pa.binary(), "counts": pa.binary(), "state": pa.binary(), "sums": pa.list_(pa.int64())}
SQL_KINDS = {"block": "int", "kind": "int", "origin": "long", "data": "binary", "rest": "binary", "counts": "binary", "state": "binary", "sums": "array<long>"}
DEALT = ("block", "kind", "origin", "data")
SWEPT = ("block", "kind", "origin", "data", "state", "sums")
MERGED = ("block", "kind", "origin", "data", "rest", "counts", "sums")
FACTS = ("words", "tokens", "w1", "w2", "p1", "p2", "once", "twice")


def _schema(names: tuple[str, ...]) -> str:
    return ", ".join(f"{n} {SQL_KINDS[n]}" for n in names)


def _context(word: bytes) -> int:
    """Bucket of the word's last two characters; 0 is the start of a text."""
    return 1 + zlib.crc32(word.decode("utf-8", "replace")[-2:].encode()) % (CONTEXTS - 1)


def _word(word: bytes) -> int:
    return (_context(word) if word else 0) << 52 | xxhash.xxh64_intdigest(word, SEED) >> 12


def _endings(words: np.ndarray) -> np.ndarray:
    return (words >> HASH).astype(np.int64)


def _owner(words: np.ndarray, blocks: int) -> np.ndarray:
    return ((words & np.uint64((1 << 52) - 1)) % np.uint64(blocks)).astype(np.int64)


def _small(numbers: np.ndarray) -> np.ndarray:
    """In as few bytes a number as hold the largest."""
    return numbers.astype(np.min_scalar_type(int(numbers.max()) if len(numbers) else 0))


def _packed(*arrays) -> bytes:
    return pickle.dumps(arrays, protocol=5)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``block, kind, origin`` of each row, and its arrays."""
    for batch in batches:
        columns = [batch.column(c) for c in range(4)]
        for i in range(batch.num_rows):
            yield columns[0][i].as_py(), columns[1][i].as_py(), columns[2][i].as_py(), pickle.loads(columns[3][i].as_buffer())


def _batch(rows: list[dict], names: tuple[str, ...] = DEALT) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], type=KINDS[n]) for n in names], names=list(names))


def _column(table: DataFrame, name: str, kind: int) -> DataFrame:
    """The rows of a stored table that hold a value there, to be dealt."""
    return table.where(F.col(name).isNotNull()).select("block", F.lit(kind).alias("kind"), "origin", F.col(name).alias("data"))


def _dealt(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    """Rows of a key in one partition, one key after the other, each in the order of kinds."""
    return rows.repartition(2 * blocks, key).sortWithinPartitions(key, "kind")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Each block with its rows (without the block); all of them must be taken before the next block."""
    rows = _rows(batches)
    head = next(rows, None)

    def of(block: int) -> Iterator[tuple]:
        nonlocal head
        while head is not None and head[0] == block:
            now, head = head[1:], None
            yield now
            head = next(rows, None)

    while head is not None:
        block = head[0]
        yield block, of(block)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a slice of texts: its distinct words; number of the word, of the word before (the end token's at the
    start of a text), and text of each token."""
    number = Numbers()
    number[END]
    words, ends = [], []
    for i in range(len(texts)):
        found = (texts[i].as_py() or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
        words += map(number.__getitem__, found)
        words.append(0)
        ends.append(len(words))
    word = np.array(words, dtype=np.int64)
    known = np.fromiter(map(_word, number), dtype=np.uint64, count=len(number))
    before = np.concatenate([[0], word[:-1]])
    return known, word, before, np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))


def _to_blocks(known: np.ndarray, word: np.ndarray, before: np.ndarray, blocks: int, doc: np.ndarray | None = None) -> Iterator[tuple]:
    """For each block: it, its words in order, how many pairs each has, the words before and which of them each pair
    has, how often it stands, and with ``doc`` also the texts of its tokens."""
    owner = _owner(known, blocks)
    order = np.lexsort((known, owner))
    rank = np.empty(len(known), dtype=np.int64)
    rank[order] = np.arange(len(known))
    known, owner = known[order], owner[order]
    key = rank[word] * len(known) + rank[before]
    if doc is None:
        pair, times = np.unique(key, return_counts=True)
        starts = None
    else:
        by = np.argsort(key, kind="stable")
        key, doc = key[by], doc[by]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        pair, starts = key[starts], np.append(starts, len(key))
        times = np.diff(starts)
    w, h = pair // len(known), pair % len(known)
    bounds = np.searchsorted(owner[w], np.arange(blocks + 1))
    for block in np.flatnonzero(np.diff(bounds)):
        a, b = bounds[block], bounds[block + 1]
        first = np.flatnonzero(np.diff(w[a:b], prepend=-1))
        distinct, which = np.unique(h[a:b], return_inverse=True)
        out = int(block), known[w[a:b][first]], _small(np.diff(np.append(first, b - a))), known[distinct], _small(which), _small(times[a:b])
        yield out if doc is None else (*out, _small(doc[starts[a] : starts[b]]))


def _count(blocks: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            for a, b in slices(column, SLICE):
                known, word, before, _ = tokens(column.slice(a, b - a))
                out = _batch([{"block": block, "kind": REST, "data": _packed(*arrays)} for block, *arrays in _to_blocks(known, word, before, blocks)])
                del known, word, before
                release()
                yield out

    return run


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new key begins, of keys in order."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _added(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of many slices in order: the word, the word before, and their count."""
    w, h, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((h, w))
    w, h, n = w[order], h[order], n[order]
    first = _starts(w, h)
    return w[first], h[first], np.add.reduceat(n, first)


@dataclass
class Totals:
    """Sums over all words: customers and tables of each context, tables of the parent, and constants."""

    customers: np.ndarray
    tables: np.ndarray
    parent: int
    words: int
    discounts: tuple[float, float]

    def parent_probability(self, own: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Of words with ``own`` customers at ``tables`` tables of the parent restaurant."""
        discount, strength = self.discounts[0], STRENGTH[0]
        rest = (strength + discount * self.parent) / (self.words + 1)
        return (np.where(own > 0, own - discount * tables, 0.0) + rest) / (strength + self.tables.sum())

    def weight(self) -> np.ndarray:
        """Of the parent's probability in each context."""
        return (STRENGTH[1] + self.discounts[1] * self.tables) / (STRENGTH[1] + self.customers)

    def probability(self, gs: np.ndarray, ns: np.ndarray, tables: np.ndarray, base: np.ndarray) -> np.ndarray:
        """In the contexts ``gs``, of words with ``ns`` customers at ``tables`` tables there and ``base`` of the parent."""
        return (ns - self.discounts[1] * tables) / (STRENGTH[1] + self.customers[gs]) + self.weight()[gs] * base


def seat(customers: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables at which ``customers`` of a word sit down one by one; ``new`` is the weight of opening one."""
    tables = np.ones(len(customers), dtype=np.int64)
    some = np.flatnonzero(customers > 1)
    for n in range(1, SINGLY):
        some = some[customers[some] > n]
        if not len(some):
            return tables
        tables[some] += rng.random(len(some)) * (new[some] + n - discount * tables[some]) < new[some]
    n = np.full(len(some), SINGLY)
    while len(some):
        going = n < customers[some]
        some, n = some[going], n[going]
        row = np.minimum(np.maximum(n // 64, 1), customers[some] - n)
        chance = new[some] / (new[some] + n - discount * tables[some])
        tables[some] += rng.binomial(row, chance)
        n = n + row
    return tables


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


@dataclass
class State:
    """The seating of a block's words that occur again, word for word, ending for ending and pair for pair."""

    endings: np.ndarray  # of each word
    g: np.ndarray  # of each ending of a word: its bucket,
    once: np.ndarray  # pairs that occur once,
    many: np.ndarray  # and others there
    before: np.ndarray  # the words before of the others, in the order of the blocks that own them
    which: np.ndarray  # of each other pair: the place of the word before,
    n: np.ndarray  # count,
    t: np.ndarray  # tables,
    sum: np.ndarray  # and their sum over the samples
    tables: np.ndarray  # of each ending of a word,
    parent: np.ndarray  # and of each word
    p1: np.ndarray  # the parent's probabilities of each word, a column a sample
    ps: np.ndarray  # the sums of the endings'

    @classmethod
    def first(cls, rest: tuple, blocks: int) -> State:
        """One table for each pair, ending and word. Words that occur once have that whatever is drawn, and are left out."""
        c, endings, pairs, h, n = *(x.astype(np.int64) for x in rest[1:4]), rest[4], rest[5].astype(np.int64)
        again, many = c > 1, n > 1
        moved = np.repeat(again, endings)
        repeated = np.bincount(np.repeat(np.arange(len(pairs)), pairs)[many], minlength=len(pairs))
        before, which = np.unique(h[many], return_inverse=True)
        order = np.lexsort((before, _owner(before, blocks)))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        ones = [np.ones(x.sum(), dtype=np.int64) for x in (many, moved, again)]
        g = _endings(h[np.cumsum(pairs) - pairs])
        return cls(endings[again], g[moved], (pairs - repeated)[moved], repeated[moved], before[order], rank[which], n[many], ones[0], 0 * ones[0], ones[1], ones[2], np.zeros((len(ones[2]), 0)), np.zeros(len(ones[1]), np.float32))

    @classmethod
    def unpacked(cls, arrays: tuple) -> State:
        return cls(*(a if a.dtype.kind == "f" or a.dtype == np.uint64 and i == 4 else a.astype(np.int64) for i, a in enumerate(arrays)))

    def packed(self) -> bytes:
        arrays = [self.endings, self.g, self.once, self.many, self.before, self.which, self.n, self.t, self.sum, self.tables, self.parent, self.p1, self.ps]
        return _packed(*(a if a.dtype.kind == "f" or i == 4 else _small(a) for i, a in enumerate(arrays)))

    def owners(self, blocks: int) -> np.ndarray:
        """Where the words before of each owner begin."""
        return np.searchsorted(_owner(self.before, blocks), np.arange(blocks + 1))

    def asks(self, block: int, blocks: int, samples: int = 0) -> list[dict]:
        """For each owner of words before: them, and how many customers opened no table in this block, now or in all samples."""
        kept = samples * self.n - self.sum if samples else self.n - self.t
        kept = np.bincount(self.which, weights=kept, minlength=len(self.before)).astype(np.int64)
        bounds = self.owners(blocks)
        return [{"block": int(o), "kind": ASK, "origin": block, "data": _packed(self.before[a:b], _small(kept[a:b]))} for o, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]

    def sample(self, totals: Totals) -> None:
        """Adds the probabilities of this seating."""
        owner = np.repeat(np.arange(len(self.endings)), self.endings)
        once = np.repeat(np.arange(len(self.g)), self.many)
        ns = self.once + np.bincount(once, weights=self.t, minlength=len(self.g)).astype(np.int64)
        own = np.bincount(owner, weights=self.tables, minlength=len(self.endings))
        base = totals.parent_probability(own, self.parent)
        self.p1 = np.hstack([self.p1, base[:, None]])
        self.ps = (self.ps + totals.probability(self.g, ns, self.tables, base[owner])).astype(np.float32)

    def sweep(self, opened: np.ndarray, totals: Totals, discount: float, rng: np.random.Generator, sampled: bool) -> None:
        """All seated again; ``opened`` are the tables after each of the words before."""
        size = len(self.g)
        owner = np.repeat(np.arange(len(self.endings)), self.endings)
        place = np.repeat(np.arange(size), self.many)
        ns = self.once + np.bincount(place, weights=self.t, minlength=size).astype(np.int64)
        own = np.bincount(owner, weights=self.tables, minlength=len(self.endings)).astype(np.int64)
        g, t, u = self.g[place], self.t, self.parent[owner[place]]
        # The pair's own tables leave the ending's restaurant, and what that has too many leave the parent's.
        others = ns[place] - t
        left = np.minimum(self.tables[place], others)
        above = own[owner[place]] - (self.tables[place] - left)
        base = totals.parent_probability(above, np.minimum(u, above)) * (STRENGTH[1] + totals.discounts[1] * np.maximum(totals.tables[g] - (self.tables[place] - left), 0))
        base = (np.maximum(others - totals.discounts[1] * left, 0.0) + base) / (STRENGTH[1] + np.maximum(totals.customers[g] - t, 0))
        self.t = seat(self.n, (STRENGTH[2] + discount * np.maximum(opened[self.which] - t, 0)) * base, discount, rng)
        if sampled:
            self.sum = self.sum + self.t
        # The endings' customers have changed.
        ns = self.once + np.bincount(place, weights=self.t, minlength=size).astype(np.int64)
        tables = np.minimum(self.tables, ns)
        own = np.bincount(owner, weights=tables, minlength=len(self.endings)).astype(np.int64)
        others = own[owner] - tables
        base = totals.parent_probability(others, np.minimum(self.parent[owner], others))
        new = (STRENGTH[1] + totals.discounts[1] * np.maximum(totals.tables[self.g] - tables, 0)) * base
        self.tables = seat(ns, new, totals.discounts[1], rng)
        own = np.bincount(owner, weights=self.tables, minlength=len(self.endings)).astype(np.int64)
        new = (STRENGTH[0] + totals.discounts[0] * np.maximum(totals.parent - self.parent, 0)) / (totals.words + 1)
        self.parent = seat(own, new, totals.discounts[0], rng)

    def sums(self) -> np.ndarray:
        """Customers and tables of each ending, and tables of the parent."""
        place = np.repeat(np.arange(len(self.g)), self.many)
        ns = self.once + np.bincount(place, weights=self.t, minlength=len(self.g)).astype(np.int64)
        per = [np.bincount(self.g, weights=x, minlength=CONTEXTS).astype(np.int64) for x in (ns, self.tables)]
        return np.concatenate([*per, [self.parent.sum()]])


def _merge(blocks: int) -> Callable:
    """Adds up the pairs of each block: a row of its words, their counts and endings, and their pairs; what it asks of
    the words before; and in the last row of a task the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(3 * CONTEXTS + len(FACTS), dtype=np.int64)
        for block, rows in _by_block(batches):
            parts, size, most = [], 0, GATHERED
            for _, _, (w, runs, h, which, n) in rows:
                parts.append((np.repeat(w, runs), h[which], n.astype(np.int64)))
                size += len(which)
                if size > most:
                    parts = [_added(parts)]
                    size = len(parts[0][0])
                    most = size + max(size, GATHERED)
            w, h, n = _added(parts)
            del parts
            g = _endings(h)
            entry, word = _starts(w, g), _starts(w)
            pairs = np.diff(entry, append=len(w))  # of each word at each ending
            endings = np.diff(np.searchsorted(entry, word), append=len(entry))  # of each word
            c = np.add.reduceat(n, word)
            at = g[entry]
            moved = np.repeat(c > 1, endings)
            for i, x in enumerate((np.bincount(at, weights=pairs, minlength=CONTEXTS), np.bincount(at, minlength=CONTEXTS), np.bincount(at[~moved], minlength=CONTEXTS))):
                sums[i * CONTEXTS : (i + 1) * CONTEXTS] += x.astype(np.int64)
            sums[3 * CONTEXTS :] += [len(c), c.sum(), *((x == k).sum() for x in (endings, pairs, n) for k in (1, 2))]
            arrays = w[word], _small(c), _small(endings), _small(pairs), h, _small(n)
            yield _batch([{"block": block, "rest": _packed(*arrays), "counts": _packed(*arrays[:2])}, *State.first(arrays, blocks).asks(block, blocks)], MERGED)
        yield _batch([{"sums": sums}], MERGED)

    return run


def _answer(rows: Iterator[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
    """The words of a block, their counts, the customers after them that opened no table, and who asked for which."""
    words, c, kept, asked = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
    for kind, origin, arrays in rows:
        if kind == COUNTS:
            words, c = arrays[0], arrays[1].astype(np.int64)
            kept = np.zeros(len(words), dtype=np.int64)
        else:
            place = np.searchsorted(words, arrays[0])  # every word before is a word
            kept[place] += arrays[1].astype(np.int64)
            asked.append((origin, _small(place)))
    return words, c, kept, asked


def _reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each block that asked: the tables after those words."""
    for block, rows in _by_block(batches):
        _, c, kept, asked = _answer(rows)
        opened = c - kept
        if asked:
            yield _batch([{"block": origin, "kind": ASK, "origin": block, "data": _packed(_small(opened[place]))} for origin, place in asked])


def _sweep(blocks: int, totals: Totals, discount: float, sweep: int, sweeps: int) -> Callable:
    """One more sweep. The probabilities of the seating that the sweep before left are added up on the way, now that
    its ``totals`` are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * CONTEXTS + 1, dtype=np.int64)
        for block, rows in _by_block(batches):
            arrays = next(rows)[2]
            state = State.first(arrays, blocks) if sweep == 1 else State.unpacked(arrays)
            bounds, opened = state.owners(blocks), np.zeros(len(state.before), dtype=np.int64)
            for _, origin, (tables,) in rows:
                opened[bounds[origin] : bounds[origin + 1]] = tables
            if sweep - 1 > BURN:
                state.sample(totals)
            state.sweep(opened, totals, discount, np.random.default_rng([SEED, sweep, block]), sweep > BURN)
            sums += state.sums()
            yield _batch([{"block": block, "state": state.packed()}, *state.asks(block, blocks, sweeps - BURN if sweep == sweeps else 0)], SWEPT)
        yield _batch([{"sums": sums}], SWEPT)

    return run


def _summed(table: DataFrame, size: int) -> np.ndarray:
    """The sums that the tasks left, added up."""
    sums = np.zeros(size, dtype=np.int64)
    for r in table.where("sums IS NOT NULL").select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
        sums[r["i"]] = r["x"]  # some thousand in all
    return sums


def _blocks(size: int) -> int:
    """Number of blocks for so many bytes of text."""
    return max(1, min(size // BLOCK, 64 + size // LARGE_BLOCK))


@dataclass
class Block:
    """What a block knows of its words after the last sweep."""

    words: np.ndarray  # in order
    c: np.ndarray  # count of each
    endings: np.ndarray  # of each, how many
    p1: np.ndarray  # the parent's probabilities of each, a column a sample
    g: np.ndarray  # of each ending of a word: its bucket,
    ps: np.ndarray  # averaged probability,
    pairs: np.ndarray  # and pairs there
    h: np.ndarray  # of each pair: the word before,
    n: np.ndarray  # count,
    a: np.ndarray  # and discounted count

    @classmethod
    def unpacked(cls, arrays: tuple) -> Block:
        words, c, endings, p1, once, ps, pairs, h, n, tables, discount = arrays
        c, endings, pairs, n = (x.astype(np.int64) for x in (c, endings, pairs, n))
        of_each = np.tile(once, (len(words), 1))
        of_each[c > 1] = p1
        a = np.full(len(h), 1 - discount)
        a[n > 1] = n[n > 1] - discount * tables
        return cls(words, c, endings, of_each, _endings(h[np.cumsum(pairs) - pairs]), ps, pairs, h, n, a)


@dataclass
class Model:
    """``table``: a row of each of ``blocks``, for ``Block``. ``samples``: the totals of each sample. ``contexts``: ``h, c, x, y``: after a word that stood ``c`` times, a word's probability is
    ``a * x`` and ``y`` times that of the ending."""

    table: DataFrame
    blocks: int
    train_tokens: int
    distinct: int
    samples: list[Totals]
    contexts: DataFrame

    @property
    def weights(self) -> np.ndarray:
        """Of the parent in each sample and ending."""
        return np.array([t.weight() for t in self.samples])

    @property
    def unknown(self) -> np.ndarray:
        """The parent's probability of the unknown word in each sample."""
        return np.array([float(t.parent_probability(np.zeros(1), np.zeros(1))[0]) for t in self.samples])

    def _each(self, make: Callable[[Block], pa.RecordBatch], schema: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for *_, arrays in _rows(batches):
                yield make(Block.unpacked(arrays))

        return self.table.mapInArrow(run, schema)

    @property
    def words(self) -> DataFrame:
        """``w, c, p1, gs, ps``: count, parent's probability in each sample, and the averaged probability in each
        ending where the word was seen."""

        def make(b: Block) -> pa.RecordBatch:
            step = np.arange(len(b.words) + 1, dtype=np.int32) * b.p1.shape[1]
            starts = np.concatenate([[0], np.cumsum(b.endings)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(s), pa.array(v)) for s, v in ((step, b.p1.ravel()), (starts, b.g.astype(np.int16)), (starts, b.ps))]
            return pa.RecordBatch.from_arrays([pa.array(b.words.view(np.int64)), pa.array(b.c), *lists], names=["w", "c", "p1", "gs", "ps"])

        return self._each(make, "w long, c long, p1 array<double>, gs array<short>, ps array<float>")

    @property
    def pairs(self) -> DataFrame:
        """``h, w, n, a``: count and discounted count of every pair seen."""

        def make(b: Block) -> pa.RecordBatch:
            w = np.repeat(np.repeat(b.words, b.endings), b.pairs)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (b.h.view(np.int64), w.view(np.int64), b.n, b.a)], names=["h", "w", "n", "a"])

        return self._each(make, "h long, w long, n long, a double")


def _solve(samples: list[Totals], discount: float) -> Callable:
    """Puts what a block knows of its words and their last seating into one row."""
    one = np.ones(1, dtype=np.int64)
    once = np.array([float(t.parent_probability(one, one)[0]) for t in samples])
    everywhere = np.mean([t.probability(np.arange(CONTEXTS), 1, 1, p) for t, p in zip(samples, once)], axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _by_block(batches):
            (words, c, endings, pairs, h, n), seating = (arrays for _, _, arrays in rows)
            state = State.unpacked(seating)
            state.sample(samples[-1])
            starts = np.cumsum(pairs, dtype=np.int64) - pairs
            ps = everywhere[_endings(h[starts])].astype(np.float32)
            ps[np.repeat(c > 1, endings)] = state.ps / len(samples)
            tables = (state.sum / len(samples)).astype(np.float32)
            yield _batch([{"block": block, "kind": REST, "data": _packed(words, c, endings, state.p1, once, ps, pairs, h, n, tables, discount)}])

    return run


def fit(docs: DataFrame, learn: Column, text_col: str = "text", sweeps: int = SWEEPS) -> Model:
    """Counts the rows where ``learn`` holds and samples their seating."""
    if sweeps <= BURN:
        raise ValueError(f"{BURN} sweeps are passed over, so more are needed")
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.where(learn).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    blocks = _blocks(texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    merged = stored(_dealt(texts.mapInArrow(_count(blocks), _schema(DEALT)), "block", blocks).mapInArrow(_merge(blocks), _schema(MERGED)))
    sums = _summed(merged, 3 * CONTEXTS + len(FACTS))
    forget_shuffles(spark)
    customers, tables, still = sums[: 3 * CONTEXTS].reshape(3, CONTEXTS)
    facts = dict(zip(FACTS, sums[3 * CONTEXTS :].tolist()))
    words, discounts = facts["words"], (_discount(facts["w1"], facts["w2"]), _discount(facts["p1"], facts["p2"]))
    discount = _discount(facts["once"], facts["twice"])
    totals, samples = Totals(customers, tables, words, words, discounts), []
    counts, last = _column(merged, "counts", COUNTS), merged
    for sweep in range(1, sweeps + 1):
        replies = _dealt(counts.unionByName(_column(last, "data", ASK)), "block", blocks).mapInArrow(_reply, _schema(DEALT))
        seating = _column(last, "rest", REST) if sweep == 1 else _column(last, "state", STATE)
        dealt = _dealt(seating.unionByName(replies), "block", blocks)
        before, last = last, stored(dealt.mapInArrow(_sweep(blocks, totals, discount, sweep, sweeps), _schema(SWEPT)))
        sums = _summed(last, 2 * CONTEXTS + 1)
        totals = Totals(still + sums[:CONTEXTS], still + sums[CONTEXTS:-1], int(still.sum() + sums[-1]), words, discounts)
        if sweep > 1:
            discard(before)
        forget_shuffles(spark)
        if sweep > BURN:
            samples.append(totals)
    size = len(samples)

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_block(batches):
            h, c, kept, _ = _answer(rows)
            below = STRENGTH[2] + c
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), c, 1 / below, (STRENGTH[2] + discount * (c - kept / size)) / below)], names=["h", "c", "x", "y"])

    contexts = stored(_dealt(counts.unionByName(_column(last, "data", ASK)), "block", blocks).mapInArrow(after, "h long, c long, x double, y double"))
    dealt = _dealt(_column(merged, "rest", REST).unionByName(_column(last, "state", STATE)), "block", blocks)
    table = stored(dealt.mapInArrow(_solve(samples, discount), _schema(DEALT)))
    del dealt, replies, seating, counts
    discard(merged)
    discard(last)
    return Model(table, blocks, facts["tokens"], words, samples, contexts)


def _at_least(rows: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of the largest ``count``, at most ``most``; rows of equal step of it go together."""
    step = F.floor(F.log2(count) * 32)
    least = 1 << 20
    for r in rows.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():  # some two thousand at most
        most -= r["n"]
        if most < 0:
            break
        least = r["step"]
    return rows.where(step >= least)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted ``keys``, and whether the wanted key stands there."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return spot, keys[spot] == wanted


def _request(blocks: int, turn: int) -> Callable:
    """Each slice of texts sends every block the pairs of its words, and the first its ids and numbers of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin = (TaskContext.get().partitionId() * ROUNDS + turn) << 40
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for a, b in slices(column, SLICE):
                known, word, before, doc = tokens(column.slice(a, b - a))
                info = ids.slice(a, b - a)
                info = _packed(info.is_valid().to_numpy(zero_copy_only=False), info.fill_null(0).to_numpy(), np.bincount(doc, minlength=b - a))
                rows = [{"block": block, "kind": ASK, "origin": origin, "data": _packed(*arrays, b - a)} for block, *arrays in _to_blocks(known, word, before, blocks, doc)]
                out = _batch([{"block": 0, "kind": INFO, "origin": origin, "data": info}, *rows])
                del known, word, before, doc, rows
                origin += b - a
                release()
                yield out

    return run


class Scorer:
    """Probabilities of the pairs that slices of text send to a block. ``known``: the frequent words before, in
    order, with their ``x`` and ``y``; ``whole``: there are no others."""

    def __init__(self, block: Block | None, model: tuple, known: tuple, whole: bool):
        self.weights, self.unknown, self.floor = model
        self.known, self.whole = known, whole
        samples = len(self.unknown)
        nothing = np.zeros(0, dtype=np.int64)
        self.block = b = block or Block(np.zeros(0, np.uint64), nothing, nothing, np.zeros((0, samples)), nothing, np.zeros(0), nothing, np.zeros(0, np.uint64), nothing, np.zeros(0))
        owner = np.repeat(np.arange(len(b.words)), b.endings)
        self.at = owner * CONTEXTS + b.g
        self.before, place = np.unique(b.h, return_inverse=True)
        self.pair = np.repeat(owner, b.pairs) * len(self.before) + place

    def _after(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``x`` and ``y`` of words before, and whether they are known to be so."""
        spot, there = _find(self.known[0], h)
        x, y = np.zeros(len(h)), np.ones(len(h))
        x[there], y[there] = self.known[1][spot[there]], self.known[2][spot[there]]
        return x, y, there | self.whole

    def __call__(self, words: np.ndarray, runs: np.ndarray, distinct: np.ndarray, which: np.ndarray, times: np.ndarray, docs: np.ndarray, size: int) -> tuple[np.ndarray, tuple]:
        """Numbers of known tokens, sums of the base's and of the model's logarithms of each text; and of tokens after
        words not among ``known``: text, word before, ``a``, and the ending's probability."""
        b, h = self.block, distinct[which]
        spot, found = _find(b.words, words)
        runs, times = runs.astype(np.int64), times.astype(np.int64)
        place, here, g = np.repeat(spot, runs), np.repeat(found, runs), _endings(h)
        at, there = _find(self.at, np.where(here, place * CONTEXTS + g, -1))
        p = np.zeros(len(h))
        p[there] = b.ps[at[there]]
        new = here & ~there
        p[new] = (self.weights[:, g[new]].T * b.p1[place[new]]).mean(axis=1)
        p[~here] = (self.weights[:, g[~here]].T * self.unknown).mean(axis=1)
        spots, known = _find(self.before, distinct)
        before, held = spots[which], known[which]
        at, seen = _find(self.pair, np.where(held & here, place * len(self.before) + before, -1))
        a = np.zeros(len(h))
        a[seen] = b.a[at[seen]]
        x, y, sure = (values[which] for values in self._after(distinct))
        log = np.where(sure, np.log10(a * x + y * p), 0.0)
        c = np.zeros(len(words))
        c[found] = b.c[spot[found]]
        base = np.log10((c + 0.5) / self.floor)
        sums = [np.bincount(docs, weights=np.repeat(v, times), minlength=size) for v in (here.astype(np.float64), np.repeat(base, runs), log)]
        rare = np.repeat(~sure, times)
        return np.array(sums), (docs[rare].astype(np.int64), *(np.repeat(v, times)[rare] for v in (h.view(np.int64), a, p)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, frequent_pairs: int = 0, known_pairs: int = 0) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row, and ``perplexity`` per token.

    ``frequent_pairs`` and ``known_pairs`` are there for older callers and change nothing: no pairs are sent to all tasks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    found = _at_least(model.contexts, "c", frequent).select("h", "x", "y").toArrow()
    h = found.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    known = h[order], *(found.column(c).to_numpy()[order].astype(np.float32) for c in ("x", "y"))
    whole = len(h) == model.distinct
    del found, h, order
    shared = spark.sparkContext.broadcast(known)
    facts = (model.weights, model.unknown, model.train_tokens + 0.5 * (model.distinct + 1))
    lists = {"row": pa.int64(), "h": pa.int64(), "a": pa.float64(), "p": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _by_block(batches):
            scorer = None
            for kind, origin, arrays in rows:
                if kind == REST:
                    scorer = Scorer(Block.unpacked(arrays), facts, shared.value, whole)
                    continue
                rare = ()
                if kind == ASK:
                    scorer = scorer or Scorer(None, facts, shared.value, whole)
                    sums, rare = scorer(*arrays)
                    arrays = (sums,)
                    rare = (rare[0] + origin, *rare[1:]) if len(rare[0]) else ()
                columns = [pa.array([x], type=t) for x, t in ((origin, pa.int64()), (kind, pa.int32()), (block, pa.int32()), (_packed(*arrays), pa.binary()))]
                columns += [pa.array([rare[i] if rare else None], type=pa.list_(t)) for i, t in enumerate(lists.values())]
                yield pa.RecordBatch.from_arrays(columns, names=["origin", "kind", "block", "data", *lists])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for origin, rows in _by_block(batches):
            sums = 0
            for kind, _, arrays in rows:
                if kind == INFO:
                    valid, ids, sizes = arrays
                else:
                    sums = sums + arrays[0]
            columns = [origin + np.arange(len(sizes)), pa.array(ids, mask=~valid), sizes, sums[0].astype(np.int64), sums[1], sums[2]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["row", "doc_id", "n_tokens", "known", "base", "log"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    answers = None
    for turn in range(ROUNDS):
        forget_shuffles(spark)
        some = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == turn)
        asks = model.table.unionByName(some.mapInArrow(_request(model.blocks, turn), _schema(DEALT)))
        part = stored(_dealt(asks, "block", model.blocks).mapInArrow(run, "origin long, kind int, block int, data binary, row array<long>, h array<long>, a array<double>, p array<double>"))
        answers = part if answers is None else answers.unionByName(part)
        del asks, part, some
    forget_shuffles(spark)
    ordered = _dealt(answers.select("origin", "kind", "block", "data"), "origin", model.blocks)
    done = ordered.mapInArrow(finish, "row long, doc_id long, n_tokens long, known long, base double, log double")
    log = F.col("log")
    if not whole:
        rare = answers.where("row IS NOT NULL").select(F.explode(F.arrays_zip(*lists)).alias("s")).select("s.*").join(model.contexts.select("h", "x", "y"), "h", "left")
        logs = F.log10(F.col("a") * F.coalesce("x", F.lit(0.0)) + F.coalesce("y", F.lit(1.0)) * F.col("p"))
        done = done.join(rare.groupBy("row").agg(F.sum(logs).alias("more")), "row", "left")
        log = log + F.coalesce("more", F.lit(0.0))
    return done.select(
        "doc_id", "n_tokens", F.col("known").alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        log.alias("score"),
        F.pow(F.lit(10.0), -log / F.col("n_tokens")).alias("perplexity"),
    )
