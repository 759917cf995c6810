"""Byte-level BPE: all merges of a rank file replayed over the words of a shard of the corpus.

A shard is a slice of a partition's texts, bounded in bytes. Its distinct words (matches of the
pre-tokenization pattern) are laid out as one array of byte symbols, and an inverted index leads from
the rank of a mergeable pair to the positions where that pair stands. Ranks are taken in order, lowest
first; a merge is applied at all its positions at once, and only the neighbours of these positions are
looked up anew and posted under their new ranks. A posting whose position has changed since is skipped.

The result is that of merging each word alone, lowest rank first and leftmost among equals. Only one
thing could differ: a merge that makes a pair of lower rank than its own while other places of that
rank wait. Words where this occurs are merged alone; so are none in usual vocabularies.

Words and their ids are kept between the shards of a task, up to a bounded number. No text is shuffled.

Defined results: a NULL text is empty and has no ids; ids and texts of any length are handled; rows
are independent, so repeated rows get equal results; no rows give no rows. Input columns with names of
result columns are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from barloom.llm.common import Numbers, free_name, ranges, release, slices

#: Bytes of text in a shard.
SHARD_BYTES = 16 << 20
#: Words kept between shards; beyond that the memory starts anew.
REMEMBERED = 400_000
NEVER = np.int64(1) << 40
#: Ranks that share a drawer of the waiting postings.
DRAWER = 512


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    out = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class Merges:
    """The pairs of tokens that make a token, and the replay."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        missing = [b for b in range(256) if bytes([b]) not in self.rank]
        if missing:
            raise ValueError(f"the rank file has no token for the bytes {missing[:5]}")
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        self.size = len(tokens)
        keys, ranks = [], []
        for token, rank in self.rank.items():
            for i in range(1, len(token)):
                left, right = self.rank.get(token[:i]), self.rank.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    ranks.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.append(np.array(keys, dtype=np.int64)[order], np.int64(1) << 62)
        self.ranks = np.append(np.array(ranks, dtype=np.int64)[order], NEVER)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NEVER`` where it makes no token."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def alone(self, word: bytes) -> list[int]:
        """Ids of one word, merged by itself."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            rank, at = min((self.rank.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of ids of each."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbol = self.byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(symbol)
        # Position n stands for "no neighbour".
        symbol = np.append(symbol, 0)
        word = np.repeat(np.arange(len(words)), sizes)
        after = np.arange(1, n + 2)
        before = np.arange(-1, n)
        ends = np.cumsum(sizes)
        starts = (ends - sizes)[sizes > 0]
        after[ends[sizes > 0] - 1] = n
        before[starts] = n
        rank = np.full(n + 1, NEVER)
        inner = np.flatnonzero(after[:n] < n)
        rank[inner] = self.pair(symbol[inner], symbol[after[inner]])
        alive = np.ones(n + 1, dtype=bool)
        marked = np.zeros(n + 1, dtype=bool)
        odd: list[np.ndarray] = []
        drawers: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def post(ranks: np.ndarray, at: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            drawer = ranks // DRAWER
            cuts = np.flatnonzero(np.diff(drawer)) + 1
            for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(ranks)).tolist()):
                drawers.setdefault(int(drawer[a]), []).append((ranks[a:b], at[a:b]))

        able = np.flatnonzero(rank < NEVER)
        if len(able):
            post(rank[able], able)
        while drawers:
            number = min(drawers)
            index: dict[int, list[np.ndarray]] = {}
            queue: list[int] = []
            while queue or number in drawers:
                for ranks, at in drawers.pop(number, ()):
                    order = np.argsort(ranks, kind="stable")
                    ranks, at = ranks[order], at[order]
                    cuts = np.append(np.flatnonzero(np.diff(ranks)) + 1, len(ranks)).tolist()
                    a = 0
                    for b in cuts:
                        r = int(ranks[a])
                        if r not in index:
                            index[r] = []
                            heapq.heappush(queue, r)
                        index[r].append(at[a:b])
                        a = b
                r = heapq.heappop(queue)
                lists = index.pop(r)
                at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
                at = at[alive[at] & (rank[at] == r)]
                if not len(at):
                    continue
                right = after[at]
                marked[at] = True
                touching = marked[right]
                if touching.any():
                    # Of places that share a symbol, every other one from the left is merged.
                    taken, chosen = -1, []
                    at = np.sort(at)
                    for p, q in zip(at.tolist(), after[at].tolist()):
                        if p != taken:
                            chosen.append(p)
                            taken = q
                    marked[at] = False
                    at = np.array(chosen)
                    right = after[at]
                else:
                    marked[at] = False
                beyond = after[right]
                early = self.pair(np.full(len(at), r), symbol[beyond])
                early[beyond == n] = NEVER
                symbol[at] = r
                alive[right] = False
                rank[right] = NEVER
                after[at] = beyond
                inside = beyond < n
                before[beyond[inside]] = at[inside]
                left = before[at]
                rank[at] = NEVER
                here = at[inside]
                rank[here] = self.pair(symbol[here], symbol[after[here]])
                there = left[left < n]
                rank[there] = self.pair(symbol[there], symbol[after[there]])
                lower = (early < r) | (rank[at] < r)
                if lower.any():
                    odd.append(word[at[lower]])
                lower = rank[there] < r
                if lower.any():
                    odd.append(word[there[lower]])
                new = np.concatenate([here, there])
                new = new[(rank[new] < NEVER) & (rank[new] >= r)]
                if len(new):
                    post(rank[new], new)
        left = np.flatnonzero(alive[:n])
        ids, counts = symbol[left], np.bincount(word[left], minlength=len(words))
        # A word that is a token itself is that token, whether or not merges lead to it.
        apart = {i: [self.rank[w]] for i, w in enumerate(words) if w in self.rank}
        apart.update({int(i): self.alone(words[i]) for part in odd for i in np.unique(part) if int(i) not in apart})
        if apart:
            where = np.zeros(len(words), dtype=bool)
            where[list(apart)] = True
            offsets = np.cumsum(counts) - counts
            keys = sorted(apart)
            fresh_counts = counts.copy()
            fresh_counts[keys] = [len(apart[k]) for k in keys]
            out = np.empty(int(fresh_counts.sum()), dtype=np.int64)
            target = np.cumsum(fresh_counts) - fresh_counts
            same = np.flatnonzero(~where)
            out[ranges(target[same], counts[same])] = ids[ranges(offsets[same], counts[same])]
            out[ranges(target[keys], fresh_counts[keys])] = np.array([x for k in keys for x in apart[k]], dtype=np.int64)
            ids, counts = out, fresh_counts
        return ids, counts


class Lexicon:
    """Words of the shards so far with their ids, as arrays."""

    def __init__(self, merges: Merges, pattern: str):
        self.merges, self.find = merges, regex.compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.ids = np.zeros(0, dtype=np.int32)
        self.counts = np.zeros(0, dtype=np.int64)

    def read(self, texts: pa.Array) -> list[list[int]]:
        """The words of every text as numbers of this lexicon, into which new words go."""
        if len(self.number) > REMEMBERED:
            self.clear()
        number, find, old = self.number, self.find, len(self.number)
        read = [list(map(number.__getitem__, find(texts[i].as_py() or ""))) for i in range(len(texts))]
        if len(number) > old:
            words = list(number)[old:]
            ids, counts = self.merges.replay([w.encode() for w in words])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.counts = np.concatenate([self.counts, counts])
        self.starts = np.cumsum(self.counts) - self.counts
        return read

    def ids_of(self, numbers: list[int]) -> np.ndarray:
        at = np.array(numbers, dtype=np.int64)
        return self.ids[ranges(self.starts[at], self.counts[at])]


class Decoder:
    """Bytes of ids, by one gather from the tokens' bytes."""

    def __init__(self, tokens: list[bytes]):
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[ranges(self.starts[ids], self.sizes[ids])].tobytes()


def _encoder(vocabulary: str, pattern: str, returns: str, row) -> callable:
    """An Arrow function over texts; ``row(ids, decoder)`` makes the result of a text."""

    @arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = read_ranks(vocabulary)
        lexicon, decoder = Lexicon(Merges(tokens), pattern), Decoder(tokens)
        kind = _arrow_type(returns)
        for texts in batches:
            out = []
            for a, b in slices(texts, SHARD_BYTES):
                out += [row(lexicon.ids_of(x), decoder) for x in lexicon.read(texts.slice(a, b - a))]
                release()
            yield pa.array(out, type=kind)

    return run


def _arrow_type(returns: str) -> pa.DataType:
    if returns == "array<int>":
        return pa.list_(pa.int32())
    return pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int)."""
    of = _encoder(vocabulary, pattern, "array<int>", lambda ids, _: ids)
    return docs.withColumn("ids", of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def decode(docs: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``decoded`` (binary): the bytes of the ids, NULL for NULL."""

    @arrow_udf("binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(read_ranks(vocabulary))
        for lists in batches:
            flat = [lists[i].values for i in range(len(lists))]
            yield pa.array([None if x is None else decoder.decode(x.to_numpy()) for x in flat], type=pa.binary())

    return docs.withColumn("decoded", of(F.col(ids_col)))


def _digests(ids: np.ndarray, decoder: Decoder) -> dict:
    text = " ".join(map(str, ids.tolist())).encode()
    return {
        "n_tokens": len(ids),
        "ids_sha256": hashlib.sha256(text).hexdigest(),
        "decoded_sha256": hashlib.sha256(decoder.decode(ids)).hexdigest(),
    }


def digests(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: encoded and decoded in one pass, without storing ids."""
    returns = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    of: Column = _encoder(vocabulary, pattern, returns, _digests)(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    docs = docs.drop(*names)
    found = free_name(docs, "_found")
    return docs.withColumn(found, of).select("*", *[f"{found}.{n}" for n in names]).drop(found)
