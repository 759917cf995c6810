"""Best-fit packing: documents into as few sequences of a fixed capacity as best-fit decreasing finds.

A document is cut only if it is longer than a sequence: into whole sequences and, first, the rest that
is shorter. Pieces go to buckets by a hash of the row number they got when they were made, so rows of
equal content spread like any others. A bucket holds some ``BUCKET_ROWS`` pieces whatever the size of the
corpus; its pieces are placed longest first, each into the open sequence with the least room that is
enough. That sequence is found by a segment tree over the amounts of room, in the logarithm of the
capacity. Best fit leaves at most one sequence per bucket that is not more than half full.

Defined results: a NULL text is empty; an empty text is its end id alone; repeated rows are packed each
for itself; equal lengths are placed in the order of their row numbers; no rows give no pieces; only the
named columns are read, so other columns of any name do not matter; a NULL id is an id like any other.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import release, slices, small_batches, stored

CAPACITY = 1024
END_ID = 2
#: Pieces that are placed together.
BUCKET_ROWS = 20_000
#: Bytes of text that are encoded together.
SLICE = 6 << 20
#: Runs that only the tokenizer reads.
LONG_RUN = re.compile(r"\S{4000}|\s{1000}")

# The pattern by which byte-level tokenizers of this kind split texts, and the characters by which
# their files spell bytes (printable ones stand for themselves).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = [chr(b) if b in PRINTABLE else chr(256 + len([x for x in range(b) if x not in PRINTABLE])) for b in range(256)]

PIECES = "doc_id long, piece int, start long, length long, doc_tokens long, ids_crc32 long, ids binary, _task int, _row long"


class ByteIds:
    """Ids of whole texts by a byte-level tokenizer.

    Where the merges make the ids in order, as in usual vocabularies, the same merges run as ranks, several
    times as fast; the tokenizer itself reads texts with strings of added tokens and with very long runs.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as file:
            parts = json.load(file)
        self.added = [t["content"] for t in parts["added_tokens"]]
        model, kind = parts["model"], parts["pre_tokenizer"]
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        ids = [model["vocab"].get(m, -1) for m in merged]
        same = json.loads(ByteLevel(add_prefix_space=False).__getstate__()) == kind and parts["normalizer"] is None
        same = same and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        same = same and ids == sorted(set(ids)) and all(model["vocab"].get(c, len(merged)) < ids[0] for c in BYTES)
        self.ranks = None
        if same:
            import tiktoken

            byte = {c: b for b, c in enumerate(BYTES)}
            ranks = {bytes(map(byte.__getitem__, w)): model["vocab"][w] for w in [*BYTES, *merged]}
            self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each text."""
        out = []
        for text in texts:
            if not text:
                ids = []
            elif self.ranks is None or LONG_RUN.search(text) or any(a in text for a in self.added):
                ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
            else:
                ids = self.ranks.encode_ordinary(text)
            out.append(np.array(ids, dtype="<u4"))
        counts = np.fromiter(map(len, out), dtype=np.int64, count=len(out))
        return np.concatenate([*out, np.zeros(0, dtype="<u4")]), counts


def cut_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents; ``ids`` (little-endian 32-bit ids) are NULL without ``keep_ids``.

    ``_task, _row`` number the pieces; write the table before they are used.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, made = ByteIds(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts, SLICE):
                flat, tokens = encoder.encode(texts.slice(a, b - a).to_pylist())
                flat = np.insert(flat, np.cumsum(tokens), end_id).astype("<u4")
                tokens = tokens + 1
                pieces = -(-tokens // capacity)
                owner = np.repeat(np.arange(len(tokens)), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = tokens - (pieces - 1) * capacity
                start = np.where(piece == 0, 0, first[owner] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[owner], capacity)
                at = 4 * np.concatenate([[0], np.cumsum(length)])
                view = memoryview(flat.tobytes())
                parts = [view[i:j] for i, j in zip(at.tolist(), at[1:].tolist())]
                n = len(parts)
                release()
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(a, b - a).take(pa.array(owner)),
                        pa.array(piece, type=pa.int32()),
                        pa.array(start),
                        pa.array(length),
                        pa.array(tokens[owner]),
                        pa.array(np.fromiter(map(zlib.crc32, parts), dtype=np.int64, count=n)),
                        pa.array([bytes(p) for p in parts], type=pa.binary()) if keep_ids else pa.nulls(n, pa.binary()),
                        pa.array(np.full(n, task), type=pa.int32()),
                        pa.array(np.arange(made, made + n)),
                    ],
                    names=["doc_id", "piece", "start", "length", "doc_tokens", "ids_crc32", "ids", "_task", "_row"],
                )
                made += n

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


class Rooms:
    """Open sequences by the room left in them: a segment tree whose leaves are the amounts of room."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.width)  # open sequences below each node
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        node = room + self.width
        while node:
            self.open[node] += 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Removes the sequence with the least room of ``length`` or more: its number and its room."""
        count, node = self.open, length + self.width
        while not count[node]:
            # Up until there is an unseen subtree to the right that is not empty.
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.width:
            node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.width
        while node:
            count[node] -= 1
            node >>= 1
        return self.bins[room].pop(), room


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """Sequence and offset of each length, in the order given, and the number of sequences."""
    rooms, at, offsets, made = Rooms(capacity), [], [], 0
    for length in lengths:
        found = rooms.take(length)
        if found is None:
            found, made = (made, capacity), made + 1
        number, room = found
        at.append(number)
        offsets.append(capacity - room)
        if room > length:
            rooms.add(room - length, number)
    return at, offsets, made


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns beside ``length``, ``_task`` and ``_row``) with ``sequence_id`` and ``offset``.

    ``pieces`` is read twice, so hand over a stored table.
    """
    buckets = max(1, math.ceil(pieces.count() / BUCKET_ROWS))
    kept = [f for f in pieces.schema if f.name not in ("_task", "_row")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["sequence_id long", "offset long"])

    def fill(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("_task", "ascending"), ("_row", "ascending")])
        at, offsets, _ = best_fit(rows["length"].to_pylist(), capacity)
        base = rows["_bucket"][0].as_py() << 32
        rows = rows.drop_columns(["_task", "_row", "_bucket"])
        return rows.append_column("sequence_id", pa.array(np.array(at, dtype=np.int64) + base)).append_column("offset", pa.array(offsets, type=pa.int64()))

    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("_task", "_row"), F.lit(buckets)))
    return dealt.groupBy("_bucket").applyInArrow(fill, schema)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Packed pieces with their ids; without ``keep_ids`` a checksum stands for them in what is stored and shuffled."""
    pieces = cut_documents(docs, vocabulary, id_col, text_col, capacity, end_id, keep_ids)
    return place(stored(pieces if keep_ids else pieces.drop("ids")), capacity)
