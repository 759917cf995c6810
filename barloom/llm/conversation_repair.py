"""Conversation repair: the cheapest edits that bring every conversation's roles into a legal order.

A row is a symbol: the initial of its role (``s``, ``u``, ``a`` or another) and its fault (blank, duplicate,
truncated or none). Keeping a row costs nothing, another role (user or assistant) 2, deleting it 3, an
inserted empty row 2, and a truncated row that stays 1; blank rows and duplicates must go. The roles that
remain are ``(s?(ua)+)?``, which an automaton of four states reads. A sequence of symbols is a min-plus matrix over
these states whose entries are a cost and an audit, the initials of the edits in order.

Sequences are compressed by Re-Pair: the most frequent pair of symbols becomes a rule, again and again, over
all different sequences of a slice of conversations. The matrix of a rule comes from those of its two parts, bottom-up;
conversations share rules, and equal sequences share everything. An audit is a rope: per entry the state in
which left and right part meet. Ropes are spelt out for the chosen entries alone. Of equal costs the
audit that is least in ASCII wins. That needs no spelt audits: every audit of n rows holds n letters other
than ``I`` and ends in one of them, so none begins another, and of two sequences' audits the left parts'
order comes before the right parts'. The 16 entries of a matrix carry their places in that order.

Work on rows is dealt by ranges of (conversation, turn), so a long conversation is spread over many tasks.
Each of them hands on one matrix of fixed size and one byte per row; there are no more matrices of a conversation than tasks.
The repaired rows and their SHA-256 come from a pass in which the rows of a conversation stream in order
through one task, which holds its audit (a byte per row, as the result does) and no texts.

Defined results: a NULL role or text is one space; rows go by turn (NULL first), rows of one turn by role and
the MD5 of the text; of repeated rows the first stays; a NULL conversation id is a conversation; no rows
give no rows; only the named columns are read, so other columns of any name do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import Numbers, small_batches, stored

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
#: What a row's role begins with; anything else is the last class.
INITIALS = "sua"
CLASSES = len(INITIALS) + 1
#: Faults as they stand in a symbol, and the symbol of a row that is not there.
SOUND, TRUNCATED, DUPLICATE, BLANK = range(4)
SYMBOLS = 4 * CLASSES
GONE = SYMBOLS
WHITE = "\t\n\x0b\x0c\r "

#: The automaton: nothing read, after s, after u, after a.
STATES = 4
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Rows to insert at the end.
CLOSING = np.array([0, 2, 1, 0])
INSERTED = {0: b"user", 1: b"user", 2: b"assistant", 3: b"user"}
NEVER = 1 << 28

#: Rules that a slice may have.
RULES = 256
#: Rows that one task turns into matrices, and symbols whose audits are spelt together.
PART_ROWS = 200_000

PIECES = "conv_id {id}, part int, n long, symbols binary, costs array<int>, ranks array<int>, blank long, duplicate long, truncated long, illegal long, first int, last int, turns long, low long, high long"
STATS = ("blank", "duplicate", "truncated", "illegal")


def _terminals() -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Costs, ranks and audits of one row by its symbol; rows are inserted before it."""
    far = np.full((STATES, STATES), NEVER)
    for start in range(STATES):
        state, n = start, 0
        while far[start, state] == NEVER:  # only user or assistant can be inserted, so there is one way on
            far[start, state] = n
            state, n = next(STEP[state, c] for c in "ua" if (state, c) in STEP), n + 1
    costs = np.full((SYMBOLS, STATES, STATES), NEVER, dtype=np.int64)
    audits = []
    for symbol in range(SYMBOLS):
        fault, role = divmod(symbol, CLASSES)
        best = {}
        for i in range(STATES):
            for k in range(STATES):
                if far[i, k] == NEVER:
                    continue
                ways = [(k, DELETE, 0)]
                if fault in (SOUND, TRUNCATED):
                    fine = TRUNCATED_COST * (fault == TRUNCATED)
                    ways += [(STEP[k, c], REROLE, fine) for c in "ua" if (k, c) in STEP]
                    if role < len(INITIALS) and (k, INITIALS[role]) in STEP:
                        ways.append((STEP[k, INITIALS[role]], KEEP, fine))
                for j, edit, fine in ways:
                    way = (int(far[i, k]) * COST[INSERT] + COST[edit] + fine, INSERT * int(far[i, k]) + edit)
                    best[i, j] = min(best.get((i, j), (NEVER, "~")), way)
        for (i, j), (cost, _) in best.items():
            costs[symbol, i, j] = cost
        audits.append([best.get((i, j), (NEVER, "~"))[1] for i in range(STATES) for j in range(STATES)])
    ranks = np.array([[sum(b < a for b in some) for a in some] for some in audits]).reshape(-1, STATES, STATES)
    return costs, ranks, audits


TERMINAL_COSTS, TERMINAL_RANKS, TERMINAL_AUDITS = _terminals()


def compose(costs: np.ndarray, ranks: np.ndarray, more_costs: np.ndarray, more_ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs and ranks of sequences one after the other, and the states in which they meet."""
    total = costs[:, :, :, None] + more_costs[:, None, :, :]
    order = ranks[:, :, :, None] * STATES**2 + more_ranks[:, None, :, :]
    meet = np.argmin(total * STATES**4 + order, axis=2)
    at = meet[:, :, None, :]
    total = np.minimum(np.take_along_axis(total, at, 2)[:, :, 0], NEVER)
    order = np.take_along_axis(order, at, 2)[:, :, 0].reshape(-1, 1, STATES**2)
    place = (order < order.transpose(0, 2, 1)).sum(axis=2).reshape(-1, STATES, STATES)
    return total, place, meet


def repair_pairs(sequences: list[bytes], most: int = RULES) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Re-Pair: rules as pairs of symbols or earlier rules, and the sequences written with them."""
    lengths = np.fromiter(map(len, sequences), dtype=np.int64, count=len(sequences))
    ends = np.cumsum(lengths + 1)
    text = np.full(int(ends[-1]) if len(ends) else 0, -1, dtype=np.int64)  # -1 stands between sequences
    inside = np.ones(len(text), dtype=bool)
    inside[ends - 1] = False
    text[inside] = np.frombuffer(b"".join(sequences), dtype=np.uint8)
    rules: list[tuple[int, int]] = []
    width = SYMBOLS + most
    while len(rules) < most and len(text) > 1:
        pairs = np.where((text[:-1] >= 0) & (text[1:] >= 0), text[:-1] * width + text[1:], width * width)
        counts = np.bincount(pairs, minlength=width * width)[: width * width]
        pair = int(counts.argmax())
        if counts[pair] < 2:
            break
        at = np.flatnonzero(pairs == pair)
        left, right = divmod(pair, width)
        if left == right:  # of places that overlap, every other one from the left
            starts = np.flatnonzero(np.diff(at, prepend=-2) > 1)
            at = at[(np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))) % 2 == 0]
        text[at] = SYMBOLS + len(rules)
        rules.append((left, right))
        stays = np.ones(len(text), dtype=bool)
        stays[at + 1] = False
        text = text[stays]
    cuts = np.flatnonzero(text < 0)
    return rules, [text[a:b] for a, b in zip(np.append(0, cuts[:-1] + 1).tolist(), cuts.tolist())]


class Transfers:
    """Matrices of sequences of symbols, and the audits of their entries."""

    def __init__(self, sequences: list[bytes]):
        """``sequences`` differ from each other and are not empty."""
        self.rules, written = repair_pairs(sequences)
        costs, ranks = [*TERMINAL_COSTS], [*TERMINAL_RANKS]
        self.meets: list[np.ndarray] = []
        for left, right in self.rules:
            cost, rank, meet = compose(costs[left][None], ranks[left][None], costs[right][None], ranks[right][None])
            costs.append(cost[0])
            ranks.append(rank[0])
            self.meets.append(meet[0])
        sizes = np.fromiter(map(len, written), dtype=np.int64, count=len(written))
        self.base = np.concatenate([*written, np.zeros(0, dtype=np.int64)])
        cost, rank = np.array(costs)[self.base], np.array(ranks)[self.base]
        # Neighbours are put together until one matrix per sequence is left.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(sizes) and sizes.max() > 1:
            starts = np.cumsum(sizes) - sizes
            halves = (sizes + 1) // 2
            first = np.repeat(starts, halves) + 2 * (np.arange(halves.sum()) - np.repeat(np.cumsum(halves) - halves, halves))
            double = first + 1 < np.repeat(starts + sizes, halves)
            both = first[double]
            joined, places, meet = compose(cost[both], rank[both], cost[both + 1], rank[both + 1])
            cost, rank = cost[first], rank[first]
            cost[double], rank[double] = joined, places
            meets = np.zeros(cost.shape, dtype=np.int8)
            meets[double] = meet
            self.levels.append((first, double, meets))
            sizes = halves
        self.cost, self.rank = cost, rank
        self.ropes: dict[tuple[int, int, int], str] = {}

    def _rope(self, symbol: int, i: int, j: int) -> str:
        key = (symbol, i, j)
        if key not in self.ropes:
            if symbol < SYMBOLS:
                self.ropes[key] = TERMINAL_AUDITS[symbol][i * STATES + j]
            else:
                (left, right), k = self.rules[symbol - SYMBOLS], int(self.meets[symbol - SYMBOLS][i, j])
                self.ropes[key] = self._rope(left, i, k) + self._rope(right, k, j)
        return self.ropes[key]

    def audits(self, which: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[str]:
        """Audits of entries ``(i, j)`` of sequences ``which``."""
        node, i, j, asked = np.asarray(which), np.asarray(i), np.asarray(j), np.arange(len(which))
        for first, double, meets in reversed(self.levels):
            two = double[node]
            k = np.where(two, meets[node, i, j], j)
            n = 1 + two
            at = np.cumsum(n) - n
            second = at[two] + 1
            node, asked, i, j, k, left = (np.repeat(x, n) for x in (first[node], asked, i, j, k, ~two))
            last = j.copy()
            j = np.where(left, j, k)
            node[second] += 1
            i[second], j[second] = k[second], last[second]
        out: list[list[str]] = [[] for _ in which]
        for to, symbol, a, b in zip(asked.tolist(), self.base[node].tolist(), i.tolist(), j.tolist()):
            out[to].append(self._rope(symbol, a, b))
        return ["".join(parts) for parts in out]


def best_states(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[int, list[int]]:
    """Cost of a conversation given as matrices in order, and the states between them and at the end."""
    cost, rank, ways = COST[INSERT] * CLOSING, CLOSING, []
    for costs, ranks in reversed(pieces):
        total, order = costs + cost, ranks * STATES**2 + rank
        way = np.argmin(total * STATES**4 + order, axis=1)
        at = np.arange(STATES)
        cost, order = np.minimum(total[at, way], NEVER), order[at, way]
        rank = (order[None, :] < order[:, None]).sum(axis=1)
        ways.append(way)
    states = [0]
    for way in reversed(ways):
        states.append(int(way[states[-1]]))
    return int(cost[0]), states


def _solve(sequences: list[bytes]) -> tuple[Transfers, np.ndarray]:
    """Transfers of the different sequences, and the place of each given one among them."""
    number = Numbers()
    which = np.fromiter((number[s] for s in sequences), dtype=np.int64, count=len(sequences))
    return Transfers(list(number)), which


def prepare(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone: Column | None = None) -> DataFrame:
    """The rows in the form that the other steps read, written once.

    Rows for which ``gone`` is true only say that the conversation exists.
    """
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(" "))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    trimmed = F.rtrim(text, F.lit(WHITE))
    kind = F.lit(CLASSES - 1)
    for i, c in enumerate(INITIALS):
        kind = F.when(role.startswith(c), i).otherwise(kind)
    fault = F.when(trimmed == "", BLANK).when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    return stored(
        rows.select(
            F.col(conv_col).alias("conv_id"),
            F.col(turn_col).cast("long").alias("turn"),
            role.cast("binary").alias("role"),
            text.cast("binary").alias("text"),
            F.unhex(F.md5(text.cast("binary"))).alias("key"),
            fault.alias("fault"),
            kind.alias("kind"),
            (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("gone"),
            F.monotonically_increasing_id().alias("row"),
        )
    )


ORDER = ("conv_id", "turn", "role", "key", "row")


def symbols(prepared: DataFrame) -> DataFrame:
    """``conv_id, turn, role, key, row, symbol``: faults of a row alone, and duplicates by the first row of their kind.

    First rows are found by an aggregate and meet the rows by row number, so no group of equal rows comes together.
    """
    there = prepared.where(~F.col("gone"))
    first = there.groupBy("conv_id", "role", "key").agg(F.min(F.struct("turn", "row")).alias("least")).select(F.col("least.row").alias("row"), F.lit(True).alias("first"))
    fault = F.when((F.col("fault") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    symbol = F.when(F.col("gone"), GONE).otherwise(fault * CLASSES + F.col("kind"))
    return prepared.select(*ORDER, "fault", "kind", "gone").join(first, "row", "left").select(*ORDER, symbol.cast("int").alias("symbol"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order: a row per conversation with what this task has of it."""
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return
    part = TaskContext.get().partitionId()
    runs = pc.run_end_encode(table["conv_id"].combine_chunks())
    ids, ends = runs.values, runs.run_ends.to_numpy()
    m = len(ids)
    owner = np.repeat(np.arange(m), np.diff(ends, prepend=0))
    symbol = table["symbol"].to_numpy()
    there = symbol != GONE
    owner, symbol = owner[there], symbol[there].astype(np.uint8)
    turn = table["turn"].combine_chunks()
    dated = turn.is_valid().to_numpy(zero_copy_only=False)[there]
    turn = pc.fill_null(turn, 0).to_numpy()[there]
    count = lambda mask: np.bincount(owner[mask], minlength=m)
    n = np.bincount(owner, minlength=m)
    fault, kind = symbol // CLASSES, (symbol % CLASSES).astype(np.int64)
    same = owner[1:] == owner[:-1]
    legal = np.isin(kind[:-1] * CLASSES + kind[1:], [INITIALS.index(a) * CLASSES + INITIALS.index(b) for a, b in ("su", "ua", "au")])
    new = dated.copy()
    new[1:] &= ~(same & dated[:-1] & (turn[1:] == turn[:-1]))
    low, high = np.full(m, np.iinfo(np.int64).max), np.full(m, np.iinfo(np.int64).min)
    np.minimum.at(low, owner[dated], turn[dated])
    np.maximum.at(high, owner[dated], turn[dated])
    undated = low > high
    first, last = np.zeros(m, dtype=np.int32), np.zeros(m, dtype=np.int32)
    starts = np.cumsum(n) - n
    first[n > 0], last[n > 0] = kind[starts[n > 0]], kind[(starts + n - 1)[n > 0]]
    text = symbol.tobytes()
    sequences = [text[a : a + k] for a, k in zip(starts.tolist(), n.tolist())]
    transfers, which = _solve([s for s in sequences if s])
    costs, ranks = np.zeros((m, STATES**2), dtype=np.int32), np.zeros((m, STATES**2), dtype=np.int32)
    if len(which):
        costs[n > 0] = transfers.cost[which].reshape(-1, STATES**2)
        ranks[n > 0] = transfers.rank[which].reshape(-1, STATES**2)
    offsets = pa.array(np.arange(0, STATES**2 * (m + 1), STATES**2, dtype=np.int32))
    columns = {
        "conv_id": ids,
        "part": pa.array(np.full(m, part, dtype=np.int32)),
        "n": pa.array(n),
        "symbols": pa.array(sequences, type=pa.binary()),
        "costs": pa.ListArray.from_arrays(offsets, pa.array(costs.ravel())),
        "ranks": pa.ListArray.from_arrays(offsets, pa.array(ranks.ravel())),
        "blank": pa.array(count(fault == BLANK)),
        "duplicate": pa.array(count(fault == DUPLICATE)),
        "truncated": pa.array(count(fault == TRUNCATED)),
        "illegal": pa.array(np.bincount(owner[1:][same & ~legal], minlength=m)),
        "first": pa.array(first),
        "last": pa.array(last),
        "turns": pa.array(count(new)),
        "low": pa.array(low, mask=undated),
        "high": pa.array(high, mask=undated),
    }
    for a in range(0, m, 10_000):
        yield pa.RecordBatch.from_arrays([c.slice(a, 10_000) for c in columns.values()], names=list(columns))


def pieces(prepared: DataFrame) -> DataFrame:
    """Matrices and counts of conversations, a row per conversation and task that has rows of it."""
    parts, found = max(1, math.ceil(prepared.count() / PART_ROWS)), symbols(prepared)
    dealt = found.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER)
    return dealt.select("conv_id", "turn", "symbol").mapInArrow(_pieces, PIECES.format(id=found.schema["conv_id"].dataType.simpleString()))


class Plan:
    """What is to be done with a conversation: cost, audit and counts."""

    __slots__ = ("audit", "cost", "counts", "gaps")

    def __init__(self, rows: list[dict], cost: int, audit: str):
        rows = [r for r in rows if r["n"]]
        self.cost, self.audit = cost, audit
        self.counts = {c: sum(r[c] for r in rows) for c in STATS}
        legal = {(INITIALS.index(a), INITIALS.index(b)) for a, b in ("su", "ua", "au")}
        self.counts["illegal"] += sum((a["last"], b["first"]) not in legal for a, b in zip(rows, rows[1:]))
        dated = [r for r in rows if r["low"] is not None]
        turns = sum(r["turns"] for r in dated) - sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:]))
        self.gaps = dated[-1]["high"] - dated[0]["low"] + 1 - turns if dated else 0


def _plans(found: dict) -> Iterator[tuple[object, Plan]]:
    """Plans of conversations, given their pieces in order; audits are spelt a bounded number of rows at a time."""
    work: list[tuple[object, list[dict], int, list[int]]] = []
    room = PART_ROWS

    def spell() -> Iterator[tuple[object, Plan]]:
        flat = [(r, states[k], states[k + 1]) for _, rows, _, states in work for k, r in enumerate(x for x in rows if x["n"])]
        audits: list[str] = []
        at = 0
        while at < len(flat):
            upto, size = at, 0
            while upto < len(flat) and (upto == at or size + flat[upto][0]["n"] <= PART_ROWS):
                size += flat[upto][0]["n"]
                upto += 1
            transfers, which = _solve([r["symbols"] for r, _, _ in flat[at:upto]])
            audits += transfers.audits(which, [i for _, i, _ in flat[at:upto]], [j for _, _, j in flat[at:upto]])
            at = upto
        at = 0
        for conv, rows, cost, states in work:
            n = len(states) - 1
            yield conv, Plan(rows, cost, "".join(audits[at : at + n]) + INSERT * int(CLOSING[states[-1]]))
            at += n

    for conv, rows in found.items():
        shape = (STATES, STATES)
        cost, states = best_states([(np.array(r["costs"]).reshape(shape), np.array(r["ranks"]).reshape(shape)) for r in rows if r["n"]])
        work.append((conv, rows, cost, states))
        room -= sum(r["n"] for r in rows)
        if room <= 0:
            yield from spell()
            work, room = [], PART_ROWS
    yield from spell()


def _edits(audit: str, rows: Iterator[tuple[bytes, bytes]]) -> Iterator[tuple[str, bytes | None, bytes | None]]:
    """Every edit with the role and text that it leaves; deleted rows leave none."""
    state = 0
    for edit in audit:
        role, text = (INSERTED[state], b"") if edit == INSERT else next(rows)
        if edit == DELETE:
            yield edit, None, None
            continue
        if edit == REROLE:
            role = INSERTED[state]
        state = STEP[state, chr(role[0])]
        yield edit, role, text


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Plan, Iterator[tuple[str, bytes | None, bytes | None]]]]:
    """Conversations with their plans and edits, of pieces followed by rows in order."""
    found: dict[object, list[dict]] = {}
    rows: Iterator[tuple] = iter(())

    def live() -> Iterator[tuple[object, bytes, bytes]]:
        for batch in batches:
            pieces_here = int(pc.sum(batch["is_piece"]).as_py() or 0)
            for r in batch.slice(0, pieces_here).column(batch.schema.get_field_index("piece")).to_pylist():
                found.setdefault(r["conv_id"], []).append(r)
            if pieces_here < batch.num_rows:
                rest = batch.slice(pieces_here)
                yield from zip(rest["conv_id"].to_pylist(), rest["role"].to_pylist(), rest["text"].to_pylist())

    rows = live()
    ahead = next(rows, None)  # all pieces have been read when the first row comes
    plans = dict(_plans(found))
    found.clear()

    while ahead is not None:
        conv = ahead[0]

        def own(conv=conv) -> Iterator[tuple[bytes, bytes]]:
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:
                now, ahead = ahead, next(rows, None)
                yield now[1:]

        mine = own()
        plan = plans.pop(conv)
        yield conv, plan, _edits(plan.audit, mine)
        for _ in mine:
            raise ValueError("a conversation has more rows than its audit")
    for conv, plan in plans.items():  # no rows are left of these
        yield conv, plan, iter(())


def _together(prepared: DataFrame) -> DataFrame:
    """Pieces, and after them the rows, of each conversation in one partition."""
    planned = stored(pieces(prepared))
    names = [f.name for f in planned.schema]
    first = planned.select("conv_id", F.lit(1).alias("is_piece"), F.struct(*names).alias("piece"), F.col("part").cast("long").alias("turn"))
    live = prepared.where(~F.col("gone")).select("conv_id", F.lit(0).alias("is_piece"), "turn", "role", "text", "key", "row")
    both = first.unionByName(live, allowMissingColumns=True)
    small_batches(prepared.sparkSession)
    return both.repartition("conv_id").sortWithinPartitions(F.desc("is_piece"), "conv_id", "turn", "role", "key", "row").select("conv_id", "is_piece", "piece", "role", "text")


def _id_type(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


def repaired_rows(prepared: DataFrame) -> DataFrame:
    """``conv_id, position, edit, role, text``: an edit per row, in order; role and text are NULL where a row is deleted."""
    schema = f"conv_id {_id_type(prepared)}, position long, edit string, role string, text string"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        kind = None

        def made() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 5
            kinds = [kind, pa.int64(), pa.string(), pa.binary(), pa.binary()]
            arrays = [pa.array(c, type=k) for c, k in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays([*arrays[:3], *(a.cast(pa.string()) for a in arrays[3:])], names=["conv_id", "position", "edit", "role", "text"])

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                yield batch

        size = 0
        for conv, _, edits in _stream(seen()):
            for position, (edit, role, text) in enumerate(edits):
                out.append((conv, position, edit, role, text))
                size += 50 + len(text or b"")
                if size > 4 << 20:
                    yield made()
                    out, size = [], 0
        if out:
            yield made()

    return _together(prepared).mapInArrow(write, schema)


def summaries(prepared: DataFrame) -> DataFrame:
    """A row per conversation: ``gaps``, faults, ``illegal``, ``cost``, ``audit`` and the SHA-256 of the repaired ``role:text`` lines."""
    schema = f"conv_id {_id_type(prepared)}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    names = ["conv_id", "gaps", *STATS, "cost", "audit", "repaired_sha256"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                yield batch

        def made(out: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out), kinds)], names=names)

        out: list[tuple] = []
        size = 0
        for conv, plan, edits in _stream(seen()):
            digest, between = hashlib.sha256(), b""
            for _, role, text in edits:
                if role is not None:
                    digest.update(b"".join((between, role, b":", text)))
                    between = b"\n"
            out.append((conv, plan.gaps, *(plan.counts[c] for c in STATS), plan.cost, plan.audit, digest.hexdigest()))
            size += 200 + len(plan.audit)
            if size > 4 << 20:
                yield made(out)
                out, size = [], 0
        if out:
            yield made(out)

    return _together(prepared).mapInArrow(write, schema)


def damage(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """The rows with the damage that their ids ask for, and the condition under which a row is dropped."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    bucket = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text, role = text_of("text"), text_of("role")
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(bucket == 4, "user").otherwise(role).alias("role"),
        F.when(bucket == 1, "").when(bucket == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (bucket == 0).alias("gone"),
        F.explode(F.when(bucket == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows, F.col("gone")
