import hashlib
import re
import zlib
from itertools import groupby

import numpy as np
from brute import with_clashes
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from barloom.llm import conversation_repair
from barloom.llm.conversation_repair import SYMBOLS, Transfers, best_states, damage, prepare, repair_pairs, repaired_rows, summaries

LEGAL = re.compile("(s?(ua)+)?")
ROWS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def slow_audit(symbols):
    """Cheapest edits by trying all of them, up to three rows inserted at a place."""
    best = (10**9, "")

    def go(at, cost, audit, roles, inserted):
        nonlocal best
        if cost > best[0]:
            return
        if at == len(symbols) and LEGAL.fullmatch(roles):
            best = min(best, (cost, audit))
        if inserted < 3:
            for c in "ua":
                go(at, cost + 2, audit + "I", roles + c, inserted + 1)
        if at < len(symbols):
            fault, role = divmod(symbols[at], 4)
            go(at + 1, cost + 3, audit + "D", roles, 0)
            if fault < 2:
                go(at + 1, cost + fault, audit + "K", roles + "suax"[role], 0)
                for c in "ua":
                    go(at + 1, cost + 2 + fault, audit + "R", roles + c, 0)

    go(0, 0, "", "", 0)
    return best


def slow_long(symbols):
    """The same row by row: the least cost and audit by what the roles so far allow next."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserts(states):
        for _ in range(3):
            for state, (cost, audit) in list(states.items()):
                for c in "ua":
                    if (state, c) in step:
                        new = (cost + 2, audit + "I")
                        states[step[state, c]] = min(states.get(step[state, c], new), new)
        return states

    states = {"": (0, "")}
    for symbol in symbols:
        fault, role = divmod(symbol, 4)
        out = {}
        for state, (cost, audit) in inserts(states).items():
            ways = [(state, 3, "D")]
            if fault < 2:
                ways += [(step.get((state, "suax"[role])), fault, "K")] + [(step.get((state, c)), 2 + fault, "R") for c in "ua"]
            for to, more, edit in ways:
                if to is not None:
                    new = (cost + more, audit + edit)
                    out[to] = min(out.get(to, new), new)
        states = out
    return min(v for k, v in inserts(states).items() if k in ("", "a"))


def solved(sequences, cuts=()):
    """Costs and audits of sequences, each cut into pieces at the given places."""
    parts = [[p for a, b in zip([0, *cuts], [*cuts, len(s)]) if (p := s[a:b])] for s in sequences]
    different = list(dict.fromkeys(p for s in parts for p in s))
    transfers, out = Transfers(different), []
    for some in parts:
        which = [different.index(p) for p in some]
        cost, states = best_states([(transfers.cost[w], transfers.rank[w]) for w in which])
        audit = "".join(transfers.audits(np.array(which, dtype=np.int64), states[:-1], states[1:]))
        out.append((cost, audit + "I" * int(conversation_repair.CLOSING[states[-1]])))
    return out


SEQUENCE = st.lists(st.integers(0, SYMBOLS - 1), min_size=1, max_size=3).map(bytes)


@settings(max_examples=150, deadline=None)
@given(SEQUENCE)
def test_all_edits_tried(symbols):
    want = slow_audit(symbols)
    assert slow_long(symbols) == want and solved([symbols]) == [want]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 1, 2, 3, 5, 6, 9, 12]), min_size=1, max_size=40).map(bytes), min_size=1, max_size=12), st.integers(1, 15), st.integers(16, 30))
def test_shared_rules_and_pieces(sequences, first, second):
    assert solved(sequences, (first, second)) == [slow_long(s) for s in sequences]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([1, 2]), max_size=60).map(bytes), max_size=10), st.integers(0, 20))
def test_rules_spell_the_sequences(sequences, most):
    rules, written = repair_pairs(sequences, most)
    assert len(rules) <= most

    def spell(symbol):
        return bytes([symbol]) if symbol < SYMBOLS else b"".join(map(spell, rules[symbol - SYMBOLS]))

    assert [b"".join(map(spell, s.tolist())) for s in written] == sequences


def slow(rows):
    """Results of the query for ``(conv_id, turn, role, text)`` rows."""
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(key.encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        mine += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = {}
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, symbols = set(), []
        for _, role, text in mine:
            core = text.rstrip("\t\n\x0b\x0c\r ")
            fault = 3 if not core else 2 if (role, text) in seen else 0 if core[-1] in ".!?" else 1
            seen.add((role, text))
            symbols.append(4 * fault + ("sua".index(role[0]) if role[:1] and role[0] in "sua" else 3))
        roles = [r[1][:1] for r in mine]
        turns = [r[0] for r in mine if r[0] is not None]
        cost, audit = slow_long(symbols)
        lines, at, state = [], 0, ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else mine[at][1:]
            at += edit != "I"
            if edit == "D":
                continue
            role = role if edit == "K" else "assistant" if state == "u" else "user"
            state = role[0]
            lines.append(f"{role}:{text}")
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            sum(s // 4 == 3 for s in symbols),
            sum(s // 4 == 2 for s in symbols),
            sum(s // 4 == 1 for s in symbols),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def result(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert df.columns == names
    rows = df.collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r[1:]) for r in rows}


def query(df):
    rows, gone = damage(df)
    return summaries(prepare(rows, gone=gone))


HARD = [
    (1, 1, "system", "Be kind."), (1, 2, "user", "Hello?"), (1, 2, "user", "Hello?"), (1, 4, "assistant", "Hi"), (1, 5, "assistant", " \t\x0b"), (1, None, "user", "First."), (1, None, None, None),
    (2, None, "user", None), (2, None, None, "x."),
    (None, 1, "user", "No id."), (None, 1, "assistant", "None."), (None, None, "narrator", "Dusk. "),
    (3, -5, "assistant", "a."), (3, 2**40, "user", "日本語。"), (3, 7, "", "?"),
    (5, 1, "user", "Long. " * 20000), (5, 2, "assistant", "End!"),
] + [(i, t, r, f"{x} {i}.") for i in range(10, 60) for t, (r, x) in enumerate([("system", "s"), ("user", "q"), ("assistant", "a"), ("user", "q"), ("assistant", "a2")])]


def test_hard_rows(spark):
    df = spark.createDataFrame(HARD, ROWS).repartition(5)
    want = slow(HARD)
    assert result(query(with_clashes(df.withColumn("gone", F.lit("mine"))))) == want


def test_conversation_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "PART_ROWS", 60)
    rows = [(7, t // 2, "user" if t % 3 else "assistant", f"Text {t % 90}{'.' if t % 5 else ''}") for t in range(700)]
    rows += [(8, 3, "user", "Same.")] * 400 + HARD
    rows += [(9, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(1, 301)]
    assert result(query(spark.createDataFrame(rows, ROWS).repartition(4))) == slow(rows)


def test_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    want = slow([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert result(query(df)) == want
    assert any("R" in v[6] for v in want.values()) and any("I" in v[6] for v in want.values()) and any("D" in v[6] for v in want.values())


def test_all_rows_dropped(spark):
    lost = [(c, 1, "user", "x.") for c in range(200) if zlib.crc32(f"{c}:1".encode()) % 20 == 0]
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert lost and result(query(spark.createDataFrame(lost, ROWS))) == {c: empty for c, *_ in lost}


def test_repaired_rows_are_legal(spark):
    df = spark.createDataFrame(HARD, ROWS)
    prepared = prepare(df)
    audits = {r["conv_id"]: r["audit"] for r in summaries(prepared).collect()}
    rows = repaired_rows(prepared).collect()
    rows.sort(key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0, r["position"]))
    for conv, mine in groupby(rows, key=lambda r: r["conv_id"]):
        mine = list(mine)
        assert "".join(r["edit"] for r in mine) == audits[conv]
        assert LEGAL.fullmatch("".join(r["role"][0] for r in mine if r["role"] is not None))
        assert all(r["text"] == "" for r in mine if r["edit"] == "I") and all((r["role"] is None) == (r["edit"] == "D") for r in mine)


def test_no_rows(spark):
    assert query(spark.createDataFrame([], ROWS)).count() == 0
