import pytest

from barloom.llm import merkle_warc

SCHEMA = "page_id long, url string, html string, id string, volume string, node string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "mine", "mine", "mine") for i, u, h in rows], SCHEMA)


ROWS = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 7)) for i in range(500)] + [(None, None, None), (600, None, "x"), (601, "u", None), (602, "u", ""), (603, "long", "y" * 300_000)]


@pytest.fixture
def small_volumes(monkeypatch):
    monkeypatch.setattr(merkle_warc, "VOLUME", 100)


def found(spark, ours, theirs):
    got = merkle_warc.audit(pages(spark, ours), pages(spark, theirs)).collect()
    return {(r["id"], r["uri"]): r["status"] for r in got}


def test_damage_is_located(spark, small_volumes):
    theirs = [(i, u, "#" + (h or "")[1:]) if i in (3, 77, 603) else (i, u, h) for i, u, h in ROWS if i not in (10, 499)]
    theirs += [(9000, "http://new", "z")]
    want = {("3", "http://x/3"): "changed", ("77", "http://x/77"): "changed", ("603", "long"): "changed"}
    want |= {("10", "http://x/10"): "missing", ("499", "http://x/499"): "missing", ("9000", "http://new"): "extra"}
    assert found(spark, ROWS, theirs) == want


def test_equal_replicas(spark, small_volumes):
    assert found(spark, ROWS, list(reversed(ROWS))) == {}
    assert found(spark, [], []) == {}
    assert found(spark, [], ROWS[:1]) == {("0", "http://x/0"): "extra"}
    assert found(spark, ROWS[:1], []) == {("0", "http://x/0"): "missing"}


def test_repeated_records_count(spark):
    twice = [(1, "u", "a"), (1, "u", "a"), (1, "u", "b"), (2, "u", "c")]
    assert found(spark, twice, twice[::-1]) == {}
    assert found(spark, twice, twice[1:]) == {("1", "u"): "changed"}


def test_offsets_follow_the_records(spark):
    rows = merkle_warc.records(pages(spark, ROWS))
    listed = merkle_warc.manifest(merkle_warc.leaves(rows), 3).collect()
    size = {(r["id"], r["uri"]): len(r["record"]) for r in rows.collect()}
    for volume in range(3):
        end = 0
        for r in sorted((r for r in listed if r["volume"] == volume), key=lambda r: r["node"]):
            assert r["start"] == end and r["end"] - r["start"] == size[(r["id"], r["uri"])]
            end = r["end"]


def test_only_differing_branches_are_visited(spark, small_volumes):
    ours = merkle_warc.leaves(merkle_warc.records(pages(spark, ROWS)))
    listed = merkle_warc.manifest(ours, 6)
    theirs = merkle_warc.leaves(merkle_warc.records(pages(spark, [(i, u, "bad" if i == 42 else h) for i, u, h in ROWS])))
    a, b = merkle_warc.tree(merkle_warc.base_level(ours, listed), 2), merkle_warc.tree(merkle_warc.base_level(theirs, listed), 2)
    roots = a[2].join(b[2], ["volume", "node"]).where(a[2]["digest"] != b[2]["digest"]).collect()
    assert len(roots) == 1
    assert [(r["id"], r["volume"]) for r in merkle_warc.differing(a, b).collect()] == [("42", roots[0]["volume"])]


def test_record_bytes(spark):
    record = merkle_warc.records(pages(spark, [(7, "http://x/é", "<p>é</p>")])).first()["record"]
    head, _, body = bytes(record).partition(b"\r\n\r\n")
    assert body == "<p>é</p>".encode() + b"\r\n\r\n" and b"Content-Length: 9" in head and b"urn:page:7>" in head


def test_roots_cover_extra_records_and_offsets(spark):
    ours = merkle_warc.leaves(merkle_warc.records(pages(spark, ROWS)))
    listed = merkle_warc.manifest(ours, 1)
    root = lambda base: [r["digest"] for r in merkle_warc.tree(base, 3)[3].collect()]
    base = merkle_warc.base_level(ours, listed)
    more = merkle_warc.leaves(merkle_warc.records(pages(spark, [*ROWS, (9000, "http://new", "z")])))
    assert root(base) == root(merkle_warc.base_level(more, listed))
    assert root(base) != root(merkle_warc.base_level(more, listed).unionByName(merkle_warc.strays(more, listed, 1)))
    moved = listed.withColumns({c: listed[c] + 1 for c in ("start", "end")})
    assert root(base) != root(merkle_warc.base_level(ours, moved))
