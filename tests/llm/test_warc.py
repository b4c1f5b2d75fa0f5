"""Audits find exactly the records that differ, and only look below nodes that do."""

import hashlib

from pyspark.sql import functions as F

from loomframe.llm import warc as W

KIND = "page_id long, url string, html string"


def pages(spark, n=300):
    return spark.createDataFrame([(i, f"http://x/{i}", f"<p>page é {i}</p>" * (i % 7)) for i in range(n)], KIND)


def plain_record(url, html):
    body = (html or "").encode()
    return f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: {url or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_records_and_offsets(spark):
    rows = [(i, f"http://{i}", "<é>" * i) for i in range(40)] + [(None, None, None)] * 3
    got = sorted(W.leaves(spark.createDataFrame(rows, KIND), 2, 4).collect(), key=lambda r: (r["file"], r["start"]))
    want = {(i, hashlib.sha256(plain_record(u, h)).hexdigest(), len(plain_record(u, h))) for i, u, h in rows}
    assert {(r["page_id"], r["digest"], r["length"]) for r in got} == want and len(got) == 41
    assert [r["copies"] for r in got if r["page_id"] is None] == [3]
    for f in (0, 1):
        own, at = [r for r in got if r["file"] == f], 0
        assert [r["n"] for r in own] == sorted(r["n"] for r in own)
        for r in own:
            assert r["start"] == at
            at += r["length"] * r["copies"]


def test_digests_and_roots_against_a_plain_tree(spark):
    """All inner digests by hashlib over the leaves."""
    fanout, n_files, n_slots = 3, 5, 7
    records = W.leaves(pages(spark, 200), n_files, n_slots).cache()
    tree = W.Tree(records, n_files, n_slots, fanout)
    parts = {}
    for r in sorted(records.collect(), key=lambda r: r["start"]):
        parts.setdefault((r["file"], r["n"]), []).append((r["start"], r["length"], r["copies"], r["digest"]))
    level = {k: (v[0][0], v[-1][0] + v[-1][1] * v[-1][2], sha(",".join(f"{a - v[0][0]}:{b}:{c}:{d}" for a, b, c, d in v))) for k, v in parts.items()}
    at = 0
    while True:
        assert {(r["file"], r["n"]): (r["start"], r["end"], r["digest"]) for r in tree.levels[at].collect()} == level
        at += 1
        if at == len(tree.levels):
            break
        if at == tree.in_files:
            level = {(0, f): (0, e - s, d) for (f, _), (s, e, d) in level.items()}
            continue
        over, up = tree.spans[at - 1], {}
        for (f, n), (s, e, d) in sorted(level.items()):
            up.setdefault((f, n // over), []).append((n % over, s, e, d))
        level = {k: (v[0][1], v[-1][2], sha(",".join(f"{n}:{s - v[0][1]}:{e - v[0][1]}:{d}" for n, s, e, d in v))) for k, v in up.items()}
    assert len(level) == 1 and tree.root() == level[0, 0][2]


def test_changed_missing_added(spark):
    a = pages(spark)
    bad, lost = [3, 77, 250], [0, 100, 101, 299]
    b = a.withColumn("html", F.when(F.col("page_id").isin(bad), F.lit("rot")).otherwise(F.col("html"))).filter(~F.col("page_id").isin(lost))
    want = sorted([(p, "changed") for p in bad] + [(p, "missing") for p in lost])
    for fanout, per in ((2, 10), (16, 64), (4, 1000)):
        x, y = W.replicas(a, b, per, fanout)
        assert sorted((r["page_id"], r["state"]) for r in W.audit(x, y).collect()) == want and x.root() != y.root()
    assert sorted((r["page_id"], r["state"]) for r in W.audit(y, x).collect()) == sorted([(p, "changed") for p in bad] + [(p, "added") for p in lost])
    again, _ = W.replicas(a.repartition(7), a, per, fanout)
    assert x.root() == again.root() and W.audit(x, again).count() == 0


def test_same_length_rot_moves_no_neighbour(spark):
    a = pages(spark, 100)
    b = a.withColumn("html", F.when(F.col("page_id") == 13, F.replace("html", F.lit("p"), F.lit("q"))).otherwise(F.col("html")))
    got = W.audit(*W.replicas(a, b, 25, 4)).collect()
    assert [r["page_id"] for r in got] == [13] and got[0]["a_length"] == got[0]["b_length"]


def test_edge_tables(spark):
    empty = spark.createDataFrame([], KIND)
    assert W.audit(*W.replicas(empty, empty)).count() == 0
    rows = [(None, None, None)] * 9 + [(None, "u", str(i)) for i in range(30)] + [(1, "u", "x"), (1, "u", "x"), (2, "u", "long " * 100_000)]
    some = spark.createDataFrame(rows, KIND).withColumns({"file": F.lit("z"), "digest": F.lit(1)})
    assert W.audit(*W.replicas(some, some)).count() == 0
    assert {r["state"] for r in W.audit(*W.replicas(empty, some)).collect()} == {"added"}
    less = spark.createDataFrame(rows[3:20] + rows[21:40] + rows[41:] + [(None, "u", "new"), (None, "u", "newer")], KIND)
    got = sorted((r["page_id"] or 0, r["state"], r["copies"]) for r in W.audit(*W.replicas(some, less, 8, 2)).collect())
    assert got == [(0, "added", 1), (0, "added", 1), (0, "missing", 1), (0, "missing", 3), (1, "missing", 1)]
