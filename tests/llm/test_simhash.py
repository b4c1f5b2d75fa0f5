"""Fingerprints, links and groups against brute force over all pairs."""

import random
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from loomframe.llm import simhash as S
from loomframe.llm.components import components


def plain_fp(text, n=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    out = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(g, 42) >> bit & 1 for g in grams) > len(grams):
            out |= 1 << bit
    return out


def plain_components(nodes, linked):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(nodes, 2):
        if linked(a, b):
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def corpus():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    out = [None, "", " \n", "one", "One two", "one two three", "É x É", "a b c d"]
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.randint(5, 150))]
        out.append(" ".join(base))
        for _ in range(r.randint(0, 5)):
            near = list(base)
            near[r.randrange(len(near))] = r.choice(vocabulary)
            out.append(" ".join(near).upper() if r.random() < 0.3 else " ".join(near))
    return out + out[8:12]


def test_fingerprints_and_components(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = [plain_fp(t) for t in texts]
    want = plain_components(range(len(texts)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    for cap in (100, 1):  # 1 sends every crowded bucket the second way
        got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.near_duplicates(docs, bucket_cap=cap).collect()}
        assert got == {i: (f"{fps[i]:016x}", want[i]) for i in range(len(texts))}


def test_links_of_close_fingerprints(spark):
    r = random.Random(9)
    fps = set()
    for _ in range(30):
        base = r.getrandbits(64)
        fps.add(base)
        for _ in range(12):
            x = base
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = plain_components(sorted(signed), lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2)
    for cap in (100, 3):
        label = {r["node"]: r["label"] for r in components(S.hamming_links(df, cap)).collect()}
        groups = {}
        for x in signed:
            groups.setdefault(label.get(x, x), set()).add(x)
        plain = {}
        for x, y in want.items():
            plain.setdefault(y, set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_long_path_is_one_component(spark):
    df = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(df).collect()
    assert len(got) == 301 and len({r["label"] for r in got}) == 1
    assert components(df.limit(0)).count() == 0


def test_components_end_in_few_jobs(spark):
    """A long path took a dozen rounds of jobs, however few its links were; the driver keeps something of each."""
    node = lambda c: F.struct((c % 7).alias("x"), c.alias("id"))
    df = spark.range(299).select(node(F.col("id")).alias("a"), node(F.col("id") + F.when(F.col("id") % 100 == 50, 0).otherwise(1)).alias("b"))
    jobs = lambda: int(str(spark.sparkContext._jsc.sc().dagScheduler().nextJobId()))
    began = jobs()
    got = [components(df).collect()]
    assert jobs() - began <= 8
    got += [components(df, few_links=n).collect() for n in (0, 40)]
    for rows in got:
        groups = {}
        for r in rows:
            groups.setdefault(r["label"]["id"], set()).add(r["node"]["id"])
        assert sorted(map(sorted, groups.values())) == [[*range(51)], [*range(51, 151)], [*range(151, 251)], [*range(251, 300)]]
        assert all(k in v for k, v in groups.items())


def test_similar_groups(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    sets = [S._shingles((t or "").encode(), 5) for t in texts]
    want = plain_components(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b]))
    got = {r["node"]["id"]: r["component"]["id"] for r in S.similar_groups(docs).collect()}
    assert got == want
    assert {r["doc_id"] for r in S.one_of_each(docs).collect()} == set(want.values())
    assert S.one_of_each(docs).columns == docs.columns


def test_large_buckets_lose_nothing_here(spark):
    r = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(60):
        x = list(base)
        x[r.randrange(200)] = "z"
        texts.append(" ".join(x))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["doc_id"] for r in S.one_of_each(docs).collect()] == [0]
    assert S.similar_groups(docs, bucket_cap=4).select("component").distinct().count() == 1


def test_links_outside_the_starting_stars(spark):
    """A chain of texts in one bucket: ends are unlike each other, and no link may be lost however small the cap."""
    r = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    texts, now = [], list(base)
    for k in range(40):
        texts.append(" ".join(now))
        at = (k * 3) % 110
        now[at] = f"n{k}"
    r.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r["node"]["id"]: r["component"]["id"] for r in S.similar_groups(docs, bucket_cap=1000).collect()}
    for cap in (1, 3):
        assert {r["node"]["id"]: r["component"]["id"] for r in S.similar_groups(docs, bucket_cap=cap).collect()} == want


def family(r, base, n):
    """Texts made of base by substitutions, insertions, deletions and cuts of any strength, some on top of a common change."""
    branch = [*base[:30], *(f"b{i}" for i in range(9)), *base[42:]]
    out = [" ".join(base), " ".join(branch)]
    for k in range(n):
        x = list(r.choice((base, base, branch)))
        for _ in range(r.choice((0, 1, 2, 3, 5, 8))):
            at = r.randrange(len(x))
            kind = r.random()
            if kind < 0.4:
                x[at] = f"s{r.randrange(400)}"
            elif kind < 0.6:
                x.insert(at, f"i{r.randrange(400)}")
            elif kind < 0.8:
                del x[at]
            else:
                x = x[: max(20, len(x) - r.randrange(25))]
        out.append(" ".join(x))
    return out


def test_large_buckets_against_all_pairs(spark):
    """Families whose texts are nearer to or farther from a hub than the threshold, with caps that send all through hubs."""
    r = random.Random(11)
    texts = [*family(r, [f"w{i}" for i in range(110)], 110), *family(r, [f"v{i}" for i in range(60)], 60), "short text", "", "w1 w2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [S._shingles(t.encode(), 5) for t in texts]
    alike = plain_components(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b]))
    assert len(set(alike.values())) > 40
    for cap, crowd in ((24, 100), (2, 2)):
        got = {r["node"]["id"]: r["component"]["id"] for r in S.similar_groups(docs, bucket_cap=cap, crowd=crowd).collect()}
        assert got == alike, (cap, crowd)


def test_pairs_that_a_hub_does_not_link(spark):
    """Of every two similar texts of which one is not similar to the hub, the prefixes of their differences meet."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(70)]
    sets = [S._shingles(t.encode(), 5) for t in family(r, base, 160)]
    for hub in sets[:4]:
        told = [S.difference(x, hub, 8) for x in sets]
        met = 0
        for x, (inside, _, _, as_outside, _, long) in zip(sets, told, strict=True):
            for y, (_, _, _, _, as_other, short) in zip(sets, told, strict=True):
                if not inside and x != y and S.similar(x, y, 8):
                    met += 1
                    assert set(long[:as_outside]) & set(short[:as_other])
        assert met > 50


def test_rows_that_differ_elsewhere(spark):
    rows = [(1, "a b c d e f", k) for k in "zyxz"] + [(None, "a b c d e f", "n"), (2, None, "q"), (3, " ", "q"), (4, "w " * 50_000, "long"), (5, "w " * 50_000 + "x", "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    runs = [sorted(map(repr, S.one_of_each(docs.repartition(k)).collect())) for k in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 4 and "doc_id=None" in "".join(runs[0])


def test_edge_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).count() == 0 and S.one_of_each(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (7, "a b c"), (7, "a b c"), (7, "other text here")], "doc_id long, text string")
    got = S.near_duplicates(odd).collect()
    assert len(got) == 5 and all(r["component_id"] == 7 for r in got)
    assert S.one_of_each(odd).count() == 2


def test_a_known_component_is_not_compared_again(spark):
    """Members of a hub that links have put together make no pairs; in two components they do."""
    node = lambda k: (k, 0, 0)
    told = lambda comps: spark.createDataFrame([(node(0), node(k), 20, 20, k != 1, 3, 3, 3, 3, [5, 7, 9], node(c)) for k, c in enumerate(comps, 1)], f"hub {S.NODE}, node {S.NODE}, size long, hub_size long, inside boolean, a long, r long, as_outside long, as_other long, elements array<long>, comp {S.NODE}")
    pairs = lambda comps: {(r["a"]["id"], r["b"]["id"]) for r in S._meeting(told(comps), 100, 8)[0].collect()}
    assert pairs([1, 1, 1]) == set() and (1, 3) in pairs([1, 1, 3]) and (1, 2) not in pairs([1, 1, 3])


def test_prefixes_are_short_and_meet(spark):
    """Texts unlike the hub gave up to half of all that differs; a fifth of their own shingles is enough to meet every similar one."""
    r = random.Random(8)
    far = lambda k: [*(f"{k}u{i}" for i in range(r.choice((10, 30, 60)))), *(f"w{i}" for i in range(r.choice((30, 60, 90))))]
    sets = [S._shingles(t.encode(), 5) for k in range(6) for t in family(r, [*far(k), *(f"{k}e{i}" for i in range(40))], 20)]
    hub, met, lacks = S._shingles(" ".join(f"w{i}" for i in range(90)).encode(), 5), 0, 0
    for hub in (hub, sets[0], max(sets, key=len)):
        told = [S.difference(x, hub, 8) for x in sets]
        for x, (inside, a, n, as_outside, as_other, _) in zip(sets, told, strict=True):
            if 10 * a > 2 * len(x):
                assert max(as_outside, as_other) <= len(x) // 5 + 1
        for x, (inside, a, n, as_outside, _, long) in zip(sets, told, strict=True):
            for y, (_, b, m, _, as_other, short) in zip(sets, told, strict=True):
                if not inside and x != y and S.similar(x, y, 8):
                    both = set(long[:as_outside]) & set(short[:as_other])
                    over, room = 18 * (a + n) - 2 * (len(x) + len(hub)), 16 * (m - b)
                    assert both and (any(e % 2 for e in both) or over <= room)
                    met, lacks = met + 1, lacks + all(e % 2 == 0 for e in both)
    assert met > 200


def test_elements_are_listed_once_and_only_where_they_can_meet(spark, monkeypatch):
    """The elements of a hub were listed anew in each branch of the plan, with what members lack where none can meet by it."""
    listed, cut = [], S.cut
    monkeypatch.setattr(S, "cut", lambda df, **k: listed.append(df.columns) or cut(df, **k) if "e" not in df.columns else listed.append(df.count()) or cut(df, **k))
    node = lambda k: (k, 0, 0)
    rows = [(node(0), node(k), 20, 20, False, 3, 3, 5, 5, [5, 7, 9, 8, 10], node(k)) for k in (1, 2, 3)]
    told = spark.createDataFrame(rows, f"hub {S.NODE}, node {S.NODE}, size long, hub_size long, inside boolean, a long, r long, as_outside long, as_other long, elements array<long>, comp {S.NODE}")
    pairs = {(r["a"]["id"], r["b"]["id"]) for r in S._meeting(told, 100, 8)[0].collect()}
    assert pairs == {(1, 2), (1, 3), (2, 3)}
    assert listed == [9, 9]  # three additions of each; those that meet


def test_a_family_is_described_by_few_hubs(spark, monkeypatch):
    """A text of one family was described and its elements were listed for each hub of its buckets, up to nine times."""
    r, texts = random.Random(4), []
    for k in "uv":
        for _ in range(90):
            x = [f"{k}{i}" for i in range(110)]
            for at in r.sample(range(110), r.choice((1, 2, 3, 4, 6))):
                x[at] = f"s{r.randrange(10_000)}"
            texts.append(" ".join(x))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [S._shingles(t.encode(), 5) for t in texts]
    want = plain_components(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b]))
    told, differences = [], S._differences
    monkeypatch.setattr(S, "_differences", lambda texts, members, *k: told.append([(m["hub"]["id"], m["node"]["id"]) for m in members.collect()]) or differences(texts, members, *k))
    assert {r["node"]["id"]: r["component"]["id"] for r in S.similar_groups(docs, bucket_cap=8).collect()} == want
    nodes = {n for _, n in told[0]}
    assert len(nodes) > 120 and len(told[0]) == len(set(told[0])) <= 1.25 * len(nodes)


def test_a_hub_goes_to_the_largest_similar_one(spark):
    """Members of a hub stay together, a hub that gives away none keeps its own, and one that isn't similar stays."""
    base = [f"w{i}" for i in range(100)]
    texts = {k: " ".join([*(f"n{i}" for i in range(k)), *base[k:]]) for k in (0, 5, 11, 40)}
    node = lambda k: (k, 0, 0)
    members = [(0, 5), (0, 11), *((0, k) for k in range(100, 105)), (5, 11), (5, 40), *((5, k) for k in range(103, 106)), (11, 5), (11, 106), (40, 107), (40, 5)]
    of = {k: texts.get(k, " ".join(base)) for k in {k for m in members for k in m}}
    df = spark.createDataFrame([(node(h), node(k)) for h, k in members], f"hub {S.NODE}, node {S.NODE}")
    got, links = S._fewer_hubs(spark.createDataFrame([(node(k), t) for k, t in of.items()], f"node {S.NODE}, text string"), df, 5, 8)
    rows = sorted((r["hub"]["id"], r["node"]["id"]) for r in got.collect())
    # 5 and 11 are similar; 0 is the largest and similar to 5; 11 is similar to 5, which gives its members away.
    assert {(r["a"]["id"], r["b"]["id"]) for r in links.collect()} == {(5, 0), (11, 5)}
    assert rows == sorted({(0, k) for k in (5, 11, *range(100, 106), 40)} | {(11, 5), (11, 106), (40, 107), (40, 5)})


def test_prefixes_follow_the_sizes_of_a_hub(spark, monkeypatch):
    """Of texts of one size, an eighth of their shingles was enough where a fifth was listed."""
    listed, cut = [], S.cut
    monkeypatch.setattr(S, "cut", lambda df, **k: cut(df, **k) if "e" not in df.columns else listed.append(df.count()) or cut(df, **k))
    node = lambda k: (k, 0, 0)
    for sizes, want in (((100, 100, 100), 3 * 12), ((100, 100, 80), 2 * 21 + 9)):
        rows = [(node(0), node(k), n, 100, False, 30, 130 - n, n // 5 + 1, n // 5 + 1, [*range(1, 2 * (n // 5 + 1), 2)], node(k)) for k, n in enumerate(sizes, 1)]
        told = spark.createDataFrame(rows, f"hub {S.NODE}, node {S.NODE}, size long, hub_size long, inside boolean, a long, r long, as_outside long, as_other long, elements array<long>, comp {S.NODE}")
        listed.clear()
        pairs = {(r["a"]["id"], r["b"]["id"]) for r in S._meeting(told, 100, 8)[0].collect()}
        assert listed[0] == want and (1, 2) in pairs
