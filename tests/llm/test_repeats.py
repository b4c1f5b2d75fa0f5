"""Removal of repeated units against a plain pass in rank order."""

import random
import re

from pyspark.sql import functions as F

from loomframe.llm import repeats as R


def plain(docs, min_words=8):
    seen, out, done = {}, [], set()
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        if (i, t) in done:
            continue
        done.add((i, t))
        for start, end, n, d in R.units_of(t or "", min_words):
            if d in seen:
                out.append((i, start, end, n, *seen[d]))
            else:
                seen[d] = (i, start)
    return sorted(out)


def corpus():
    r = random.Random(8)
    say = lambda n: " ".join(f"w{r.randrange(60)}" for _ in range(n))
    passage = ". ".join(say(12) for _ in range(6)) + "."
    docs = []
    for i in range(60):
        parts = [say(r.randint(1, 14)) + r.choice([".", "!", ""]) for _ in range(r.randint(0, 8))]
        if i % 4 == 0:
            parts.insert(r.randrange(len(parts) + 1), passage)
        docs.append((i, r.choice(["\n", " "]).join(parts)))
    return docs + [(60, ""), (61, None), (62, docs[0][1]), (63, "  Same line of eight words is right here \n same LINE of eight words is right here")], passage


def test_spans(spark):
    docs, passage = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(r) for r in R.repeated(df).drop("text_hash").collect())
    assert got == plain(docs)
    hit = {g[0] for g in got}
    assert {i for i in range(4, 60, 4)} <= hit and 62 in hit and 63 in hit and 0 not in hit
    words = {i: sum(g[3] for g in got if g[0] == i) for i in range(4, 60, 4)}
    assert all(n >= 48 for n in words.values())  # of the passage's 72 words: its first or last sentence may join a neighbour


def test_whole_lines_against_plain_lines(spark):
    """Line units by str.split and paragraph units by re.split, grouped and ranked without any code of the operator."""
    r = random.Random(3)
    lines = [" ".join(f"w{r.randrange(9)}" for _ in range(r.randint(1, 4))) for _ in range(25)]
    docs = [(i, r.choice(["\n", "\n\n"]).join(r.choice(["", " "]) + r.choice(lines).upper() if r.random() < 0.3 else r.choice(lines) for _ in range(r.randint(0, 7)))) for i in range(50)]
    docs += [(50, None), (51, " \n "), (52, "x " * 100_000), (53, "X " * 100_000 + "\ny")]
    seen, lost = {}, set()
    for i, t in docs:
        at = 0
        for line in (t or "").split("\n"):
            key = " ".join(line.lower().split())
            if key and seen.setdefault(key, (i, at)) != (i, at):
                lost.add((i, at + len(line) - len(line.lstrip()), at + len(line.rstrip())))
            at += len(line) + 1
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["start"], r["end"]) for r in R.repeated(df, whole_lines=True).collect()}
    assert lost <= got and (53, 0, 199_999) in got
    texts = dict(docs)
    for i, s, e in got - lost:  # a paragraph that is broken another way than its first occurrence
        assert "\n" in texts[i][s:e] or any(" ".join(p.lower().split()) == " ".join(texts[i][s:e].lower().split()) for j, t in docs if t and j <= i for p in re.split(r"\n[ \t]*\n", t))
    left = {r["doc_id"]: r["text"] for r in R.clean(df, whole_lines=True).collect()}
    kept = [" ".join(x.lower().split()) for t in left.values() if t for x in t.split("\n") if x.strip()]
    assert len(kept) == len(set(kept))


def test_pieces_cover_lines():
    """Whatever the text, its pieces don't overlap and leave nothing but blanks."""
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice(["word ", "Mr. ", "end. ", "why? ", "\n", "  ", "x"]) for _ in range(r.randint(0, 60)))
        spans = [(s, e) for s, e, *_ in R.units_of(text, 8)]
        assert spans == sorted(spans) and all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        rest = list(text)
        for a, b in spans:
            assert not text[a].isspace() and not text[b - 1].isspace() and "\n" not in text[a:b]
            rest[a:b] = " " * (b - a)
        assert not "".join(rest).strip()


def test_clean(spark):
    docs, passage = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"start": F.lit(1), "_id": F.lit("k")})
    out = R.clean(df)
    assert out.columns == df.columns and out.count() == len(docs)
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    assert left[0] == dict(docs)[0] and left[61] is None and left[60] == ""
    assert R.repeated(out).count() == 0
    for i, t in docs:
        if t:
            gone = "".join(t[s:e] for j, s, e, *_ in plain(docs) if j == i)
            assert sorted("".join(left[i].split()) + "".join(gone.split())) == sorted("".join(t.split()))


def test_without():
    assert R.without("a b. c d.\nnext", [(0, 4)]) == "c d.\nnext"
    assert R.without("all gone\nnext\n\nlast", [(0, 8)]) == "next\n\nlast"
    assert R.without("x y", []) == "x y"


def test_edge_tables(spark):
    kind = "doc_id long, text string"
    assert R.repeated(spark.createDataFrame([], kind)).count() == 0
    line = "one two three four five six seven eight nine"
    same = spark.createDataFrame([(1, line)] * 3 + [(None, line), (2, line.upper())], kind)
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in R.repeated(same).collect()) == [(False, 2), (True, None)]


def test_short_lines_passages_and_paragraphs(spark):
    verse = "\n".join(f"line {i} of verse" for i in range(20))
    short = " ".join(f"so word{i} went on." for i in range(30))  # sentences of four words in one line
    long = " ".join(f"this is sentence number {i} of a long passage." for i in range(4))
    wrapped = "a paragraph of some words that\nis broken in this way\nor in another one"
    docs = [
        (1, f"own one\n{verse}\nend"),
        (2, f"own two\n{verse}\n\nand its end"),
        (3, f"First here. {short}"),
        (4, f"Not the same. Nor of one length, is it. Oh. {short} More of it."),
        (5, long),
        (6, f"Oh. {long} Ah."),
        (7, wrapped),
        (8, "own eight\n\n" + wrapped.replace("that\nis", "that is").replace(" or", "\nor") + "\n\nlast"),
        (9, "Mr. Smith has eight words in this line, no less"),
        (10, "Mr. Jones has eight words in this line, no less"),
    ]
    left = {r["doc_id"]: r["text"] for r in R.clean(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [left[i] for i, _ in docs if i % 2] == [t for i, t in docs if i % 2]
    assert left[2] == "own two\n\nand its end" and left[6] == "Oh. Ah." and left[8] == "own eight\n\n\nlast" and left[10] == docs[9][1]
    assert left[4].startswith("Not the same.") and left[4].endswith("More of it.") and len(left[4].split()) <= 50


def test_without_overlaps():
    assert R.without("a b. c d.\nnext one\nlast", [(0, 18), (5, 9), (10, 18)]) == "last"
    assert R.without("a b. c d. e", [(0, 9), (5, 9)]) == "e"
    assert R.without("x\na b\nc d", [(2, 9)]) == "x"
