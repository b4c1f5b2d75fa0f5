"""Merkle fixity audit of WARC archives.

Records are laid out in archive files. A record's file and its slot in the file follow from its id, so that a record
which one replica lost leaves all others where they were; in a slot, records are ordered by a hash of their digest and
then by id, and each has the offset and length of its bytes. A leaf is the SHA-256 of a record's bytes. A node hashes its
children's digests and their offset ranges, counted from the node's own first byte; above the files' roots a tree over
all files ends in one root a replica. An audit compares the roots and then, level by level, only the children of nodes
that differ, down to the records, which are told apart by id. Digests alone move between machines: record bytes are hashed
where they are read.

Records that agree in id and bytes are one leaf with a number of copies, and a slot is split in SPREAD parts by digest,
so an id that very many records share (null, say) is no hot group.

Defined results: a null url or html is as an empty one. Repeated rows are copies of one record; if their numbers differ,
what is over is missing or added. If an id has one record on each side that the other lacks, it is changed; of several
each is missing or added. Two empty replicas agree. Extra columns are ignored. A very long record is hashed as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.common import cut

#: Parts of a slot. A node over them has this many children at most.
SPREAD = 4096


def record_head(url: Column, n_bytes: Column) -> Column:
    """The head of a WARC resource record."""
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), n_bytes.cast("string"), F.lit("\r\n\r\n"))


def record(url: Column, html: Column) -> Column:
    """The bytes of a page's record."""
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    return F.concat(record_head(url, F.octet_length(html)), html, F.lit("\r\n\r\n")).cast("binary")


def leaves(pages: DataFrame, n_files: int, n_slots: int, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """file, n (slot * SPREAD + part), page_id, start, length, copies, digest of every record."""
    raw = record(F.col(url), F.col(html))
    rows = pages.select(F.col(id_col).alias("page_id"), F.octet_length(raw).cast("long").alias("length"), F.sha2(raw, 256).alias("digest"))
    file, slot = F.pmod(F.xxhash64("page_id"), F.lit(n_files)), F.pmod(F.xxhash64("page_id", F.lit(1)), F.lit(n_slots))
    rows = rows.groupBy("page_id", "length", "digest").agg(F.count("*").alias("copies"))
    rows = rows.select(file.alias("file"), (slot * SPREAD + F.pmod(F.xxhash64("digest"), F.lit(SPREAD))).alias("n"), "page_id", "length", "copies", "digest")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    taken = F.col("length") * F.col("copies")
    own = rows.withColumn("_own", F.coalesce(F.sum(taken).over(before(Window.partitionBy("file", "n").orderBy("page_id", "digest"))), F.lit(0)))
    parts = rows.groupBy("file", "n").agg(F.sum(taken).alias("_size"))
    parts = parts.select("file", "n", F.coalesce(F.sum("_size").over(before(Window.partitionBy("file").orderBy("n"))), F.lit(0)).alias("_first"))
    return own.join(parts.hint("merge"), ["file", "n"]).select("file", "n", "page_id", (F.col("_first") + F.col("_own")).cast("long").alias("start"), "length", "copies", "digest")


def _parents(nodes: DataFrame, over: int) -> DataFrame:
    """file, n, start, end, digest one level up: groups of up to `over` nodes by n."""
    kids = F.sort_array(F.collect_list(F.struct("n", "start", "end", "digest")))
    up = nodes.groupBy("file", F.floor(F.col("n") / over).alias("p")).agg(kids.alias("k"))
    first = F.col("k")[0]["start"]
    text = F.array_join(F.transform("k", lambda x: F.concat_ws(":", x["n"] % over, x["start"] - first, x["end"] - first, x["digest"])), ",")
    return up.select("file", F.col("p").alias("n"), first.alias("start"), F.element_at("k", -1)["end"].alias("end"), F.sha2(text, 256).alias("digest"))


class Tree:
    """levels: parts, slots, nodes of slots up to the files' roots, then nodes of files up to one root.

    Each level is a table file, n, start, end, digest with spans[i], how many nodes of it are under one of the next; from
    in_files on, file is 0 and n counts files.
    """

    def __init__(self, records: DataFrame, n_files: int, n_slots: int, fanout: int = 16):
        self.records, self.shape = records, (n_files, n_slots, fanout)
        kids = F.sort_array(F.collect_list(F.struct("start", "length", "copies", "digest")))
        parts = records.groupBy("file", "n").agg(kids.alias("k"))
        first, last = F.col("k")[0]["start"], F.element_at("k", -1)
        text = F.array_join(F.transform("k", lambda x: F.concat_ws(":", x["start"] - first, x["length"], x["copies"], x["digest"])), ",")
        parts = parts.select("file", "n", first.alias("start"), (last["start"] + last["length"] * last["copies"]).alias("end"), F.sha2(text, 256).alias("digest"))
        self.levels, self.spans = [cut(parts)], []
        self._up(SPREAD)
        for _ in range(_height(n_slots, fanout)):
            self._up(fanout)
        self.in_files = len(self.levels)
        self.levels.append(self.levels[-1].select(F.lit(0).cast("long").alias("file"), F.col("file").alias("n"), F.lit(0).cast("long").alias("start"), (F.col("end") - F.col("start")).alias("end"), "digest"))
        self.spans.append(1)
        for _ in range(max(1, _height(n_files, fanout))):
            self._up(fanout)

    def _up(self, over: int) -> None:
        self.levels.append(cut(_parents(self.levels[-1], over)))
        self.spans.append(over)

    def root(self) -> str | None:
        row = self.levels[-1].select("digest").first()
        return row["digest"] if row else None


def _height(n: int, fanout: int) -> int:
    return math.ceil(math.log(n, fanout) - 1e-9) if n > 1 else 0


def audit(a: Tree, b: Tree) -> DataFrame:
    """Records in which the replicas differ: file, page_id, copies, start, length and digest of both; state is changed, missing or added."""
    if a.shape != b.shape:
        raise ValueError("the trees differ in shape")
    node = ["file", "n"]
    below = None
    for at in range(len(a.levels) - 1, -1, -1):
        if at == a.in_files - 1:  # a file that differs has the same node as its own root
            below = below.select(F.col("n").alias("file"), F.lit(0).cast("long").alias("n"))
            continue
        sides = []
        for tree, k in ((a, "x"), (b, "y")):
            nodes = tree.levels[at]
            if below is not None:
                nodes = nodes.withColumn("p", F.floor(F.col("n") / tree.spans[at])).join(below.select("file", F.col("n").alias("p")), ["file", "p"], "left_semi")
            sides.append(nodes.select(*node, F.col("digest").alias(k)))
        below = cut(sides[0].join(sides[1], node, "full_outer").filter(~F.col("x").eqNullSafe(F.col("y"))).select(*node))
        if below.isEmpty():
            break
    key = [*node, "page_id", "digest"]
    sides = []
    for tree, k in ((a, "a"), (b, "b")):
        own = tree.records.join(below, node, "left_semi") if not below.isEmpty() else tree.records.limit(0)
        sides.append(own.select(*[F.col(c).alias(f"_{c}") for c in key] if k == "b" else key, F.struct("start", "length", "copies").alias(k)))
    on = (F.col("file") == F.col("_file")) & (F.col("n") == F.col("_n")) & F.col("page_id").eqNullSafe(F.col("_page_id")) & (F.col("digest") == F.col("_digest"))
    both = sides[0].join(sides[1], on, "full_outer")
    over = F.coalesce("a.copies", F.lit(0)) - F.coalesce("b.copies", F.lit(0))
    rest = both.select(*[F.coalesce(c, f"_{c}").alias(c) for c in ("file", "page_id", "digest")], over.alias("over"), F.coalesce("a", "b").alias("r")).filter("over <> 0")
    rest = cut(rest.withColumn("r", F.struct(F.col("r.start").alias("start"), F.col("r.length").alias("length"), F.col("digest").alias("digest"), F.abs("over").alias("copies"))))
    left, right = F.col("over") > 0, F.col("over") < 0
    ids = rest.groupBy("file", "page_id").agg(
        F.count_if(left).alias("n_a"), F.count_if(right).alias("n_b"), F.min(F.when(left, F.col("r"))).alias("a"), F.min(F.when(right, F.col("r"))).alias("b")
    )
    pair = (F.col("n_a") == 1) & (F.col("n_b") == 1) & (F.col("a.copies") == F.col("b.copies"))
    fields = lambda side, r: [r[c].alias(f"{side}_{c}") for c in ("start", "length", "digest")]
    changed = ids.filter(pair).select("file", "page_id", F.col("a.copies").alias("copies"), *fields("a", F.col("a")), *fields("b", F.col("b")), F.lit("changed").alias("state"))
    whole = ids.filter(pair).select(F.col("file").alias("_f"), F.col("page_id").alias("_p"))
    single = rest.join(whole, (F.col("file") == F.col("_f")) & F.col("page_id").eqNullSafe(F.col("_p")), "left_anti")
    in_a, in_b = F.when(left, F.col("r")), F.when(right, F.col("r"))
    return changed.unionByName(single.select("file", "page_id", "r.copies", *fields("a", in_a), *fields("b", in_b), F.when(left, "missing").otherwise("added").alias("state")))


def replicas(a: DataFrame, b: DataFrame, records_per_file: int = 256, fanout: int = 16, **columns: str) -> tuple[Tree, Tree]:
    """Trees of two replicas of one shape, so that they can be compared."""
    n_files = max(1, math.ceil(max(a.count(), b.count()) / records_per_file))
    n_slots = max(1, math.ceil(records_per_file / fanout))
    return tuple(Tree(cut(leaves(x, n_files, n_slots, **columns)), n_files, n_slots, fanout) for x in (a, b))
