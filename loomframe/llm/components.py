"""Connected components of a link table, without bringing links or labels to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import PACKED_ROWS, cut, to_python


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a and to of the few links of one partition: every node with the one that stands for its component."""
    some = [x for x in batches if x.num_rows]
    if not some:
        return
    links = pa.Table.from_batches(some)
    ends = pa.concat_arrays([c for name in ("a", "b") for c in links.column(name).chunks])
    place: dict = {}
    owner = [place.setdefault(tuple(x.values()) if isinstance(x, dict) else x, i) for i, x in enumerate(ends.to_pylist())]
    over = list(range(len(owner)))

    def top(i: int) -> int:
        while over[i] != i:
            over[i] = i = over[over[i]]
        return i

    for x, y in zip(owner, owner[links.num_rows :], strict=False):
        x, y = top(x), top(y)
        over[max(x, y)] = min(x, y)
    nodes = list(place.values())
    yield pa.record_batch([ends.take(pa.array(nodes)), ends.take(pa.array([top(i) for i in nodes]))], ["a", "to"])


def components(links: DataFrame, a: str = "a", b: str = "b", few_links: int = PACKED_ROWS) -> DataFrame:
    """node, label for every node with a link; nodes of one component share a label, which is one of them.

    Each round hooks every node to the neighbour (or itself) that a hash of the round puts first and contracts the
    graph, so a round removes a constant share of the nodes of any component, a long path too. The last few_links links,
    which lie in one partition, are joined there, as each further round would be some jobs over ever fewer rows. Only the
    number of remaining links reaches the driver. Links of a node with itself or with null are ignored.
    """
    left = cut(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), forget_size=True)
    levels, turn = [], 0
    while n := left.count():
        if n <= few_links:
            kind = left.schema["a"].dataType.simpleString()
            levels.append(cut(to_python(left.coalesce(1), _joined, f"a {kind}, to {kind}"), forget_size=True))
            break
        few = n // PACKED_ROWS + 1  # partitions for what is left; see packed()
        left = left.coalesce(few)
        first = lambda c: F.struct(F.xxhash64(F.lit(turn), c), c.alias("n"))  # noqa: B023,E731
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min(first(F.col("b"))).alias("m")).select("a", F.least(F.col("m"), first(F.col("a")))["n"].alias("to"))
        hooks = cut(hooks.coalesce(few), forget_size=True)
        levels.append(hooks)
        ends = left.join(hooks, "a").select(F.col("to").alias("x"), "b").coalesce(few).join(hooks.select(F.col("a").alias("b"), "to"), "b")
        left = cut(ends.select(F.col("x").alias("a"), F.col("to").alias("b")).filter("a <> b").coalesce(few).distinct(), forget_size=True)
        turn += 1
    if not levels:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = levels[0].select(F.col("a").alias("node"), F.col("to").alias("label"))
    for hooks in levels[1:]:
        few = out.count() // PACKED_ROWS + 1
        out = cut(out.coalesce(few).join(hooks.select(F.col("a").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")).coalesce(few), forget_size=True)
    return out
