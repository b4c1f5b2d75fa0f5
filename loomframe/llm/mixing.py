"""Mixing sources to target weights.

Each source's documents are laid out in a fixed pseudorandom order as one stream of words, cut into blocks of
block_words. A mix is a list of slots in output shards. Every shard draws its counts a source from a multinomial: the
whole part of the expected counts is given, and the slots left over are drawn from what remains of each expectation, so
that counts stay unbiased and vary little. A source's slots are numbered through all shards; slot number j stands for
epoch j div n and for the block to which that epoch's pseudorandom permutation of the n block indexes maps j mod n.
Slots and blocks then meet in an equi-join on (source, block), whose groups hold one block each, so that no source is a
hot key. Only DataFrame functions run here.

Defined results: null or empty texts have size 0 and are never taken. A null source is a source of its own, last in
order. Repeated rows are rows of their own; rows that agree in id, size and text are interchangeable. An empty table
gives an empty mix. Extra columns are ignored, or carried by name.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.common import BLANKS, cut, let, n_words
from loomframe.operators import ordered

#: A table of sources up to this many rows (some 100 bytes each) is sent to every executor; a larger one is joined by shuffle.
SMALL_SOURCES = 50_000
ROUNDS = 16
#: Rows of a bucket, in which prefix sums are made; shards that one row of a source is first spread over.
BUCKET_ROWS, SPREAD = 1024, 4096


def _u64(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def _unit(*parts: Column) -> Column:
    """Uniform in [0, 1) from 53 bits of a hash."""
    return F.shiftrightunsigned(_u64(*parts), 11) / F.lit(float(1 << 53))


def permuted(at: Column, n: Column, *key: Column) -> Column:
    """Where a pseudorandom permutation of 0..n-1, chosen by key, sends at: a swap-or-not shuffle of ROUNDS rounds."""

    def turn(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(_u64(*key, r), n) - x, n)
        return F.when(F.pmod(_u64(*key, r, F.greatest(x, other)), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(ROUNDS).cast("long")), at, turn)


def source_targets(totals: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """totals (source, source_size) with source_no (from 1, by code point, null last), weight and target.

    Weights repeat over the sources and share the sum of all sizes; a target stops at most times its source's size and
    the excess goes to the others by weight. The final level is the first, in order of most * size / weight, under
    which the next source fits. One row a source stands in one task here.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("_room", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    size, weight = F.col("source_size"), F.col("weight")
    out = totals.withColumn("source_no", F.row_number().over(by_name).cast("long"))
    out = out.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int")))
    out = out.withColumn("_room", most * size / weight)
    out = out.withColumn(
        "_level",
        (F.sum(size).over(every) - F.coalesce(F.sum(most * size).over(by_room), F.lit(0)))
        / (F.sum(weight).over(every) - F.coalesce(F.sum(weight).over(by_room), F.lit(0.0))),
    )
    out = out.withColumn("_level", F.min(F.when(F.col("_room") >= F.col("_level"), F.struct("_room", "source_no", "_level"))).over(every)["_level"])
    return out.withColumn("target", F.least((most * size).cast("double"), F.col("_level") * weight)).drop("_room", "_level")


class Mix:
    """A mix of docs. sources: a row a source; documents: a row a document with its place in its source's stream.

    carry: None if no text is wanted; else columns of docs to pass on as _c_<name>, and pieces can have texts.
    shard_slots: slots of an output shard, whatever the size of the mix, so that the draws of a shard follow from its number,
    the sources' shares and the seed alone.
    """

    def __init__(
        self, docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, block_words: int = 128, shard_slots: int = 1024, seed: int = 42,
        id_col: str = "doc_id", text: str = "text", source: str = "source", carry: Sequence[str] | None = None,
    ):
        self.most, self.block_words, self.seed = most, block_words, seed
        n = docs.count()
        n_buckets = max(1, math.ceil(n / BUCKET_ROWS))
        key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text))
        self._rows = docs.select(
            F.col(id_col).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), key.alias("_h"),
            F.pmod(key, F.lit(n_buckets)).alias("bucket"),
            *([] if carry is None else [F.col(text).alias("_text"), *[F.col(c).alias(f"_c_{c}") for c in carry]]),
        )
        sized = self._rows.select("doc_id", "source", "size", "_h", "bucket")
        if carry is None:
            self._rows = sized = cut(sized)
        parts = cut(sized.groupBy("source", "bucket").agg(F.sum("size").alias("part")))
        sources = source_targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, most)
        blocks = F.ceil(F.col("source_size") / F.lit(block_words)).cast("long")
        sources = sources.withColumn("n_blocks", blocks).withColumn(
            "expected", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("n_blocks")).otherwise(F.lit(0.0))
        )
        self.sources = cut(sources)
        found = self.sources.agg(F.count("*").alias("k"), F.sum("expected").alias("slots")).first()
        self.n_slots = math.ceil(round(found["slots"] or 0, 6))
        self.shard_slots = shard_slots
        self._small = found["k"] <= SMALL_SOURCES
        along = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        numbers = self._few(self.sources.select(F.col("source").alias("_s"), "source_no", "source_size", "target", "n_blocks"))
        self._numbers = numbers
        self._parts = parts.join(numbers.select("_s", "source_no"), F.col("source").eqNullSafe(F.col("_s"))).select(
            "source_no", "bucket", F.coalesce(F.sum("part").over(along), F.lit(0)).cast("long").alias("_before")
        )

    def _few(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self._small else df

    @property
    def documents(self) -> DataFrame:
        """Rows with doc_id, source, size, source_no, source_size, target, bucket, _n (with bucket: the row's key) and start."""
        order = Window.partitionBy("bucket", "source").orderBy("_h", "doc_id", "size")
        dealt = self._rows.repartition("bucket").withColumns(
            {"_n": F.row_number().over(order).cast("long"), "_run": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")}
        )
        dealt = dealt.join(self._numbers, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        return dealt.join(self._parts, ["bucket", "source_no"]).withColumn("start", F.col("_before") + F.col("_run")).drop("_before", "_run", "_h")

    def pieces(self, with_text: bool = False) -> DataFrame:
        """documents cut at the blocks: block, piece_start (in the document, in words), piece_words, and piece_text (with the
        blanks after its words). A document without words has one row whose block is null."""
        size, start = F.col("size"), F.col("start")
        length = F.lit(self.block_words)
        first, last = F.floor(start / length), F.floor((start + size - 1) / length)

        def one(b: Column, w: Column | None) -> Column:
            at = F.greatest(b * length, start) - start
            count = F.least((b + 1) * length, start + size) - start - at
            fields = [b.alias("block"), at.alias("piece_start"), count.alias("piece_words")]
            if w is not None:
                fields.append(F.array_join(F.slice(w, (at + 1).cast("int"), count.cast("int")), "").alias("piece_text"))
            return F.struct(*fields)

        spans = F.sequence(first.cast("long"), last.cast("long"))
        if with_text:
            blank = "\\x20" + "".join(f"\\x{ord(c):02x}" for c in BLANKS)
            kept = F.regexp_extract_all(F.col("_text"), F.lit(f"(?:^[{blank}]+)?[^{blank}]+[{blank}]*"), F.lit(0))
            cuts = let(kept, lambda w: F.transform(spans, lambda b: one(b, w)))
        else:
            cuts = F.transform(spans, lambda b: one(b, None))
        return self.documents.withColumn("_p", F.explode_outer(F.when(size > 0, cuts))).select("*", "_p.*").drop("_p", "_text")

    def shard_counts(self) -> DataFrame:
        """shard, source_no, n_blocks, n (slots of that source in that shard)."""
        n_shards, per, total = math.ceil(self.n_slots / self.shard_slots), self.shard_slots, self.n_slots
        if not n_shards:
            return self.sources.limit(0).select(F.lit(0).cast("long").alias("shard"), "source_no", "n_blocks", F.lit(0).cast("long").alias("n"))
        shares = self.sources.filter("expected > 0").select("source_no", "n_blocks", (F.col("expected") / F.sum("expected").over(Window.partitionBy())).alias("share"))
        slots = F.least(F.lit(per), F.lit(total) - F.col("shard") * F.lit(per))
        runs = math.ceil(n_shards / SPREAD)
        each = shares.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long"))).alias("_run"))
        each = each.repartition(min(runs, 4096), "_run", "source_no") if runs > 1 else each
        ends = F.least(F.lit(n_shards), (F.col("_run") + 1) * SPREAD) - 1
        each = each.select("source_no", "n_blocks", "share", F.explode(F.sequence(F.col("_run") * SPREAD, ends)).alias("shard"))
        each = each.withColumn("mean", slots * F.col("share")).withColumn("given", F.floor("mean"))
        shards = each.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("source_no", (F.col("mean") - F.col("given")).alias("rest")))).alias("rests"), F.sum("given").alias("given"))
        left = (slots - F.col("given")).cast("int")
        draws = F.transform(F.sequence(F.lit(1), left), lambda i: _unit(F.lit(self.seed), F.lit("slot"), F.col("shard"), i) * F.aggregate("rests", F.lit(0.0), lambda a, x: a + x["rest"]))
        drawn = shards.filter(left > 0).select("shard", "rests", F.explode(draws).alias("u"))
        pick = F.aggregate(
            "rests",
            F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("no")),
            lambda a, x: F.struct((a["sum"] + x["rest"]).alias("sum"), F.when(a["no"].isNull() & (a["sum"] + x["rest"] > F.col("u")), x["source_no"]).otherwise(a["no"]).alias("no")),
        )["no"]
        extra = drawn.select("shard", F.coalesce(pick, F.element_at("rests", -1)["source_no"]).alias("source_no")).groupBy("shard", "source_no").agg(F.count("*").alias("extra"))
        return each.join(extra, ["shard", "source_no"], "left").select("shard", "source_no", "n_blocks", (F.col("given") + F.coalesce("extra", F.lit(0))).cast("long").alias("n"))

    def slots(self) -> DataFrame:
        """shard, slot (in the shard's source), source_no, epoch, block. A source's slots end with its epoch number most."""
        tasks = max(1, math.ceil(self.n_slots / 50_000))
        # A source has a row for each shard, so their prefix sums are carried over pieces.
        counts = ordered.before(ordered.pieces(self.shard_counts(), ["source_no"], ["shard"]), _before=(F.sum, F.col("n")))
        counts = counts.select("shard", "source_no", "n_blocks", "n", F.coalesce("_before", F.lit(0)).cast("long").alias("_before"))
        last = F.least(F.col("n"), F.col("n_blocks") * self.most - F.col("_before"))
        made = counts.filter(last > 0).repartition(tasks, "shard", "source_no").select("*", F.explode(F.sequence(F.lit(0).cast("long"), last - 1)).alias("slot"))
        made = made.withColumn("_j", F.col("_before") + F.col("slot")).withColumns({"epoch": F.floor(F.col("_j") / F.col("n_blocks")), "_at": F.pmod("_j", "n_blocks")})
        return made.select("shard", "slot", "source_no", "epoch", permuted(F.col("_at"), F.col("n_blocks"), F.lit(self.seed).cast("long"), F.col("source_no"), F.col("epoch")).alias("block"))

    def rows(self, with_text: bool = False, untaken: bool = False) -> DataFrame:
        """The mix: a row for each slot and piece of its block. untaken: also pieces that no slot takes, slot null.

        Slots are as many as blocks, so the join is always by shuffle."""
        return self.pieces(with_text).join(self.slots().hint("merge"), ["source_no", "block"], "left" if untaken else "inner")

    def taken(self) -> DataFrame:
        """doc_id, source, size, source_size, target, taken: words of each document in the mix, repeats counted."""
        key = ["bucket", "source_no", "_n", "doc_id", "source", "size", "source_size", "target"]
        words = F.sum(F.when(F.col("slot").isNotNull(), F.col("piece_words")).otherwise(F.lit(0))).cast("long")
        return self.rows(untaken=True).groupBy(*key).agg(words.alias("taken")).drop("bucket", "source_no", "_n")
