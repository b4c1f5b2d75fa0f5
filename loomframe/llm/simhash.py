"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two segments of 32 bits. Fingerprints at radius 2 or less differ in one bit at most in
one of them, so every fingerprint looks up, in a table for each segment, the 33 values of its segment's Hamming ball of
radius 1, and the complete distance is verified for what it finds. A table bucket that holds more than bucket_cap
different fingerprints is not expanded into pairs: every fingerprint that meets it goes to an exact second way, in which
each emits the 65 values within one bit of itself. Two fingerprints are within 2 bits exactly if they share such a value,
and all that share one are within 2 bits of each other, so linking each to the least of them keeps every component and
is linear. Exact copies are one node from the start.

Defined results: a null or blank text has fingerprint zero. Repeated rows keep one row each. A null id is ignored as a
component's least id unless all are null. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import PACKED_ROWS, cut, packed, to_python
from loomframe.llm.components import components

RADIUS = 2
AT_ONCE = 1 << 17


def shingle_hashes(text: bytes | None, n: int) -> list[int]:
    """XXH64 (seed 42) of the n-word shingles of a text whose ASCII letters are lower-cased, repeats included."""
    w = (text or b"").lower().split()
    if not w:
        return []
    if len(w) <= n:
        return [xxhash.xxh64_intdigest(b" ".join(w), 42)]
    return list(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(w[i:] for i in range(n)), strict=False)), repeat(42)))


def _majority(hashes: list[int], lengths: list[int]) -> np.ndarray:
    """A fingerprint for each run of hashes."""
    counts, starts = np.zeros((len(lengths), 64), np.int64), np.concatenate([[0], np.cumsum(lengths)])
    flat = np.array(hashes, dtype="<u8")
    owner = np.repeat(np.arange(len(lengths)), lengths)
    for at in range(0, len(flat), AT_ONCE):
        part = np.unpackbits(flat[at : at + AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[at : at + AT_ONCE]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        counts[own[first]] += np.add.reduceat(part, first, axis=0, dtype=np.int32)
    bits = 2 * counts > np.diff(starts)[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            at = 0
            while at < len(ids):
                hashes, lengths, begun = [], [], at
                while at < len(ids) and len(hashes) < AT_ONCE:
                    own = shingle_hashes(texts[at].as_py(), shingle)
                    hashes += own
                    lengths.append(len(own))
                    at += 1
                yield pa.record_batch([ids.slice(begun, at - begun), pa.array(_majority(hashes, lengths), pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return to_python(rows, run, "doc_id long, fp long")


def _ball(bits: int) -> list[int]:
    """Masks of up to one bit, as signed longs."""
    return [0, *((1 << i) - (1 << 64 if i == 63 else 0) for i in range(bits))]


def _turned(value: Column, masks: list[int]) -> Column:
    return F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseXOR(m)))


def hamming_links(fps: DataFrame, bucket_cap: int = 100) -> DataFrame:
    """Links a, b between different fingerprints of fps (fp, no repeats) from which all components at RADIUS follow."""
    low, high = F.col("fp").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned("fp", 32)
    entries = fps.select("fp", F.posexplode(F.array(low, high)).alias("segment", "value"))
    crowded = packed(cut(entries.groupBy("segment", "value").agg(F.count("*").alias("n")).filter(F.col("n") > bucket_cap).drop("n")))
    some = not crowded.isEmpty()
    fetched = entries.join(crowded, ["segment", "value"], "left_anti") if some else entries
    probes = entries.select("segment", F.col("fp").alias("a"), _turned(F.col("value"), _ball(32)).alias("value"))
    pairs = probes.join(fetched.withColumnRenamed("fp", "b"), ["segment", "value"]).filter(F.col("b") < F.col("a"))
    links = pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")
    if not some:
        return links
    near = crowded.select("segment", _turned(F.col("value"), _ball(32)).alias("value")).distinct()
    rest = entries.join(near, ["segment", "value"], "left_semi").select("fp").distinct()
    around = rest.select("fp", _turned(F.col("fp"), _ball(64)).alias("around"))
    least = around.groupBy("around").agg(F.min("fp").alias("b"))
    return links.unionByName(around.join(least, "around").filter("b < fp").select(F.col("fp").alias("a"), "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, bucket_cap: int = 100) -> DataFrame:
    """doc_id, fp, fingerprint (16 hexadecimal digits), component_id (the least doc_id that links reach).

    Null and empty texts have fingerprint zero, which links as any other. Texts of any length are taken whole. Repeated rows
    are a row each; an empty table gives an empty result; columns but id and text are ignored.
    """
    marked = cut(fingerprints(docs, id_col, text, shingle))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = components(hamming_links(distinct.select("fp"), bucket_cap))
    placed = distinct.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    placed = packed(cut(placed))
    least = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    named = cut(placed.join(least, "label").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Groups of texts that share most of their shingles.
#
# At a Jaccard similarity of 0.8, fingerprints of 64 bits differ in 8 bits by the median and in up to 16, which no table of
# segment values can cover. So the segment tables propose the pairs at a distance of RADIUS, and bands of minima of the
# same shingle hashes propose the others; every link is verified on the whole texts.
#
# A bucket of many different texts is not expanded into pairs. It gets a hub, the text that is in most large buckets, and
# every member is described by what it adds to the hub's shingles and what it lacks of them (its difference D). Members
# that are similar to the hub are linked by it. Of two similar members of which one, x, is not similar to the hub,
#
#     |D(x) ^ D(y)| <= r (|x| + |y|)  and  |D(x)| > r (|x| + |hub|),   r = (10 - tenths) / (10 + tenths),
#
# so D(x) and D(y) share more than (|D(y)| + r (|hub| - |y|)) / 2 elements, one at least. So all such pairs share one in
# prefixes of D under any fixed order (additions first), and that is an equi-join on (hub, element): exact, and linear
# where the elements outside the hub's reach are rare. An element that many members share makes a bucket of its own, with
# a hub of its own, in the next round.
#
# Nothing of this asks that a hub is in the bucket. So a hub that is similar to a larger one gives its members to that one
# before they are described: a text in many buckets of one family is described once, not once for each of their hubs.
#
# A link within a component that is known already changes nothing. So hubs and stars (every node with the least one it is
# proposed with) are verified first, and what is left is compared across components only: pairs, and the elements of a hub.

BANDS, BAND_ROWS = 16, 4
_MULTIPLIERS = np.random.default_rng(20).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
NODE = "struct<id:bigint,th:bigint,rh:bigint>"
#: Rounds of hubs; what is crowded still then is compared pair by pair.
ROUNDS = 8
#: Rounds of stars before all other pairs are verified.
STARS = 2
#: Nodes that are sent to every executor to pick their texts, at most.
SENT = 200_000
#: Tasks that the members of one hub are dealt to.
SHARES = 32


def band_keys(hashes: list[int]) -> np.ndarray:
    """A key for each band: two sets of shingles share one with probability 1 - (1 - J**4)**16, 0.9998 at J = 0.8."""
    flat = np.array(hashes, dtype="<u8")
    flat ^= flat >> np.uint64(29)
    least = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(flat), 1 << 13):
        turned = flat[at : at + (1 << 13), None] * _MULTIPLIERS[None, :]
        np.minimum(least, turned.min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(least[i : i + BAND_ROWS].tobytes(), i) for i in range(0, len(least), BAND_ROWS)], np.uint64).view(np.int64)


def node_of(docs: DataFrame, id_col: str, text: str) -> Column:
    """What names a row: its id, a hash of its text and one of its other columns. Rows that agree in all three are one."""
    rest = [c for c in docs.columns if c not in (id_col, text)]
    other = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in rest]))) if rest else F.lit(0).cast("long")
    return F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), other.alias("rh"))


def sketches(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """node, whole (digest of its words in lower case), fp and bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for at in range(0, batch.num_rows, 500):
                whole, fps, bands, part = [], [], [], batch.slice(at, 500)
                for x in texts.slice(at, 500):
                    raw = x.as_py()
                    hashes = shingle_hashes(raw, shingle)
                    whole.append(xxhash.xxh3_128_hexdigest(b" ".join((raw or b"").lower().split())))
                    fps.append(_majority(hashes, [len(hashes)])[0])
                    bands.append(band_keys(hashes))
                flat = pa.array(np.concatenate(bands), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), flat)
                yield pa.record_batch([part.column(0), pa.array(whole), pa.array(fps, pa.int64()), lists], ["node", "whole", "fp", "bands"])

    rows = docs.select(node_of(docs, id_col, text).alias("node"), F.col(text).cast("string").alias("text"))
    return to_python(rows, run, f"node {NODE}, whole string, fp long, bands array<long>")


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _proposed(nodes: DataFrame, bucket_cap: int) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b of nodes to verify, and the members (hub, node) of large buckets.

    Pairs come from the segment tables and from buckets of up to bucket_cap nodes. Large buckets with one hub are one.
    """
    in_bands = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    entries = in_bands.unionByName(nodes.select("node", F.lit(-1).alias("band"), F.col("fp").alias("key")))
    buckets = packed(cut(entries.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")))
    small = entries.join(buckets.filter(F.col("n") <= bucket_cap).select("band", "key").hint("merge"), ["band", "key"]).groupBy("band", "key").agg(F.sort_array(F.collect_list("node")).alias("all"))
    within = F.flatten(F.transform("all", lambda x, i: F.transform(F.slice("all", i + 2, F.greatest(F.size("all") - i - 1, F.lit(0))), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    large = packed(cut(entries.join(buckets.filter(F.col("n") > bucket_cap).hint("merge"), ["band", "key"])))
    central = large.groupBy("node").agg(F.sum("n").alias("met"))
    hubs = packed(cut(large.join(central.hint("merge"), "node").groupBy("band", "key").agg(F.max_by("node", F.struct("met", "node")).alias("hub"))))
    members = large.join(hubs.hint("merge"), ["band", "key"]).filter("node <> hub").select("hub", "node").distinct()
    one = nodes.groupBy("fp").agg(F.min("node").alias("node"))
    near = hamming_links(nodes.select("fp").distinct())
    near = near.join(one.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(one.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b").select(*_ordered("x", "y"))
    pairs = small.select(F.explode(within).alias("p")).select("p.a", "p.b").unionByName(near)
    return pairs.filter("a <> b").distinct(), members


def _shingles(text: bytes | None, n: int) -> set[bytes]:
    w = (text or b"").lower().split()
    return set(map(b" ".join, zip(*(w[i:] for i in range(n)), strict=False))) if len(w) > n else {b" ".join(w)}


def similar(a: set[bytes], b: set[bytes], tenths: int) -> bool:
    """Whether the Jaccard similarity is tenths / 10 or more."""
    if 10 * min(len(a), len(b)) < tenths * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 10 * both >= tenths * (len(a) + len(b) - both)


def difference(x: set[bytes], hub: set[bytes], tenths: int) -> tuple[bool, int, int, int, int, list[int]]:
    """Whether x is similar to hub; how many shingles it adds and lacks; the lengths of its prefixes as the one that is not
    similar to the hub and as the other; the longer prefix. Elements are hashes, odd for what x adds."""
    added, lacked = x - hub, hub - x
    a, r, p, q = len(added), len(lacked), 10 - tenths, 10 + tenths
    d, inside = a + r, similar(x, hub, tenths)
    # Before the first element that x shares with a similar text are only additions that this text hasn't (n) and then what
    # it has of what x lacks (m), and 10 n + tenths m <= p |x|.
    reach = p * len(x) // 10 + 1 if 10 * a > p * len(x) else a + (p * len(x) - 10 * a) // tenths + 1
    as_other = min(reach, d - ((q * d + p * (r - a)) // (2 * q) + 1) + 1)
    as_outside = 0
    if not inside:
        shared = max(1, -((p * (len(x) + len(hub)) - q * d) // 20))
        as_outside = min(reach, d - shared + 1)
    take = max(as_other, as_outside)
    order = sorted(xxhash.xxh3_64_intdigest(s) >> 1 | 1 for s in added) if take else []
    if take > a:
        order += sorted(xxhash.xxh3_64_intdigest(s) >> 2 << 1 for s in lacked)
    return inside, a, r, as_outside, as_other, order[:take]


def _with_texts(texts: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs a, b with their texts x, y. Texts of few nodes are picked where they lie, so that no others are shuffled."""
    wanted = cut(pairs.select(F.explode(F.array(a, b)).alias("node")).distinct())
    n = wanted.count()
    some = texts.join(F.broadcast(wanted.coalesce(n // PACKED_ROWS + 1)), "node", "left_semi") if n <= SENT else texts
    x, y = some.select(F.col("node").alias(a), F.col("text").alias("x")), some.select(F.col("node").alias(b), F.col("text").alias("y"))
    return pairs.select(a, b).join(x.hint("merge"), a).join(y.hint("merge"), b).select(a, b, "x", "y")


def _placed(rows: DataFrame, label: DataFrame, node: str, to: str) -> DataFrame:
    """rows with the component of a node, which is the node itself without a link."""
    return rows.join(label.select(F.col("node").alias(node), F.col("label").alias(to)), node, "left").withColumn(to, F.coalesce(to, node))


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Those of pairs whose ends are in different components."""
    return _placed(_placed(pairs, label, "a", "_a"), label, "b", "_b").filter("_a <> _b").select("a", "b")


def _differences(texts: DataFrame, members: DataFrame, shingle: int, tenths: int) -> DataFrame:
    """For every (hub, node): size, hub_size, inside, a, r, as_outside, as_other, elements of difference()."""
    kind = pa.schema([("size", pa.int64()), ("hub_size", pa.int64()), ("inside", pa.bool_()), ("a", pa.int64()), ("r", pa.int64()), ("as_outside", pa.int64()), ("as_other", pa.int64()), ("elements", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub = None, set()
        for batch in batches:
            rows: list[tuple] = []
            x, y = batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())
            for p, q in zip(x, y, strict=True):
                own, raw = _shingles(p.as_py(), shingle), q.as_py()
                if raw != last:
                    last, hub = raw, _shingles(raw, shingle)
                rows.append((len(own), len(hub), *difference(own, hub, tenths)))
            cols = zip(*rows, strict=True) if rows else [()] * len(kind)
            yield pa.record_batch([*batch.columns[:2], *(pa.array(c, f.type) for c, f in zip(cols, kind, strict=True))], ["hub", "node", *kind.names])

    sent = _with_texts(texts, members, "node", "hub").select("hub", "node", "x", "y")
    return to_python(sent, run, f"hub {NODE}, node {NODE}, size long, hub_size long, inside boolean, a long, r long, as_outside long, as_other long, elements array<long>")


def _fewer_hubs(texts: DataFrame, members: DataFrame, shingle: int, tenths: int) -> tuple[DataFrame, DataFrame]:
    """members (hub, node) in which a hub that is similar to a larger one gives its members, itself included, to the largest
    such one that gives away none; and the links a, b of hubs that were found. Members of one hub stay together."""
    hubs = packed(cut(members.groupBy("hub").agg(F.count("*").alias("n")).select("hub", F.struct("n", "hub").alias("rank"))))
    ranks = lambda c: hubs.select(F.col("hub").alias(c), F.col("rank").alias(f"_{c}")).hint("merge")
    both = members.join(ranks("node"), "node").join(ranks("hub"), "hub")
    pairs = packed(cut(both.select(F.least("_node", "_hub")["hub"].alias("a"), F.greatest("_node", "_hub")["hub"].alias("b")).distinct(), forget_size=True))
    links = packed(cut(_verified(texts, pairs, shingle, tenths), forget_size=True))
    tops = links.join(links.select(F.col("a").alias("b")).distinct().hint("merge"), "b", "left_anti")
    to = packed(cut(tops.join(ranks("b"), "b").groupBy("a").agg(F.max_by("b", "_b").alias("to")), forget_size=True))
    given = members.join(to.withColumnRenamed("a", "hub").hint("merge"), "hub", "left").select(F.coalesce("to", "hub").alias("hub"), "node")
    given = given.unionByName(to.select(F.col("to").alias("hub"), F.col("a").alias("node")))
    return packed(cut(given.filter("node <> hub").distinct(), forget_size=True)), links


def _meeting(told: DataFrame, crowd: int | None, tenths: int) -> tuple[DataFrame, DataFrame]:
    """Of _differences() with components (comp): pairs a < b of different components that may be similar though the hub
    doesn't link them, and members of crowded elements.

    What is needed of an element that both lack, if it is the first they share, is that they share no addition; then
    x can only be similar to a text that is shorter than the hub by what x is too far from it (over <= room).
    """
    p, q = 10 - tenths, 10 + tenths
    lack, over, room = F.col("e") % 2 == 0, q * (F.col("a") + F.col("r")) - p * (F.col("size") + F.col("hub_size")), (q - p) * (F.col("r") - F.col("a"))
    # A hub's members meet if one that isn't similar to it is in another component than they are.
    outside = F.when(~F.col("inside"), F.col("comp"))
    far = told.groupBy("hub").agg(
        F.min(outside).alias("low"), F.max(outside).alias("high"), F.min("comp").alias("first"), F.max("comp").alias("last"), F.min("size").alias("least_size"), F.min(F.when(~F.col("inside"), over)).alias("least_over"), F.max(room).alias("most_room")
    ).filter("low IS NOT NULL AND first <> last").drop("first", "last")
    # Shares, as the members of a large hub would else meet in one task.
    far = far.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    told = told.withColumn("share", F.pmod(F.xxhash64("node"), F.lit(SHARES)).cast("int"))
    told = told.join(far.hint("merge"), ["hub", "share"]).filter("low <> high OR comp <> low OR NOT inside").drop("low", "high", "share")
    # What a member lacks is of use only if the hub has another one at the right distance; it stands behind all additions.
    told = told.withColumns({"as_outside": F.when(over <= F.col("most_room"), F.col("as_outside")).otherwise(F.least("as_outside", "a")), "as_other": F.when(room >= F.col("least_over"), F.col("as_other")).otherwise(F.least("as_other", "a"))})
    # Before the first addition that x shares with y are only some of x that y hasn't, |x| - tenths (|x| + |y|) / q at most.
    short = F.greatest("least_size", F.ceil(F.col("size") * tenths / 10))
    most_own = F.floor((q * F.col("size") - tenths * (F.col("size") + short)) / q) + 1
    told = told.withColumns({c: F.when(most_own <= F.col("a"), F.least(c, most_own)).otherwise(F.col(c)) for c in ("as_outside", "as_other")})
    elements = F.slice("elements", F.lit(1), F.greatest("as_outside", "as_other", F.lit(0)).cast("int"))
    entries = told.select("hub", "node", "comp", "size", "hub_size", "a", "r", "as_outside", "as_other", F.posexplode(elements).alias("at", "e"))
    x_role, y_role = F.col("at") < F.col("as_outside"), F.col("at") < F.col("as_other")
    entries = entries.select("hub", "node", "comp", "size", "a", "r", "at", "e", x_role.alias("x"), y_role.alias("y"), F.when(lack, over).otherwise(F.lit(0)).alias("over"), F.when(lack, room).otherwise(F.lit(0)).alias("room"))
    # Cut, as own and met would each run the joins and the explosion above.
    entries = cut(entries, forget_size=True)
    own = entries.groupBy("hub", "e").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.when(F.col("x"), F.col("over"))).alias("least_over"), F.max(F.when(F.col("y"), F.col("room"))).alias("most_room")
    ).filter("low <> high AND least_over <= most_room")
    met = entries.join(own.drop("low", "high").hint("merge"), ["hub", "e"])
    met = met.withColumns({"x": F.expr("x AND over <= most_room"), "y": F.expr("y AND room >= least_over")}).filter("x OR y").drop("least_over", "most_room")
    sizes = met.groupBy("hub", "e").agg(F.count_if("x").alias("nx"), F.count_if("y").alias("ny"), F.min_by("node", F.struct(F.col("a") + F.col("r"), "node")).alias("new_hub")).filter("nx > 0 AND ny > 0")
    few = F.lit(True) if crowd is None else (F.col("ny") <= crowd) | (F.col("nx") <= 2)
    # Cut, as pairs and crowded would each run the joins and aggregates above again.
    met = cut(met.join(sizes.select("hub", "e", "new_hub", few.alias("few")).hint("merge"), ["hub", "e"]), forget_size=True)
    some = met.filter("few")
    x, y = (some.filter(k).select("hub", "e", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "comp", "size", "a", "r", "at")]) for k in ("x", "y"))
    most = p * (F.col("size_x") + F.col("size_y"))
    d_x, d_y = F.col("a_x") + F.col("r_x"), F.col("a_y") + F.col("r_y")
    apart = F.when(lack, F.col("a_x") + F.col("a_y")).otherwise(F.abs(F.col("a_x") - F.col("a_y"))) + F.abs(F.col("r_x") - F.col("r_y"))
    can = (q * apart <= most) & (q * (d_x + d_y) - most <= 2 * q * F.least(d_x - F.col("at_x"), d_y - F.col("at_y")))
    pairs = x.join(y.hint("merge"), ["hub", "e"]).filter((F.col("comp_x") != F.col("comp_y")) & can).select(*_ordered("node_x", "node_y")).distinct()
    crowded = met.filter("NOT few AND node <> new_hub").select(F.col("new_hub").alias("hub"), "node").distinct()
    return pairs, crowded


def _verified(texts: DataFrame, pairs: DataFrame, shingle: int, tenths: int) -> DataFrame:
    """Those of pairs whose whole texts are similar."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())
            ok = [similar(_shingles(p.as_py(), shingle), _shingles(q.as_py(), shingle), tenths) for p, q in zip(x, y, strict=True)]
            yield pa.record_batch(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return to_python(_with_texts(texts, pairs, "a", "b"), verify, f"a {NODE}, b {NODE}")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, tenths: int = 8, bucket_cap: int = 24, crowd: int = 100) -> DataFrame:
    """Rows of docs grouped by verified similarity: node, whole, component (the least node that links reach).

    Defined results: null and blank texts are alike, as are texts with the same words in other letter case or spacing; a
    text of fewer words than a shingle is one shingle. Rows that agree in every column are one node; rows that repeat an
    id or a text are nodes of their own. A null id comes before any other. An empty table gives an empty result. A very
    long text is compared as a whole; a task holds two texts at a time besides an Arrow batch. Columns may have any name.
    """
    marked = cut(sketches(docs, id_col, text, shingle))
    nodes = cut(marked.groupBy("whole").agg(F.min("node").alias("node"), F.min_by("fp", "node").alias("fp"), F.min_by("bands", "node").alias("bands")))
    pairs, members = (packed(cut(x, forget_size=True)) for x in _proposed(nodes, bucket_cap))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.select(F.explode(F.array("hub", "node")).alias("node"))).distinct()
    rows = docs.select(node_of(docs, id_col, text).alias("node"), F.col(text).cast("string").alias("text"))
    texts = cut(rows.join(wanted.hint("merge"), "node", "left_semi").dropDuplicates(["node"]))
    links = []
    if not members.isEmpty():
        members, of_hubs = _fewer_hubs(texts, members, shingle, tenths)
        links.append(of_hubs)
    told = cut(_differences(texts, members, shingle, tenths), forget_size=True)
    linked = lambda t: t.filter("inside").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    links.append(linked(told))
    for _ in range(STARS):
        if pairs.isEmpty():
            break
        star = cut(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), forget_size=True)
        links.append(cut(_verified(texts, star, shingle, tenths), forget_size=True))
        pairs = packed(cut(_apart(pairs.join(star, ["a", "b"], "left_anti"), components(reduce(DataFrame.unionByName, links))), forget_size=True))
    if not pairs.isEmpty():
        links.append(cut(_verified(texts, pairs, shingle, tenths), forget_size=True))
    for turn in range(ROUNDS):
        if members.isEmpty():
            break
        if turn:
            told = cut(_differences(texts, members, shingle, tenths), forget_size=True)
            links.append(linked(told))
        label = components(reduce(DataFrame.unionByName, links))
        more, members = (packed(cut(x, forget_size=True)) for x in _meeting(_placed(told, label, "node", "comp"), crowd if turn + 1 < ROUNDS else None, tenths))
        if not more.isEmpty():
            links.append(cut(_verified(texts, more, shingle, tenths), forget_size=True))
    label = components(reduce(DataFrame.unionByName, links))
    placed = nodes.select("whole", "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = packed(cut(placed))
    least = placed.groupBy("label").agg(F.min("node").alias("component"))
    named = cut(placed.join(least, "label").select("whole", "component"))
    return marked.select("node", "whole").join(named, "whole")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, tenths: int = 8) -> DataFrame:
    """docs with one row of each group of similar texts: that with the least id, null ids first; ties go by hashes of the
    text and of the other columns, so that only rows which agree in every column are interchangeable."""
    stay = similar_groups(docs, id_col, text, shingle, tenths).filter("node = component").select(F.col("node").alias("_node")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), node_of(docs, id_col, text).alias("_node"))
    return rows.join(stay, "_node", "left_semi").dropDuplicates(["_node"]).select(*[F.col("row")[c].alias(c) for c in docs.columns])
