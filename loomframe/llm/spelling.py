"""Spelling variants: words of a corpus, their neighbours at edit distance one, and the form that each stands for.

Words are sorted and cut into shards of bounded size; each shard becomes a compact trie (labels, first children and
terminals in arrays). Shards are broadcast in rounds of at most ROUND_BYTES, whatever the vocabulary's size. A task
intersects each of its words' distance-one Levenshtein automata with every shard of the round, depth first: along the
word's own path one error is spent at each node, and the rest of the word has to follow exactly. Accepted neighbours are
reduced to their number and the best one before they leave the task; rounds are reduced by word.

Letters are code points below 256, a byte each, so bytes compare as code points do.

Defined results: null and empty texts have no words; a null id counts as the empty string. Repeated rows count again. Words
of any length are taken whole, as are texts. Ties go to the word that is smaller in code points. An empty table gives an
empty result, and so does one without a word that repeats; columns but id and text are ignored.
"""

from __future__ import annotations

import string
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import cut, to_python

LETTERS = r"A-Za-zÀ-ÿ"
#: A shard has at most so many words, and begins anew behind the word that reaches so many letters.
SHARD_WORDS, SHARD_LETTERS = 1 << 16, 1 << 20
#: A round's shards have so many bytes, or are one shard.
ROUND_BYTES = 32 << 20


def words(docs: DataFrame, least: int = 7, times: int = 2, every: int = 31, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: words of at least `least` letters that stand at least `times` times, some of them with a letter dropped.

    A run of letters loses one if `every` divides its hash with the document's id; every=0 drops none.
    """
    run = F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0)))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), run.alias("run"))
    rows = rows.select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("word"))
    if every:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = (h % F.length("word")).cast("int")
        cut_out = F.concat(F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)"))
        rows = rows.select("word", h.alias("h"), at.alias("at")).select(F.when(F.col("h") % every == 0, cut_out).otherwise(F.col("word")).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("n")).filter((F.col("n") >= times) & (F.length("word") >= least))


class Trie:
    """Sorted different words as arrays. Nodes are numbered level by level, so a node's children lie side by side: those of
    node i are first[i] .. first[i + 1], and their letters are bytes at the same places of labels. Node 0 is the root."""

    def __init__(self, labels: bytes, first: array, ends: array, counts: array):
        self.labels, self.first, self.ends, self.counts = labels, first, ends, counts

    @classmethod
    def of(cls, sorted_words: list[bytes], counts: list[int]) -> Trie:
        sizes = np.array([len(w) for w in sorted_words])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        letters = np.frombuffer(b"".join(sorted_words), np.uint8)
        live = np.arange(len(sizes))  # words that reach this depth
        fresh = np.zeros(len(sizes), bool)  # a word that leaves its predecessor's path here or before
        fresh[0] = True
        labels, first, ends = [np.zeros(1, np.uint8)], [np.array([1])], np.zeros(len(sizes), np.int64)
        base, depth, owners = 1, 0, np.array([0])
        while True:
            reach = live[sizes[live] > depth]
            if not len(reach):
                break
            letter = letters[starts[reach] + depth]
            # The predecessor in the sorted list, if it reaches this depth too, else the path ends there.
            before = np.concatenate([[-1], reach[:-1]])
            own = np.where(before >= 0, letter != np.concatenate([[0], letter[:-1]]), True) | (before != reach - 1)
            fresh[reach] |= own
            new = reach[fresh[reach]]
            if depth:
                first.append(base + np.searchsorted(new, owners))
            labels.append(letters[starts[new] + depth])
            done = new[sizes[new] == depth + 1]
            ends[done] = base + np.searchsorted(new, done)
            base, owners, live, depth = base + len(new), new, reach, depth + 1
        first.append(np.full(len(owners) + 1, base))
        order = np.argsort(ends)
        whole = np.concatenate(first)
        return cls(np.concatenate(labels).tobytes(), array("i", whole.astype(np.int32).tobytes()), array("i", ends[order].astype(np.int32).tobytes()), array("q", np.array(counts, np.int64)[order].tobytes()))

    def pack(self) -> bytes:
        return b"".join(len(x).to_bytes(8, "little") + x for x in (self.labels, self.first.tobytes(), self.ends.tobytes(), self.counts.tobytes()))

    @classmethod
    def unpack(cls, packed: bytes) -> Trie:
        parts, at = [], 0
        for _ in range(4):
            n = int.from_bytes(packed[at : at + 8], "little")
            parts.append(packed[at + 8 : at + 8 + n])
            at += 8 + n
        return cls(parts[0], array("i", parts[1]), array("i", parts[2]), array("q", parts[3]))

    def near(self, w: bytes) -> Iterator[tuple[int, bytes]]:
        """count and word of each word that differs from w by one inserted, deleted or replaced letter; each once."""
        labels, first, find, m = self.labels, self.first, self.labels.find, len(w)

        def follow(node: int, at: int) -> int:
            """The count of the word that the rest of w leads to from a node, or 0."""
            for q in range(at, m):
                node = find(w[q], first[node], first[node + 1])
                if node < 0:
                    return 0
            i = bisect_left(self.ends, node)
            return self.counts[i] if i < len(self.ends) and self.ends[i] == node else 0

        node = 0
        for p in range(m + 1):
            lo, hi = first[node], first[node + 1]
            c = w[p] if p < m else -1
            # Of equal letters in a row the first is dropped, and one more goes behind the last: each result once.
            if p < m and (p == 0 or c != w[p - 1]) and (n := follow(node, p + 1)):
                yield n, w[:p] + w[p + 1 :]
            after = w[p + 1] if p + 1 < m else -1
            for child in range(lo, hi):
                x = labels[child]
                if x != c:
                    a, b = first[child], first[child + 1]
                    # The next letter is looked up here, as most children fail at it.
                    if p < m:
                        k = find(after, a, b) if after >= 0 else child
                        if k >= 0 and (n := follow(k, p + 1 + (after >= 0))):
                            yield n, w[:p] + bytes((x,)) + w[p + 1 :]
                        k = find(c, a, b)
                        if k >= 0 and (n := follow(k, p + 1)):
                            yield n, w[:p] + bytes((x,)) + w[p:]
                    elif n := follow(child, m):
                        yield n, w + bytes((x,))
            if p < m:
                node = find(c, lo, hi)
                if node < 0:
                    return


def shards(vocabulary: DataFrame) -> DataFrame:
    """at, size, packed: the tries of a table of word and n that is sorted within partitions."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        counts: list[int] = []
        letters = 0

        def shard() -> pa.RecordBatch:
            packed = Trie.of(held, counts).pack()
            return pa.record_batch([pa.array([held[0].decode("latin-1")]), pa.array([len(packed)], pa.int64()), pa.array([packed], pa.binary())], ["at", "size", "packed"])

        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (len(held) >= SHARD_WORDS or letters >= SHARD_LETTERS):
                    yield shard()
                    held, counts, letters = [], [], 0
                held.append(w.encode("latin-1"))
                counts.append(n)
                letters += len(w)
        if held:
            yield shard()

    return to_python(vocabulary.select("word", "n"), build, "at string, size long, packed binary")


def _rounds(sizes: list[tuple[str, int]]) -> Iterator[list[str]]:
    """Names of shards in rounds of ROUND_BYTES."""
    held, total = [], 0
    for name, size in sizes:
        if held and total + size > ROUND_BYTES:
            yield held
            held, total = [], 0
        held.append(name)
        total += size
    if held:
        yield held


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """word, n, n_near, near_n, near: how many words of the vocabulary (word, n) are near, and the one of largest n (ties: the smallest)."""
    spark = vocabulary.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = cut(vocabulary.select("word", F.col("n").cast("long").alias("n")).repartitionByRange(parts, "word").sortWithinPartitions("word"))
    tries = cut(shards(own))
    schema = "word string, n long, n_near long, near_n long, near string"
    found = []
    # A name and a size for every 65,536 words come to the driver, and one round's shards at a time.
    for names in _rounds([tuple(r) for r in tries.select("at", "size").orderBy("at").collect()]):
        sent = spark.sparkContext.broadcast([bytes(r["packed"]) for r in tries.filter(F.col("at").between(names[0], names[-1])).select("packed").collect()])
        every = not found

        def intersect(batches: Iterator[pa.RecordBatch], sent=sent, every=every) -> Iterator[pa.RecordBatch]:
            held = [Trie.unpack(x) for x in sent.value]
            for batch in batches:
                out = []
                for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    w, count, most, best = word.encode("latin-1"), 0, 0, b""
                    for trie in held:
                        for other_n, other in trie.near(w):
                            count += 1
                            if other_n > most or other_n == most and other < best:
                                most, best = other_n, other
                    if count or every:
                        out.append((word, n, count, most if count else None, best.decode("latin-1") if count else None))
                columns = zip(*out, strict=True) if out else [()] * 5
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["word", "n", "n_near", "near_n", "near"])

        found.append(cut(to_python(own, intersect, schema)))
        sent.destroy()
    if not found:
        return spark.createDataFrame([], schema)
    if len(found) == 1:
        return found[0]
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("order"), F.col("near"))))
    merged = reduce(DataFrame.unionByName, found).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    return merged.select("word", "n", "n_near", (-F.col("b.order")).alias("near_n"), F.col("b.near").alias("near"))


def forms(vocabulary: DataFrame, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n. form: the best near word, if it is at least `times` as frequent, which has to be over 1.

    Frequencies grow by that factor along forms, so a chain is no longer than their logarithm; paths are doubled until none changes.
    """
    if times < 2:
        raise ValueError("forms have to be more frequent than their variants")
    near = neighbours(vocabulary)
    form = F.col("near_n") >= times * F.col("n")
    rows = cut(near.select("word", F.when(form, F.col("near")).alias("form"), "n", "n_near", F.when(form, F.col("near_n")).alias("form_n")))
    links = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = step.select("word", "root")
        if step.filter("moved").isEmpty():
            break
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
