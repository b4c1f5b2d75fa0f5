"""Removal of repeated units of text by global digest groups.

The normal form of a text is its words in lower case joined by one space; digests have 128 bits. Units are paragraphs
and lines. With whole_lines, a line is one unit. By default it is cut in pieces that cover it, so that a passage inside a
line is found as well where the rest of the line differs:

* pieces of a line. A sentence of min_words words or more is one; the shorter ones between two such are joined until
  they have min_words words and the last is a closing one by its hash, so that the cuts inside a passage don't depend on
  the text before it. What stays below min_words is a piece with the digest of the piece before it and itself (the first
  of a line: of itself and the piece behind it; the only one: of itself), so it goes where such a sequence is repeated.
  The pieces cover their line, so a repeated line goes as a whole, whatever its length.
* paragraphs, lines without a blank one between, which are compared whatever way they are broken into lines. One that is
  broken like the group's first occurrence is left to its lines' pieces, which cover it.

All digests are grouped globally; the occurrence that ranks first, by id, then place in the document, stays and the
others are removed: the union of their spans. Only digests that occur twice are joined back to the units, by a join
whose hot digests Spark can split, as both its sides are plain exchanges.

Defined results: null, empty and blank texts have no units. Rows that agree in id and text are one document and get the
same result. A null id ranks last. An empty table gives an empty result. Extra columns are ignored, or kept by clean(). A very
long text is cut as a whole; a task holds its units besides one Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import cut, to_python

SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
UNITS_AT_ONCE = 10_000


def _digest(words: list[str], kind: bytes = b"") -> bytes:
    return blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16, person=kind).digest()


def _pieces(line: str, min_words: int) -> list[tuple[int, int, list[str]]]:
    """start, end and words of each piece of a line."""
    out, begun, last, own = [], 0, 0, []

    def close() -> None:
        nonlocal own
        if own:
            out.append((begun, last, own))
        own = []

    at = 0
    for end, after in [*(m.span() for m in SENTENCE_END.finditer(line)), (len(line), len(line))]:
        raw = line[at:end]
        words = raw.lower().split()
        if words:
            if len(words) >= min_words:
                close()
            if not own:
                begun = at + len(raw) - len(raw.lstrip())
            last = at + len(raw.rstrip())
            own = own + words
            if len(words) >= min_words or (len(own) >= min_words and crc32(" ".join(words).encode("utf-8", "surrogatepass")) % 2):
                close()
        at = after
    close()
    return out


def units_of(text: str, min_words: int, whole_lines: bool = False) -> Iterator[tuple[int, int, int, bytes]]:
    """start, end (in code points, blanks around left out), words, digest of each line or piece of a line."""
    at = 0
    for line in text.split("\n"):
        if whole_lines:
            words, begun = line.lower().split(), len(line) - len(line.lstrip())
            pieces = [(begun, len(line.rstrip()), words)] if words else []
        else:
            pieces = _pieces(line, min_words)
        for i, (start, end, words) in enumerate(pieces):
            if len(words) >= min_words or len(pieces) == 1:
                digest = _digest(words)
            elif i:
                digest = _digest([*pieces[i - 1][2], "\n", *words], b"behind")
            else:
                digest = _digest([*words, "\n", *pieces[1][2]], b"before")
            yield at + start, at + end, len(words), digest
        at += len(line) + 1


def paragraphs_of(text: str) -> Iterator[tuple[int, int, int, bytes, int]]:
    """start, end, words, digest and layout (a hash of the words with the line ends, never 0) of each paragraph."""
    at, begun, last, lines = 0, 0, 0, []
    for line in [*text.split("\n"), ""]:
        words = line.lower().split()
        if words:
            if not lines:
                begun = at + len(line) - len(line.lstrip())
            last = at + len(line.rstrip())
            lines.append(words)
        elif lines:
            every = [w for x in lines for w in x]
            layout = int.from_bytes(_digest([" ".join(x) + "\n" for x in lines], b"layout")[:8], "little", signed=True)
            yield begun, last, len(every), _digest(every, b"paragraph"), layout or 1
            lines = []
        at += len(line) + 1


def units(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = 8, whole_lines: bool = False) -> DataFrame:
    """doc_id, text_hash, start, end, n_words, d1, d2 (the digest), layout (0 but for paragraphs) of every unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, texts, at = batch.column(0), batch.column(1), batch.column(2), 0
            while at < len(ids):
                own, rows = [], []
                while at < len(ids) and len(own) < UNITS_AT_ONCE:
                    own_text = texts[at].as_py() or ""
                    found = [(*u, 0) for u in units_of(own_text, min_words, whole_lines)]
                    found += paragraphs_of(own_text)
                    own += found
                    rows += [at] * len(found)
                    at += 1
                take = pa.array(rows, pa.int64())
                starts, ends, sizes, digests, layouts = zip(*own, strict=True) if own else ((),) * 5
                d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                cols = [ids.take(take), hashes.take(take), *(pa.array(x, pa.int32()) for x in (starts, ends, sizes)), *(pa.array(np.ascontiguousarray(d[:, i])) for i in (0, 1)), pa.array(layouts, pa.int64())]
                yield pa.record_batch(cols, ["doc_id", "text_hash", "start", "end", "n_words", "d1", "d2", "layout"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).cast("string").alias("text"))
    return to_python(rows, run, "doc_id long, text_hash long, start int, end int, n_words int, d1 long, d2 long, layout long")


def repeated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = 8, whole_lines: bool = False) -> DataFrame:
    """The units to remove: doc_id, text_hash, start, end, n_words, first_doc_id, first_start (of the one that stays)."""
    found = cut(units(docs, id_col, text, min_words, whole_lines))  # both sides of the join read it
    rank = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("rank"), "doc_id", "text_hash", "start", "layout")
    groups = found.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.max(rank).alias("last"), F.min("layout").alias("low"), F.max("layout").alias("high"))
    many = groups.filter("first <> last AND (low = 0 AND high = 0 OR low <> high)")
    twice = cut(many.select("d1", "d2", F.col("first.doc_id").alias("first_doc_id"), F.col("first.text_hash").alias("first_hash"), F.col("first.start").alias("first_start"), F.col("first.layout").alias("first_layout")))
    own = F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("text_hash") == F.col("first_hash")) & (F.col("start") == F.col("first_start"))
    return found.join(twice.hint("merge"), ["d1", "d2"]).filter(~own & ((F.col("layout") == 0) | (F.col("layout") != F.col("first_layout")))).select("doc_id", "text_hash", "start", "end", "n_words", "first_doc_id", "first_start")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the spans, which may overlap, and the blanks behind them, up to a line's end; a line that loses all goes with its end."""
    union: list[list[int]] = []
    for start, end in sorted(spans):
        if union and start < union[-1][1]:
            union[-1][1] = max(union[-1][1], end)
        else:
            union.append([start, end])
    out, at, i = [], 0, 0
    for line in text.split("\n"):
        parts, here, lost = [], 0, False
        while i < len(union) and union[i][0] < at + len(line):
            a, b = max(union[i][0] - at, here), min(union[i][1] - at, len(line))
            parts.append(line[here:a])
            while b < len(line) and line[b].isspace():
                b += 1
            here, lost = b, True
            if union[i][1] > at + len(line):
                break  # a paragraph goes on in the next line
            i += 1
        left = "".join([*parts, line[here:]])
        if not lost or left.strip():
            out.append(left.rstrip() if lost else left)
        at += len(line) + 1
    return "\n".join(out)


def clean(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = 8, whole_lines: bool = False) -> DataFrame:
    """docs with repeated units gone from text; other columns stay."""
    spans = repeated(docs, id_col, text, min_words, whole_lines).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    @F.pandas_udf("string")
    def cleaned(texts, lists):
        return texts.combine(lists, lambda t, s: t if s is None or t is None else without(t, [(x["start"], x["end"]) for x in s]))

    # The row is packed, so that none of its names can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("own_id"), F.xxhash64(F.col(text)).alias("own_hash"))
    joined = rows.join(spans, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash")), "left")
    old = F.col("row")[text]
    fresh = F.when(F.col("spans").isNotNull(), cleaned(old, F.col("spans"))).otherwise(old)
    return joined.select("row", fresh.alias("fresh")).select(*[F.col("fresh").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
