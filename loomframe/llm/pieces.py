"""SentencePiece encoding by sampling, and decoding.

A text's pieces form a lattice: an edge from i to j for every piece that equals the characters i..j. Forward filtering
sums, for every place, the weights of all paths to it; backward sampling draws the last edge from those sums, then the
one before it, and so draws a whole segmentation in proportion to exp(alpha * sum of log-probabilities). The random
numbers come from a hash of the row's key and the place in the row, so a row's pieces do not depend on partitions, batch
sizes or reruns. Pieces never cross the start of a run of spaces, so each run with the word behind it is a lattice of its
own; equal ones are filtered once a batch.

Characters that no piece holds become byte pieces, also a literal U+2581, so decode(encode(text)) is the text itself.
For unigram models a piece's log-probability is the model's score. Models of merges have ranks for scores; there it is
that of Zipf's law at the rank.

Defined results: a null text has null pieces, an empty one none. Repeated rows with equal keys get equal pieces. Texts of any
length are encoded whole; a run of spaces with the word behind it is one lattice whatever its length. An empty
table gives an empty result. Extra columns pass if named in keep.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import to_python

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters that are segmented at once, and lattice characters at most in a call of the filter.
AT_ONCE = 2_000_000
SPACES = re.compile(r" *[^ \n]+| +|\n")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """A model's pieces as a trie in arrays: child(node, character class) by search in sorted keys."""

    def __init__(self, model: str, alpha: float):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model)
        self.size = sp.get_piece_size()
        self.byte_id, own, self.bytes_of = np.full(256, -1, np.int64), {}, [b""] * self.size
        for i in range(self.size):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(text[3:-1], 16)] = i
                self.bytes_of[i] = bytes([int(text[3:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and text:
                own[text.replace("▁", " ")] = i
                self.bytes_of[i] = text.replace("▁", " ").encode()
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces, so decoding would lose characters")
        scores = np.array([sp.get_score(i) for i in range(self.size)])
        if all(float(x).is_integer() for x in scores[list(own.values())]):
            rank = np.minimum(-scores, self.size) + 1
            scores = -np.log(rank) - np.log(np.sum(1 / rank[list(own.values())]))
        self.logp = alpha * scores
        self.logp_bytes = alpha * (min(scores[i] for i in own.values()) - 10)
        self.crossing = any(" " in p.lstrip(" ") for p in own)
        self.newline = any("\n" in p for p in own)
        chars = sorted({c for p in own for c in p})
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        nodes: dict[str, int] = {"": 0}
        keys, self_piece = [], [-1]
        for p in sorted(own):
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    self_piece.append(-1)
                    keys.append((nodes[p[: k - 1]] * self.width + int(self.classes[ord(p[k - 1])]), nodes[p[:k]]))
            self_piece[nodes[p]] = own[p]
        # Open addressing, at most a quarter full.
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.child = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        for key, child in keys:
            at = int(self._slot(np.array([key]))[0])
            while self.keys[at] != -1:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.child[at] = key, child
        self.piece_at = np.array(self_piece, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _GOLD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def children(self, keys: np.ndarray) -> np.ndarray:
        """The nodes of keys, -1 for none."""
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.child[at], np.int32(-1))
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            at[left] = (at[left] + 1) % len(self.keys)
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.child[at[left[hit]]]
            left = left[~hit & (found != -1)]
        return out

    def chunks(self, text: str) -> list[str]:
        """The independent lattices of a text, with the space that SentencePiece puts before it."""
        if self.crossing:
            return [" " + text] if text else []
        if not text:
            return []
        t = " " + text
        if "  " in t or "\0" in t or self.newline:
            return re.findall(" *[^ ]+| +", t) if self.newline else SPACES.findall(t)
        return [x for x in t.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0") if x]

    def edges(self, chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end, piece of every edge; ends: for each character, where its chunk ends. A piece of size + c stands for the bytes of character c."""
        cls = self.classes[chars].astype(np.int64)
        starts, node, length, found = np.arange(len(chars), dtype=np.int32), np.zeros(len(chars), np.int64), 0, []
        single = np.zeros(len(chars), bool)
        while len(starts):
            node = self.children(node * np.int64(self.width) + cls[starts + length])
            ok = node >= 0
            starts, node = starts[ok], node[ok]
            length += 1
            piece = self.piece_at[node]
            whole = piece >= 0
            found.append((starts[whole], starts[whole] + np.int32(length), piece[whole]))
            if length == 1:
                single[starts[whole]] = True
            more = starts + length < ends[starts]
            starts, node = starts[more], node[more]
        lone = np.flatnonzero(~single).astype(np.int32)
        found.append((lone, lone + np.int32(1), (self.size + chars[lone]).astype(np.int32)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def segment(self, texts: Sequence[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all texts in one array, and how many each has."""
        chunks, counts = [], []
        for t in texts:
            own = self.chunks(t)
            chunks += own
            counts.append(len(own))
        if not chunks:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        kinds = dict.fromkeys(chunks)
        for i, k in enumerate(kinds):
            kinds[k] = i
        which = np.fromiter(map(kinds.__getitem__, chunks), np.int32, len(chunks))
        del chunks
        chars = np.frombuffer("".join(kinds).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, kinds), np.int32, len(kinds))
        last = np.cumsum(sizes, dtype=np.int32)
        first = last - sizes
        place = np.arange(len(chars), dtype=np.int32) - np.repeat(first, sizes)
        start, end, piece = self.edges(chars, np.repeat(last, sizes))
        weight = np.where(piece < self.size, self.logp[np.minimum(piece, self.size - 1)], self.logp_bytes)
        # Places are those behind a character. Edges come in runs by length, so a stable sort by their end merges runs.
        by_end = np.argsort(end, kind="stable")
        start, end, piece, weight = start[by_end], end[by_end], piece[by_end], weight[by_end]
        begins = np.searchsorted(end, np.arange(1, len(chars) + 1, dtype=np.int32)).astype(np.int32)
        upto = np.append(begins[1:], np.int32(len(end)))
        # Forward sums go through the places by their distance from the chunk's start.
        depth = place[end - 1]
        order = np.argsort(depth.astype(np.int16) if depth.max() < 1 << 15 else depth, kind="stable")
        bounds = np.searchsorted(depth[order], np.arange(int(depth.max()) + 2))
        reach = np.zeros(len(chars) + 1)  # of the place behind each character; the last is that of all starts
        behind = np.where(place[start] == 0, np.int32(len(chars)), start - 1)
        total = np.empty(len(start))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = order[a:b]
            ends = end[own]
            s = reach[behind[own]] + weight[own]
            runs = np.flatnonzero(np.diff(ends, prepend=-1))
            reach[ends[runs] - 1] = np.logaddexp.reduceat(s, runs)
            total[own] = s
        share = np.exp(total - reach[end - 1])  # of each place, they sum to 1
        del place, total, weight, depth, order, behind, by_end
        first_char = np.zeros(len(chars), bool)
        first_char[first] = True
        # Backward sampling of all chunks at once.
        counts = np.array(counts)
        row = np.repeat(np.arange(len(texts)), counts)
        no = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        seed = mixed(keys.astype(np.uint64)[row] + _GOLD * (no.astype(np.uint64) + np.uint64(1)))
        n_pieces, at, who, drawn, step = np.zeros(len(which), np.int64), last[which] - 1, np.arange(len(which)), [], 0
        while len(who):
            u = (mixed(seed[who] + _GOLD * np.full(1, step, np.uint64)) >> np.uint64(11)) * (1 / (1 << 53))
            lo, hi = begins[at], upto[at]
            pick, over = lo.copy(), np.flatnonzero(hi - lo > 1)
            aim, end_of = u[over], hi[over] - 1
            while len(over):  # sums of a place's own shares, so that no other text in the batch has a say
                k = pick[over]
                aim = aim - share[k]
                on = np.flatnonzero((aim >= 0) & (k < end_of))
                over, aim, end_of = over[on], aim[on], end_of[on]
                pick[over] += 1
            drawn.append((who, piece[pick]))
            n_pieces[who] += 1
            begun = start[pick]
            go = ~first_char[begun]
            who, at = who[go], begun[go] - 1
            step += 1
        stop = np.cumsum(n_pieces)
        out = np.empty(stop[-1], np.int32)
        for k, (w, p) in enumerate(drawn):
            out[stop[w] - 1 - k] = p
        per_row = np.bincount(row, weights=n_pieces, minlength=len(texts)).astype(np.int64)
        odd = np.flatnonzero(out >= self.size)
        if len(odd):
            c = out[odd] - self.size
            out[odd[c < 128]] = self.byte_id[c[c < 128]]
            if (c >= 128).any():
                out, per_row = self._spread(out, per_row)
        return out.astype(np.int32), per_row

    def _spread(self, out: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters of several bytes as so many pieces."""
        far = np.flatnonzero(out >= self.size)
        spelled = [[int(self.byte_id[b]) for b in chr(x - self.size).encode("utf-8", "surrogatepass")] for x in out[far].tolist()]
        wide = np.ones(len(out), np.int64)
        wide[far] = list(map(len, spelled))
        new = np.repeat(out, wide)
        firsts = np.cumsum(wide) - wide
        for at, ids in zip(firsts[far].tolist(), spelled, strict=True):
            new[at : at + len(ids)] = ids
        row = np.repeat(np.arange(len(per_row)), per_row)
        return new, np.bincount(row, weights=wide, minlength=len(per_row)).astype(np.int64)

    def text(self, ids: Sequence[int]) -> str:
        """The text of pieces, without the space put before it."""
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


@cache
def loaded(model: str, alpha: float) -> Pieces:
    return Pieces(model, alpha)


def encode(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), key: Sequence[str | Column] = ("doc_id",), text: str = "text",
    model: str = MODEL, alpha: float = 0.5, seed: int = 42, check: bool = False,
) -> DataFrame:
    """keep, piece_ids (array of int) and n_pieces; check: also round_trip, whether decoding gives the text. key: what names a row."""
    rows = docs.select(*keep, F.xxhash64(F.lit(seed), *key).alias("_key"), F.col(text).cast("string").alias("_text"))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model, alpha)
        for batch in batches:
            keys, texts, at = batch.column(n).to_numpy(), batch.column(n + 1), 0
            while at < len(keys):
                part, chars, begun = [], 0, at
                while at < len(keys) and chars < AT_ONCE:
                    part.append(texts[at].as_py())
                    chars += len(part[-1] or "")
                    at += 1
                ids, counts = pieces.segment([x or "" for x in part], keys[begun:at])
                offsets = np.concatenate([[0], np.cumsum(counts)])
                null = np.array([x is None for x in part])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=np.append(null, False)) if null.any() else pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                more = []
                if check:
                    flat = ids.tolist()
                    more = [pa.array([x is None or pieces.text(flat[a:b]) == x for x, a, b in zip(part, offsets, offsets[1:], strict=False)], pa.bool_())]
                yield pa.record_batch([*(c.slice(begun, at - begun) for c in batch.columns[:n]), lists, pa.array(counts, pa.int64()), *more], [*keep, "piece_ids", "n_pieces", *(["round_trip"] if check else [])])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keep).schema)
    return to_python(rows, run, f"{kinds}piece_ids array<int>, n_pieces long" + ", round_trip boolean" * check)


def decode(rows: DataFrame, ids: str = "piece_ids", model: str = MODEL, to: str = "decoded") -> DataFrame:
    """rows with the text of their pieces; null pieces give a null text."""

    @F.pandas_udf("string")
    def text(column):
        pieces = loaded(model, 0.5)
        return column.map(lambda x: None if x is None else pieces.text(x.tolist()))

    return rows.withColumn(to, text(F.col(ids)))
