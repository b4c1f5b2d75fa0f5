"""Token totals by source, language and tokenizer version, kept up by signed deltas.

A batch of changes (insert, delete, revise) becomes signed sums by key. Its sums are written to a data folder of their own;
then a small entry that names the folder is moved into place under the batch id. The move doesn't overwrite, so a batch
counts from one moment on, committing an id again does nothing, and of two writers of one id one wins. What a lost run
leaves behind has no entry and doesn't count. Compaction writes the totals of the batches it has seen and then an entry,
numbered one above the last, with the list of those batches: a reader takes the last such entry and the batches that it
doesn't list. A batch that comes meanwhile isn't in the list, so it counts once, before and after.

Defined results: a null text has 0 tokens and counts as a document. Null sources and languages are keys of their own.
Repeated rows count each. Keys whose totals come to zero stay in the rollup with 0. An empty table commits an empty batch.
A very long text is counted as a whole, one at a time in a task. Columns besides those named are ignored.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator, Mapping
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import to_python

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MULTI_RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the published split pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ("source", "lang", "tokenizer")
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


@cache
def encoder(ranks: str):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def counted(docs: DataFrame, text: str = "text", ranks: str | Mapping[str, str] = RANKS, keep: tuple[str, ...] = ("doc_id", "source", "lang")) -> DataFrame:
    """keep and n_tokens (long) of every row; ranks: a vocabulary, or several by the name of the column with their counts."""
    ranks = {"n_tokens": ranks} if isinstance(ranks, str) else dict(ranks)
    rows = docs.select(*keep, F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [encoder(r).encode_ordinary for r in ranks.values()]
        for batch in batches:
            n = [[len(encode(x.as_py() or "")) for encode in encoders] for x in batch.column(len(keep))]
            yield pa.record_batch([*batch.columns[: len(keep)], *(pa.array([row[i] for row in n], pa.int64()) for i in range(len(ranks)))], [*keep, *ranks])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keep).schema)
    return to_python(rows, run, kinds + ", ".join(f"`{c}` long" for c in ranks))


def inserts(rows: DataFrame, tokenizer: Column | str, copies: Column | int = 1) -> DataFrame:
    """Signed changes for new rows with source, lang, n_tokens; copies: as how many rows each counts."""
    return _signed(rows, tokenizer, copies if isinstance(copies, Column) else F.lit(copies), F.col("n_tokens"))


def deletes(rows: DataFrame, tokenizer: Column | str, copies: Column | int = 1) -> DataFrame:
    return _signed(rows, tokenizer, -(copies if isinstance(copies, Column) else F.lit(copies)), F.col("n_tokens"))


def revisions(rows: DataFrame, tokenizer: str, old: str | None = None) -> DataFrame:
    """Changes for rows whose count went from old_tokens to n_tokens; old: their former tokenizer version, if another."""
    if old and old != tokenizer:
        return deletes(rows.withColumn("n_tokens", F.col("old_tokens")), old).unionByName(inserts(rows, tokenizer))
    return _signed(rows, tokenizer, F.lit(1), F.col("n_tokens") - F.col("old_tokens")).withColumn("n_docs", F.lit(0).cast("long"))


def _signed(rows: DataFrame, tokenizer: Column | str, times: Column, tokens: Column) -> DataFrame:
    name = tokenizer if isinstance(tokenizer, Column) else F.lit(tokenizer)
    return rows.select("source", "lang", name.alias("tokenizer"), times.cast("long").alias("n_docs"), (times * tokens).cast("long").alias("n_tokens"))


class Rollup:
    """Totals below root, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _enter(self, entry: str, content: dict) -> bool:
        """An entry written aside and moved into place; False if there is one already."""
        jvm = self.spark._jvm
        fs, aside = self._path(f"aside/{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        _, place = self._path(entry)
        fs.mkdirs(place.getParent())
        options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(options, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), fs.makeQualified(place), none)
        except Exception:
            if fs.exists(aside) and fs.exists(place):  # another writer was first
                fs.delete(aside, False)
                return False
            raise
        return True

    def _read(self, entry: str) -> dict:
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.root}/{entry}").collect()))

    def _data_of(self, batches: list[str]) -> list[str]:
        """The data folders of batches, their entries read as one table."""
        if not batches:
            return []
        rows = self.spark.read.text([f"{self.root}/batches/{b}" for b in batches]).select("value").collect()
        return sorted(json.loads(r[0])["data"] for r in rows)

    def _last(self) -> tuple[int, dict]:
        """Number and content of the last compaction."""
        names = self._names("compactions")
        return (int(names[-1]), self._read(f"compactions/{names[-1]}")) if names else (0, {"covers": [], "data": None})

    def committed(self, batch: str) -> bool:
        fs, path = self._path(f"batches/{batch}")
        return fs.exists(path)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """False if this batch was committed before. The changes are summed by key before anything is written."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id has letters, digits, - and _ only")
        if self.committed(batch):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        data = f"data/{batch}-{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.root}/{data}")
        return self._enter(f"batches/{batch}", {"data": data})

    def batches(self) -> list[str]:
        return self._names("batches")

    def _state(self) -> tuple[int, list[str], list[str]]:
        """Number of the last compaction, the batches there are, and the data folders whose sums are the totals.

        The compaction is read first: a batch that is listed later is not in it, so nothing is missed or counted twice.
        """
        number, last = self._last()
        batches, known = self.batches(), set(last["covers"])
        return number, batches, [*([last["data"]] if last["data"] else []), *self._data_of([b for b in batches if b not in known])]

    def _sum(self, folders: list[str]) -> DataFrame:
        rows = self.spark.read.schema(TOTALS).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], TOTALS)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens."""
        return self._sum(self._state()[2])

    def compact(self) -> bool:
        """One data folder for all batches so far; False if another compaction was first. Committed ids stay known."""
        number, batches, folders = self._state()
        data = f"data/compacted-{uuid.uuid4().hex}"
        self._sum(folders).write.parquet(f"{self.root}/{data}")
        return self._enter(f"compactions/{number + 1:09d}", {"data": data, "covers": batches})
