"""Stored panels of genes or regions: saved, replaced, listed, deleted and searched.

A panel is a folder of generations. A save writes a new one and moves a pointer over the old (merge.staged_swap), so a
search sees a panel as it was before a save or after it. Lists of genes meet rows by a semi-join, regions by bins.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.durable import discard, exists
from loomframe.operators import intervals, lookup, merge

COLUMNS = "panel string, description string, gene string, chrom string, start long, end long, name string"


class PanelStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _folder(self, panel: str) -> str:
        return f"{self.root}/{quote(panel, safe='')}"

    def _save(self, rows: DataFrame, panel: str, description: str) -> str:
        own = [x.split()[0] for x in COLUMNS.split(", ")]
        rows = rows.withColumns({"panel": F.lit(panel), "description": F.lit(description)})
        missing = {x.split()[0]: F.lit(None).cast(x.split()[1]) for x in COLUMNS.split(", ") if x.split()[0] not in rows.columns}
        return merge.staged_swap(rows.withColumns(missing).select(*own), self._folder(panel), uuid.uuid4().hex)

    def save_genes(self, panel: str, genes: DataFrame, description: str = "") -> str:
        """A panel of the different values of column gene, in place of what it was; names the generation."""
        return self._save(genes.select(F.upper(F.trim("gene")).alias("gene")).filter("gene <> ''").distinct(), panel, description)

    def save_regions(self, panel: str, regions: DataFrame, description: str = "") -> str:
        """A panel of half-open regions chrom, start, end and name, in place of what it was."""
        return self._save(regions.select("chrom", "start", "end", "name"), panel, description)

    def names(self) -> list[str]:
        """Names of all panels."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(unquote(n) for n in found if exists(self.spark, f"{self.root}/{n}/current"))

    def panel(self, panel: str) -> DataFrame:
        """Rows of a panel as they are now."""
        if not exists(self.spark, f"{self._folder(panel)}/current"):
            raise KeyError(panel)
        return merge.current(self.spark, self._folder(panel))

    def delete(self, panel: str) -> bool:
        """Whether there was such a panel. The pointer goes first, so that no half panel is ever read."""
        if not exists(self.spark, f"{self._folder(panel)}/current"):
            return False
        discard(self.spark, f"{self._folder(panel)}/current")
        discard(self.spark, self._folder(panel))
        return True

    def search(self, rows: DataFrame, panels: Sequence[str], gene: str = "gene_symbol", chrom: str = "chrom", pos: str = "pos", ref: str = "ref") -> DataFrame:
        """Rows whose gene is in one of the panels or that touch a region of one; each once for each time it is in rows."""
        listed = reduce(DataFrame.unionByName, [self.panel(p) for p in panels])
        keyed = rows.withColumn("_gene", F.upper(F.trim(gene)))
        by_gene = lookup.semi(keyed, listed.filter("gene is not null").select(F.col("gene").alias("_gene")), ["_gene"])
        others = lookup.semi(keyed.filter("_gene is not null"), listed.filter("gene is not null").select(F.col("gene").alias("_gene")), ["_gene"], keep=False).unionByName(keyed.filter("_gene is null"))
        regions = listed.filter("gene is null").select(F.col("chrom").alias(chrom), "start", "end")
        by_place = intervals.within(others, regions, chrom, pos, F.length(ref), "start", "end")
        return by_gene.unionByName(by_place).select(*rows.columns)
