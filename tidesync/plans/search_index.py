"""Skipping index for text search: which files hold which trigrams.

``col ILIKE '%term%'`` has no push-down, so a search reads the text column of every file. The index names,
for each three-character piece of the lower-cased texts, the files that hold it; a search looks up the pieces
of its term, reads only the files that hold all of them and applies the exact predicate there. Pieces are
needed for a match, not enough for one, so the index only skips files and never decides on rows.

Building is one pass over the text column: the pieces of a row are made distinct per file in each task, so the
shuffle carries at most one row per task, file and piece. The index is sorted by piece and file (a piece that
all files hold is cut into several ranges), so a lookup reads the row groups of its pieces. The driver gets the names of
candidate files, as it does for any scan. ``extend`` reads only files that are not indexed yet.

Pieces prune best where files are clustered by the text, or for rare terms; a common term over unclustered files
reads them all, as without the index.

Cases: NULL texts have no pieces and match nothing; files with short texts only have none and are still listed. A
term without three literal characters in a row (wildcards cut it) reads every file. An empty term returns all rows.
Files that are not indexed are always read. Files that are gone are not read. A file's name must never be written
again with other rows (Spark's writers never do).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesync.functions.text import escape_like, wildcard_wrap
from tidesync.operators.query import search
from tidesync.plans.versions import file_system

PIECE = 3
ESCAPE = "\\"


def literal_runs(pattern: str) -> list[str]:
    """The parts of a LIKE pattern between its wildcards, escapes resolved."""
    runs, run, chars = [], [], iter(pattern)
    for ch in chars:
        if ch in "%_":
            runs.append("".join(run))
            run = []
        else:
            run.append(next(chars, "") if ch == ESCAPE else ch)
    return [r for r in [*runs, "".join(run)] if r]


def pieces_of(spark: SparkSession, term: str, literal: bool = False) -> list[str]:
    """Pieces that every text matching the term holds. The whole pattern is lower-cased by Spark, as ILIKE does."""
    pattern = wildcard_wrap(escape_like(term) if literal else term)
    lowered = spark.range(1).select(F.lower(F.lit(pattern)).alias("p")).first()["p"]
    return sorted({run[i:i + PIECE] for run in literal_runs(lowered) for i in range(len(run) - PIECE + 1)})


def same_form(uri: str) -> str:
    """A file's name as the listing and as the scan give it (``file:///x`` and ``file:/x``)."""
    return re.sub(r"^([a-z][a-z0-9+.-]*):///", r"\1:/", uri)


def as_path(uri: str) -> str:
    """A listed name as a path to read: URI escapes resolved, glob characters taken literally."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(uri))


@dataclass
class Search:
    rows: DataFrame
    files_read: int
    files_total: int


@dataclass
class SearchIndex:
    spark: SparkSession
    folder: str                  # the table's Parquet folder
    column: str
    root: str                    # folder of the index

    def _table(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)

    def _read(self, part: str, schema: str) -> DataFrame:
        path = f"{self.root}/{part}"
        fs, where = file_system(self.spark, path)
        return self.spark.read.schema(schema).parquet(path) if fs.exists(where) else self.spark.createDataFrame([], schema)

    def _indexed(self) -> set[str]:
        return {r["file"] for r in self._read("files", "file string").distinct().toLocalIterator()}

    def _open(self, files: list[str], table: DataFrame) -> DataFrame:
        if not files:
            return table.limit(0)
        return self.spark.read.schema(table.schema).option("basePath", self.folder).parquet(*map(as_path, files))

    def extend(self) -> int:
        """Index the files that are not indexed yet; returns their number. The file names are written last, so
        files whose pieces were not all written stay unindexed."""
        table = self._table()
        indexed = self._indexed()
        new = sorted(f for f in table.inputFiles() if same_form(f) not in indexed)
        if not new:
            return 0
        text = F.lower(F.col(self.column))
        starts = F.sequence(F.lit(1), F.length("text") - (PIECE - 1))
        rows = self._open(new, table).select(F.col("_metadata.file_path").alias("file"), text.alias("text"))
        pieces = rows.where(F.length("text") >= PIECE).select(
            F.explode(F.array_distinct(F.transform(starts, lambda i: F.substr("text", i, F.lit(PIECE))))).alias("piece"), "file"
        ).distinct()
        sorted_pieces = pieces.repartitionByRange("piece", "file").sortWithinPartitions("piece", "file")
        sorted_pieces.write.mode("append").parquet(f"{self.root}/pieces")
        names = self.spark.createDataFrame([(same_form(f),) for f in new], "file string")
        names.write.mode("append").parquet(f"{self.root}/files")
        return len(new)

    def candidates(self, term: str, literal: bool = False) -> set[str] | None:
        """Indexed files that hold every piece of the term; None if the term has no piece."""
        pieces = pieces_of(self.spark, term, literal)
        if not pieces:
            return None
        found = self._read("pieces", "piece string, file string").where(F.col("piece").isin(pieces)).distinct()
        full = found.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") == len(pieces))
        return {same_form(r["file"]) for r in full.select("file").toLocalIterator()}

    def search(self, term: str, literal: bool = False) -> Search:
        """Rows whose text contains the term (``operators.query.search``), read from candidate files only."""
        table = self._table()
        files = table.inputFiles()
        held = self.candidates(term, literal) if term else None
        if held is None:
            return Search(search(table, self.column, term, literal), len(files), len(files))
        indexed = self._indexed()
        chosen = sorted(f for f in files if same_form(f) in held or same_form(f) not in indexed)
        return Search(search(self._open(chosen, table), self.column, term, literal), len(chosen), len(files))
