"""Locators: the file and the place in it of each row, for tables that are read from Parquet files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sameword.shared import fresh_name, stage


@dataclass
class Located:
    """A table with a file and a row column, named so that they clash with none of its own. file is a hash of the path,
    which file_table() has in full."""

    rows: DataFrame
    file: str
    row: str

    @property
    def place(self) -> list[str]:
        return [self.file, self.row]


def hidden(docs: DataFrame):
    """The scan's metadata, also where the table has a column of that name."""
    return docs.metadataColumn("_metadata")


def with_locator(docs: DataFrame) -> Located:
    """A row's locator is equal at every reading. A table that isn't read from files is written to the shared folder first."""
    file, row = fresh_name("_at_file", *docs.columns), fresh_name("_at_row", *docs.columns)
    for at in (docs, None):
        at = stage(docs, "located") if at is None else at
        try:
            return Located(at.select("*", F.xxhash64(hidden(at)["file_path"]).alias(file), hidden(at)["row_index"].alias(row)), file, row)
        except AnalysisException:
            if at is not docs:
                raise
    raise AssertionError


def file_table(docs: DataFrame) -> DataFrame:
    """file, path: the files that the locators of a table's rows name."""
    path = hidden(docs)["file_path"]
    return docs.select(F.xxhash64(path).alias("file"), path.alias("path")).distinct()
