"""Uploaded workbooks: what speaks against one, from the directory of its archive, which is not unpacked."""

from __future__ import annotations

from collections.abc import Iterator
from io import BytesIO
from zipfile import BadZipFile, ZipFile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a refused upload is told, and the members that a workbook has.
REFUSALS = {
    "kind": "Upload an .xlsx or .xlsm Excel workbook.", "unreadable": "This file is not a readable Excel workbook.", "members": "This workbook contains too many internal files.",
    "size": "This workbook expands beyond the allowed size.", "password": "Password-protected workbooks are not supported.",
}
NEEDED = {"[Content_Types].xml", "xl/workbook.xml"}


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all files below a folder; files of no bytes give no row, as Spark's reader leaves them out."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def members(content: bytes | None) -> list[tuple[str, int, bool]] | None:
    """(name, expanded size, encrypted) of an archive's members by its directory; None if it has none."""
    try:
        with ZipFile(BytesIO(content or b"")) as archive:
            return [(m.filename, m.file_size, bool(m.flag_bits & 1)) for m in archive.infolist()]
    except (BadZipFile, OSError, ValueError, NotImplementedError):
        return None


def directories(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, and of the archive: readable, n_members, expanded, encrypted; only these numbers leave the function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column(1).to_pylist():
                found = members(raw)
                names = {n for n, _, _ in found or ()}
                out.append((NEEDED <= names, len(found or ()), sum(s for _, s, _ in found or ()), any(e for _, _, e in found or ())))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.bool_()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.bool_())], ["path", "readable", "n_members", "expanded", "encrypted"])

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(run, "path string, readable boolean, n_members long, expanded long, encrypted boolean")


def checked(files: DataFrame, most_bytes: int = 100 << 20, most_members: int = 2000, path: str = "path", content: str = "content") -> DataFrame:
    """(path, problem) of uploads: why each is refused, null if it is not; the first rule counts.

    The name must end in .xlsx or .xlsm, the archive must have the parts of a workbook, at
    most ``most_members`` members of ``most_bytes`` bytes together once expanded, and none
    encrypted.  Null and empty contents are unreadable, null names are of no kind.  Repeated
    rows each give a row.  An empty table gives none.
    """
    c = F.col
    kind = F.lower(F.regexp_extract(F.coalesce(c("path"), F.lit("")), r"([^./\\]*)$", 1)).isin("xlsx", "xlsm") & c("path").contains(".")
    rules = [(~F.coalesce(kind, F.lit(False)), "kind"), (~c("readable"), "unreadable"), (c("n_members") > most_members, "members"), (c("expanded") > most_bytes, "size"), (c("encrypted"), "password")]
    problem = F.lit(None).cast("string")
    for rule, name in reversed(rules):
        problem = F.when(rule, REFUSALS[name]).otherwise(problem)
    return directories(files, path, content).select("path", problem.alias("problem"))
