"""Writers: report tables as CSV, wiki table lines."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gaugework.functions.scalars import float_text, quoted, two_decimals

# Cells keep their white space; quotes are doubled.
CSV_OPTIONS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
FLOATS = (T.DoubleType, T.FloatType)


def write_csv(df: DataFrame, path: str) -> str:
    """A header CSV folder, full precision."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
    return path


@contextlib.contextmanager
def staged(spark: SparkSession, target: str) -> Iterator[str]:
    """A folder to write to that becomes ``target`` when the block ends well, and goes when it fails.

    Readers see all tables of a run or none: the last step is a rename in the file system of
    ``target``, and what stood there before makes way for it and is deleted afterwards.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    final = path(target)
    files = final.getFileSystem(spark._jsc.hadoopConfiguration())
    mark = uuid.uuid4().hex
    stage, old = path(f"{target}.staging-{mark}"), path(f"{target}.replaced-{mark}")
    try:
        yield stage.toString()
        files.mkdirs(stage)  # a run without a table publishes an empty folder
        replaced = files.exists(final) and files.rename(final, old)
        if not files.rename(stage, final):
            if replaced:
                files.rename(old, final)
            raise OSError(f"cannot publish {target}")
        if replaced:
            files.delete(old, True)
    except BaseException:
        files.delete(stage, True)
        raise


def write_parts(df: DataFrame, path: str, by: list[str]) -> str:
    """A header CSV folder with a folder per value of ``by``."""
    df.write.mode("overwrite").partitionBy(*by).options(**CSV_OPTIONS).csv(path)
    return path


def rounded_text(df: DataFrame) -> DataFrame:
    """Floating columns as text with two decimals."""
    return df.select(
        *[
            (two_decimals(quoted(f.name)) if isinstance(f.dataType, FLOATS) else quoted(f.name)).alias(f.name)
            for f in df.schema.fields
        ]
    )


def save_groups(reports: Mapping[str, DataFrame], file_prefix: str, folder: str) -> dict[str, str]:
    """One CSV folder per group, floats with two decimals; "default" is left out."""
    return {
        name: write_csv(rounded_text(report), f"{folder}/{file_prefix}_{name}.csv")
        for name, report in reports.items()
        if name != "default"
    }


def save_tagged(tagged: DataFrame, folder: str) -> str:
    """All groups in one write, a folder per ``group_name``."""
    rounded_text(tagged).write.mode("overwrite").partitionBy("group_name").options(**CSV_OPTIONS).csv(folder)
    return folder


def flat_overview(overview: DataFrame) -> DataFrame:
    """The overview with the time range as two columns."""
    rest = [c for c in overview.columns if c != "data_range"]
    return overview.select(*rest, "data_range.start", "data_range.end")


def cell_text(df: DataFrame) -> list:
    """Every cell as the text of a wiki table; missing cells read ``nan``."""
    cells = []
    for f in df.schema.fields:
        cell = quoted(f.name)
        if isinstance(f.dataType, FLOATS):
            cells.append(float_text(cell.cast("double")))
        elif isinstance(f.dataType, T.BooleanType):
            cells.append(F.coalesce(F.initcap(cell.cast("string")), F.lit("nan")))
        else:
            cells.append(F.coalesce(cell.cast("string"), F.lit("nan")))
    return cells


def wiki_header(df: DataFrame) -> str:
    return "|| " + " || ".join(df.columns) + " ||"


def wiki_rows(df: DataFrame) -> DataFrame:
    """The body lines of a wiki table, one per row, in the order of ``df``."""
    return df.select(
        F.concat(F.lit("| "), F.concat_ws(" | ", *cell_text(df)), F.lit(" |")).alias("line")
    )


def wiki_lines(df: DataFrame) -> DataFrame:
    """``part, line``: the header line (part 0) and the body lines (part 1)."""
    header = df.sparkSession.range(0, 1, 1, 1).select(F.lit(0).alias("part"), F.lit(wiki_header(df)).alias("line"))
    return header.unionAll(wiki_rows(df).select(F.lit(1).alias("part"), "line"))


def write_wiki(df: DataFrame, path: str) -> str:
    """A wiki table as a folder of text files; the header is the first file."""
    wiki_lines(df).select("line").write.mode("overwrite").text(path)
    return path


