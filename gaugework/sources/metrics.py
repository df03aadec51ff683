"""Metric tables: wide (one column per metric) and long (one row per reading)."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gaugework.functions.scalars import epoch_to_timestamp, nan_to_null, quoted
from gaugework.operators.joins import attach
from gaugework.session import stored

# The texts that mean "missing" in a metric CSV.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"

INTEGER = r"^\s*[+-]?\d{1,19}\s*$"

METRIC, VALUE, SOURCE = "metric_name", "value", "source"


@dataclass(frozen=True)
class MetricFrame:
    """A wide metric table: a time column and numeric metric columns, NULL = missing."""

    df: DataFrame
    ts: str
    metrics: tuple[str, ...]

    def row_count(self) -> int:
        return self.df.count()

    def long(self) -> DataFrame:
        """``ts, metric_name, value`` with missing readings kept."""
        return self.df.unpivot([quoted(self.ts).alias("ts")], [quoted(m) for m in self.metrics], METRIC, VALUE)

    def only(self, names: Sequence[str]) -> "MetricFrame":
        """The named metrics; others are pruned from the scan."""
        wanted = tuple(m for m in self.metrics if m in set(names))
        columns = [quoted(self.ts)] + [quoted(m) for m in wanted]
        return MetricFrame(self.df.select(*columns), self.ts, wanted)


def from_table(
    df: DataFrame, ts_col: str | None = None, metrics: Sequence[str] | None = None
) -> MetricFrame:
    """A typed table as metrics: time is ``ts_col`` or the first column."""
    ts = ts_col or df.columns[0]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if metrics is None:
        metrics = [n for n, kind in kinds.items() if n != ts and isinstance(kind, T.NumericType)]
    time = quoted(ts)
    if isinstance(kinds[ts], T.NumericType):
        time = epoch_to_timestamp(time)
    elif isinstance(kinds[ts], T.StringType):
        time = F.to_timestamp(time)
    columns = [time.alias(ts)] + [nan_to_null(quoted(m).cast("double")).alias(m) for m in metrics]
    return MetricFrame(df.select(*columns), ts, tuple(metrics))


CSV = {"header": True, "escape": '"'}
CORRUPT = "_corrupt_record"
FILE = "_file"


def read_text(spark: SparkSession, path: str | Sequence[str], multi_line: bool = False, malformed: str = "fail") -> DataFrame:
    """A header CSV as text columns, missing texts as NULL; quotes inside cells are doubled.

    Files of one header are one scan; files whose columns differ or stand in another order are
    joined by column name. ``multi_line`` lets cells hold line breaks, and files are then not split.
    A line with fewer cells than the header misses its last ones. A line with more is an error when it
    is read ("fail"), loses what is too much ("keep") or the whole line ("drop").
    """
    raw = _raw_text(spark, path, multi_line, malformed)
    return raw.select(*[_present(quoted(c)).alias(c) for c in raw.columns])


def malformed_lines(spark: SparkSession, path: str | Sequence[str], multi_line: bool = False) -> DataFrame:
    """``line, cells``: the lines whose number of cells is not the header's, and whether they are "few" or "many"."""
    found = None
    for columns, group in _by_header(spark, path, multi_line).items():
        lines = _scan(spark, group, columns, multi_line).where(F.col(CORRUPT).isNotNull() & (F.length(F.concat_ws("", quoted(columns[0]))) >= 0))
        lines = lines.select(F.col(CORRUPT).alias("line"), F.when(_too_long(columns), "many").otherwise("few").alias("cells"))
        found = lines if found is None else found.unionByName(lines)
    return found


def _by_header(spark: SparkSession, path: str | Sequence[str], multi_line: bool) -> dict[tuple, list[str]]:
    headers: dict[tuple, list[str]] = {}
    for one in [path] if isinstance(path, str) else path:
        columns = spark.read.options(**CSV, multiLine=multi_line).csv(one).columns
        headers.setdefault(tuple(columns), []).append(one)
    return headers


def _scan(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], multi_line: bool = False, pruned: bool = False) -> DataFrame:
    """The cells of files of one header; Spark checks every file's header against it.

    Only a scan that parses all columns sees that a line has too few or too many cells.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, CORRUPT]])
    reader = spark.read.options(**CSV, multiLine=multi_line, enforceSchema=False, columnNameOfCorruptRecord=CORRUPT, columnPruning=pruned)
    return reader.schema(schema).csv(list(paths))


def _too_long(columns: Sequence[str]) -> Column:
    """Of a malformed line: whether it has more cells than the header. Commas in quotes part no cells."""
    bare = F.regexp_replace(CORRUPT, r'"(?:[^"]|"")*"', "")
    many = F.regexp_count(bare, F.lit(",")) >= len(columns)
    # Spark refuses to read the malformed lines alone, so a cell takes part
    return F.col(CORRUPT).isNotNull() & many & (F.length(F.concat_ws("", quoted(columns[0]))) >= 0)


def _checked(scan: DataFrame, columns: Sequence[str], malformed: str) -> DataFrame:
    if malformed == "keep":
        return scan
    if malformed == "drop":
        return scan.where(~_too_long(columns))
    if malformed != "fail":
        raise ValueError(f"malformed lines fail, are kept or dropped, not {malformed!r}")
    message = F.concat(F.lit(f"more than {len(columns)} cells: "), F.col(CORRUPT))
    return scan.where(F.when(_too_long(columns), F.raise_error(message)).otherwise(F.lit(True)))


def _raw_text(spark: SparkSession, path: str | Sequence[str], multi_line: bool, malformed: str) -> DataFrame:
    scans = [
        _checked(_scan(spark, group, columns, multi_line, malformed == "keep"), columns, malformed).select(*[quoted(c) for c in columns])
        for columns, group in _by_header(spark, path, multi_line).items()
    ]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def _present(text: Column) -> Column:
    return F.when(~text.isin(MISSING_TEXTS), text)


def numeric_columns(text: DataFrame, names: Sequence[str]) -> list[str]:
    """The columns whose every present text is a number, found in one pass."""
    return [n for n, kind in number_kinds(text, names).items() if kind != "text"]


def _odd(name: str, number: str | None = None) -> Column:
    """Whether a cell holds a text that is no number; ``number`` may bring what it was cast to.

    A text that casts, begins and ends with a digit and is not hexadecimal needs no pattern.
    """
    cell = quoted(name)
    fits = cell.rlike(NUMBER)
    if number is not None:
        digits = [cell.substr(at, 1).between("0", "9") for at in (1, -1)]
        plain = F.col(number).isNotNull() & digits[0] & digits[1] & ~cell.contains("x") & ~cell.contains("X")
        fits = F.when(plain, True).otherwise(fits)
    return cell.isNotNull() & ~fits


def _kinds_of(names: Sequence[str]) -> list[Column]:
    """Per column how many present texts are no numbers, how many no integers of 64 bits, how many are missing."""
    found = []
    for i, n in enumerate(names):
        cell = quoted(n)
        found += [
            F.count_if(_odd(n)).alias(f"odd{i}"),
            F.count_if(cell.isNotNull() & ~(cell.rlike(INTEGER) & F.trim(cell).try_cast("bigint").isNotNull())).alias(f"broken{i}"),
            F.count_if(cell.isNull()).alias(f"absent{i}"),
        ]
    return found


def _kind(row, i: int) -> str:
    if row[f"odd{i}"]:
        return "text"
    return "double" if row[f"broken{i}"] or row[f"absent{i}"] else "bigint"


def number_kinds(text: DataFrame, names: Sequence[str]) -> dict[str, str]:
    """Per column "bigint" (integers, none missing), "double" (numbers) or "text", found in one pass."""
    if not names:
        return {}
    row = text.agg(*_kinds_of(names)).first()
    return {n: _kind(row, i) for i, n in enumerate(names)}


def _number(text: Column) -> Column:
    return nan_to_null(F.trim(text).cast("double"))


def _time(text: Column, numeric: bool) -> Column:
    return epoch_to_timestamp(_number(text)) if numeric else F.to_timestamp(text)


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    ts_col: str | None = None,
    metrics: Sequence[str] | None = None,
    malformed: str = "fail",
) -> MetricFrame:
    """A metric CSV. Naming ``metrics`` saves the pass that finds numeric columns."""
    text = read_text(spark, path, malformed=malformed)
    ts = ts_col or text.columns[0]
    others = [c for c in text.columns if c != ts] if metrics is None else list(metrics)
    numeric = numeric_columns(text, [ts] + (others if metrics is None else []))
    chosen = [c for c in others if c in numeric] if metrics is None else others
    columns = [_time(quoted(ts), ts in numeric).alias(ts)] + [_number(quoted(c)).alias(c) for c in chosen]
    return MetricFrame(text.select(*columns), ts, tuple(chosen))


def read_table(spark: SparkSession, path: str | Sequence[str], malformed: str = "fail") -> DataFrame:
    """Any header CSV as a typed table: integers without gaps as such, other numbers as doubles, the rest as text."""
    text = read_text(spark, path, malformed=malformed)
    typed = {"bigint": lambda c: F.trim(quoted(c)).cast("bigint"), "double": lambda c: _number(quoted(c)), "text": quoted}
    kinds = number_kinds(text, text.columns)
    return text.select(*[typed[kinds[c]](c).alias(c) for c in text.columns])


@dataclass(frozen=True)
class SourceFrame:
    """Wide readings of many sources with one header; ``SOURCE`` names the source of a row.

    ``metrics`` are the columns that are numeric in some source; in the others they are NULL and
    ``by_source`` leaves them out.
    """

    df: DataFrame
    ts: str
    metrics: tuple[str, ...]
    by_source: dict[str, tuple[str, ...]]

    def long(self) -> DataFrame:
        """``source, ts, metric_name, value`` with missing readings kept, metrics of other sources left out."""
        rows = self.df.unpivot([F.col(SOURCE), quoted(self.ts).alias("ts")], [quoted(m) for m in self.metrics], METRIC, VALUE)
        partial = [m for m in self.metrics if any(m not in own for own in self.by_source.values())]
        for m in partial:
            rows = rows.where((F.col(METRIC) != m) | F.col(SOURCE).isin([s for s, own in self.by_source.items() if m in own]))
        return rows

    def only(self, source: str) -> MetricFrame:
        """One source as a frame of its own."""
        own = self.by_source[source]
        rows = self.df.where(F.col(SOURCE) == source)
        return MetricFrame(rows.select(quoted(self.ts), *[quoted(m) for m in own]), self.ts, own)


def _plain_path(path: Column) -> Column:
    """A file's path without scheme, host and escapes."""
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/")
    return F.regexp_replace(bare, r"/+$", "")


def _file_sources(files: DataFrame, paths: Mapping[str, str]) -> DataFrame:
    """``FILE, SOURCE``: the source of each file, named by its own path or by its folder."""
    decoded = F.url_decode(F.replace(FILE, F.lit("+"), F.lit("%2B")))
    files = files.withColumn("_plain", _plain_path(decoded))
    known = files.sparkSession.createDataFrame([(p, n) for n, p in paths.items()], f"path string, {SOURCE} string")
    known = known.select(_plain_path(F.col("path")).alias("path"), SOURCE)
    folder = F.regexp_replace("_plain", r"/[^/]*$", "")
    # a row per source, as the caller names them
    one, two = F.broadcast(known.withColumnRenamed(SOURCE, "_one")), F.broadcast(known.withColumnRenamed(SOURCE, "_two"))
    files = files.join(one, F.col("_plain") == one["path"], "left").drop("path").join(two, folder == two["path"], "left").drop("path")
    return files.select(FILE, F.coalesce("_one", "_two").alias(SOURCE))


def read_sources(
    spark: SparkSession, paths: Mapping[str, str], ts_col: str | None = None, metrics: Sequence[str] | None = None, malformed: str = "fail"
) -> SourceFrame:
    """Metric CSV files or folders of one header as one table: one scan, one pass for all types.

    The header is read from one file; Spark checks the others against it and fails on a difference.
    A column is a metric of the sources in which all its present texts are numbers. The text is parsed once:
    numbers, whether a text is none, and the time's text are stored in the shared folder, where later
    passes read them. Paths are looked up per file, not per row. The number of jobs does not depend on the
    number of files; a row per source reaches the driver.
    """
    names = list(paths)
    columns = spark.read.options(**CSV).csv(paths[names[0]]).columns
    scan = _checked(_scan(spark, list(paths.values()), columns, pruned=malformed == "keep"), columns, malformed)
    text = scan.select(*[_present(quoted(c)).alias(c) for c in columns], F.col("_metadata.file_path").alias(FILE))
    ts = ts_col or columns[0]
    others = [c for c in columns if c != ts] if metrics is None else list(metrics)
    tested = [ts, *(others if metrics is None else [])]
    cells = [quoted(c).alias(f"text{i}") for i, c in enumerate(others)]
    # numbers are tried, as a column may hold text in some sources
    numbers = [nan_to_null(F.trim(quoted(c)).try_cast("double")).alias(f"number{i}") for i, c in enumerate(others)]
    rows = text.select(FILE, quoted(ts).alias("time"), *cells, *numbers)
    odd = [_odd("time").alias("odd0"), *[_odd(f"text{i}", f"number{i}").alias(f"odd{i + 1}") for i in range(len(tested) - 1)]]
    parsed = stored(rows.select(FILE, "time", *[f"number{i}" for i in range(len(others))], *odd))
    parsed = attach(parsed, _file_sources(parsed.select(FILE).distinct(), paths), [FILE], "left")

    counts = [F.count_if(f"odd{i}").alias(f"odd{i}") for i in range(len(tested))]
    kinds = {row[SOURCE]: row for row in parsed.groupBy(SOURCE).agg(*counts).collect()}
    numeric = {c: [s for s, row in kinds.items() if not row[f"odd{i}"]] for i, c in enumerate(tested)}
    for c in others if metrics is not None else ():
        numeric[c] = list(kinds)

    def where_numeric(c: str, value: Column, other: Column) -> Column:
        if len(numeric[c]) == len(kinds):
            return value
        return F.when(F.col(SOURCE).isin(numeric[c]), value).otherwise(other)

    chosen = [c for c in others if numeric[c]]
    at = F.col("time")
    time = where_numeric(ts, _time(at, True), _time(at, False)) if numeric[ts] else _time(at, False)
    none = F.lit(None).cast("double")
    values = [where_numeric(c, F.col(f"number{i}"), none).alias(c) for i, c in enumerate(others) if numeric[c]]
    by_source = {s: tuple(c for c in chosen if s in numeric[c]) for s in names}
    return SourceFrame(parsed.select(F.col(SOURCE), time.alias(ts), *values), ts, tuple(chosen), by_source)


def union_sources(frames: Mapping[str, MetricFrame | DataFrame]) -> DataFrame:
    """Several sources as one long table with a ``source`` column."""
    parts = []
    for name, frame in frames.items():
        long = frame.long() if isinstance(frame, MetricFrame) else frame
        parts.append(long.withColumn(SOURCE, F.lit(name)))
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def shape(df: DataFrame) -> DataFrame:
    """Rows and columns of a table."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))
