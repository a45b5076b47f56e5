"""Tables, views and materialised views in a folder, and their changes: CREATE TABLE AS, REFRESH, TRUNCATE, COPY."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NULL = "\\N"


class Folder:
    """Tables as Parquet below a shared folder; a table's rows are written beside the old ones and swapped in by name."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.current: dict[str, str] = {}
        self.queries: dict[str, Callable[[], DataFrame]] = {}

    def create_table_as(self, name: str, rows: DataFrame) -> DataFrame:
        version = int(self.current[name].rsplit("=", 1)[1]) + 1 if name in self.current else 0
        path = f"{self.root}/{name}/version={version}"
        rows.write.mode("overwrite").parquet(path)
        self.current[name] = path
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.current[name])

    def truncate(self, name: str) -> DataFrame:
        return self.create_table_as(name, self.table(name).limit(0))

    def create_view(self, name: str, query: Callable[[], DataFrame]) -> None:
        """A view reads its tables anew at each use."""
        self.queries[name] = query

    def view(self, name: str) -> DataFrame:
        return self.queries[name]()

    def create_materialized_view(self, name: str, query: Callable[[], DataFrame]) -> DataFrame:
        """Rows as they are now; ``refresh`` computes them again."""
        self.queries[name] = query
        return self.create_table_as(name, query())

    def refresh(self, name: str) -> DataFrame:
        return self.create_table_as(name, self.queries[name]())

    def drop(self, name: str) -> None:
        self.current.pop(name, None)
        self.queries.pop(name, None)


# COPY: text (tab-separated, \\N for null, backslash escapes) and csv (quotes, empty for null) as lines


def text_line(columns: list[str]) -> F.Column:
    """A row in COPY's text form."""
    clean = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))
    return F.concat_ws("\t", *[F.coalesce(clean(c), F.lit(NULL)) for c in columns])


def from_text_line(line: F.Column, types: dict[str, str]) -> list[F.Column]:
    """The columns of a text line."""
    part = F.split(line, "\t", -1)
    back = lambda t: F.replace(F.replace(F.replace(F.replace(t, F.lit("\\\\"), F.lit("\0")), F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit("\0"), F.lit("\\"))
    return [F.when(F.get(part, i) != NULL, back(F.get(part, i))).cast(kind).alias(name) for i, (name, kind) in enumerate(types.items())]


def csv_line(columns: list[str]) -> F.Column:
    """A row in COPY's csv form: quoted where a comma, quote or line break needs it."""

    def cell(c: str):
        text = F.col(c).cast("string")
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(F.when(text.rlike('[",\n]') | (text == ""), quoted).otherwise(text), F.lit(""))

    return F.concat_ws(",", *[cell(c) for c in columns])


def copy_to(rows: DataFrame, path: str, form: str = "csv") -> None:
    """Files of lines (text, csv) or Parquet for binary; one a task."""
    if form == "binary":
        rows.write.mode("overwrite").parquet(path)
    else:
        line = csv_line(rows.columns) if form == "csv" else text_line(rows.columns)
        rows.select(line.alias("value")).write.mode("overwrite").text(path)


def copy_from(spark: SparkSession, path: str, schema: str, form: str = "csv") -> DataFrame:
    if form == "binary":
        return spark.read.parquet(path)
    if form == "csv":
        return spark.read.schema(schema).option("quote", '"').option("escape", '"').option("multiLine", "true").option("nullValue", "\0").csv(path)
    types = {x.split()[0]: x.split()[1] for x in schema.split(", ")}
    return spark.read.text(path).select(*from_text_line(F.col("value"), types))
