"""Table scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import quoted
from .records import csv_records, header_names

# The text tokens read as missing in a CSV cell.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing means null everywhere in this library, so NaN goes once, here."""
    changed = {
        f.name: F.when(~F.isnan(quoted(f.name)), quoted(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(changed) if changed else df


def check_flat(df: DataFrame) -> DataFrame:
    """Table columns are flat scalars; nested ones are refused by name."""
    nested = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
    ]
    if nested:
        raise ValueError(f"nested or binary columns are not supported: {', '.join(nested)}")
    return df


def read_parquet(spark: SparkSession, path: str, nan_free: bool = False) -> DataFrame:
    """Parquet scan.  ``nan_free=True`` leaves floats untouched so that range
    filters on them still reach the Parquet row groups."""
    df = spark.read.parquet(path)
    return df if nan_free else nan_to_null(df)


CSV_OPTIONS = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "nullValue": ""}


def _csv_text(spark: SparkSession, path: str, schema: T.StructType | None, multiline: bool | None) -> DataFrame:
    """All cells as text, under the names of the schema or the header."""
    records = csv_records(spark, path) if multiline is None else None
    if records is None:
        raw = spark.read.options(**CSV_OPTIONS).option("header", True).option("multiLine", bool(multiline))
        if schema is None:
            return raw.csv(path)
        return raw.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])).csv(path)
    names = header_names(records) if schema is None else schema.fieldNames()
    cells = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = F.from_csv("value", F.lit(cells), {**CSV_OPTIONS, "multiLine": "true"}).alias("r")
    return records.where("NOT header").select(parsed).select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(names)])


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multiline: bool | None = None, strict: bool = False
) -> DataFrame:
    """CSV scan: header row, quoted commas and line ends, doubled quotes, missing tokens as null.

    Line ends inside quotes are found by a first pass over the byte ranges of the files (``records``), after which many tasks read
    one file together.  ``multiline`` leaves that pass out: ``False`` for files known to have a record a line,
    ``True`` to read each file whole in one task.  With
    a schema the types are given; a cell that breaks it is null, or with ``strict`` an error.  Without one the types come from
    the data: all cells are read as text, missing tokens are blanked, and one
    aggregate decides per column which of long, double, boolean every cell
    can be cast to (text otherwise).
    """
    text = _csv_text(spark, path, schema, multiline)
    cells = {c: F.when(~F.trim(quoted(c)).isin(MISSING_TOKENS), quoted(c)) for c in text.columns}
    text = text.select(*[v.alias(c) for c, v in cells.items()])
    if schema is not None:
        typed = {f.name: f.dataType.simpleString() for f in schema.fields}
    else:
        typed = _infer(text)
    out = text.select(
        *[
            (quoted(c) if t == "string" else quoted(c).cast(t) if strict else quoted(c).try_cast(t)).alias(c)
            for c, t in typed.items()
        ]
    )
    return nan_to_null(out)


def _infer(text: DataFrame) -> dict[str, str]:
    """Narrowest of bigint, double, boolean that fits every non-null cell."""
    checks = []
    for i, c in enumerate(text.columns):
        cell = F.trim(quoted(c))
        checks.append(F.count(cell).alias(f"n{i}"))
        whole = cell.rlike(r"^[+-]?\d{1,19}$") & cell.try_cast("bigint").isNotNull()
        checks.append(F.count_if(cell.isNotNull() & ~whole).alias(f"long{i}"))
        number = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity)$"
        checks.append(F.count_if(cell.isNotNull() & ~cell.rlike(number)).alias(f"double{i}"))
        checks.append(F.count_if(cell.isNotNull() & ~F.lower(cell).isin("true", "false")).alias(f"boolean{i}"))
    row = text.agg(*checks).first()
    typed = {}
    for i, c in enumerate(text.columns):
        if row[f"n{i}"] == 0:
            typed[c] = "double"
        elif row[f"long{i}"] == 0:
            typed[c] = "bigint"
        elif row[f"double{i}"] == 0:
            typed[c] = "double"
        elif row[f"boolean{i}"] == 0:
            typed[c] = "boolean"
        else:
            typed[c] = "string"
    return typed


def read_table(
    spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | None = None, multiline: bool | None = None
) -> DataFrame:
    if format == "csv":
        return check_flat(read_csv(spark, path, schema, multiline))
    if format == "parquet":
        return check_flat(read_parquet(spark, path))
    raise ValueError(f"unsupported format {format!r}; convert to CSV or Parquet first")


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    """Write without an index column; every writer task writes its own part file."""
    if format == "csv":
        df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    elif format == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unsupported format {format!r}")


class Tables:
    """The tables of one folder, ``t.orders`` reading ``<folder>/orders.parquet``.

    The files are known to hold no NaN, so scans keep their filter pushdown.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_parquet(self.spark, f"{self.folder}/{name}.parquet", nan_free=True)
