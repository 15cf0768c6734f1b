"""Loose tables, page texts and files read as typed DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.functions.cells import TYPES, infer_types, normalized, safe_names, stripped, table_name
from gridlore.functions.filters import column
from gridlore.functions.texts import page_text
from gridlore.operators.profile import profile
from gridlore.operators.tables import row_numbers
from gridlore.operators.timeseries import forecast_artifacts, sheet_forecasts, sheet_record

EXTENSIONS = {"csv": "table", "json": "table", "parquet": "table", "pdf": "pdf", "xlsx": "xlsx", "xls": "xls", "txt": "text", "html": "page"}
MIME = {"csv": "text/csv", "json": "application/json", "parquet": "application/vnd.apache.parquet", "pdf": "application/pdf", "txt": "text/plain", "html": "text/html"}
MAX_FILE_BYTES = 25 * 1024 * 1024


def read_raw(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A file's cells as text, types still open."""
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=False)
    if kind == "json":
        return spark.read.option("primitivesAsString", True).json(path)
    return spark.read.parquet(path)


def drop_blank_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Without rows of which every cell is null or white space."""
    seen = [stripped(column(df, c).cast("string")).isNotNull() for c in (columns or df.columns)]
    keep = seen[0]
    for s in seen[1:]:
        keep = keep | s
    return df.where(keep)


def typed(raw: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Every cell by its column's inferred (or given) logical type; names stay, physical names and types go to the fields' metadata."""
    types = types or infer_types(raw)
    names = safe_names(list(types))
    return raw.select(*[
        normalized(column(raw, c), kind).cast(TYPES[kind]).alias(c, metadata={"logical_type": kind, "safe_name": names[c], "original_name": c}) for c, kind in types.items()
    ])


def ingest(raw: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """A raw table without blank rows, typed, with rows numbered in file order in _source_row_number."""
    return row_numbers(typed(drop_blank_rows(raw), types))


def registry_rows(spark: SparkSession, document_id: str, sheet: str, types: dict[str, str]) -> DataFrame:
    """The registry's rows of a table: one a column, in order."""
    names = safe_names(list(types))
    stored = {"string": "TEXT", "integer": "INTEGER", "float": "REAL", "date": "INTEGER", "boolean": "INTEGER"}
    rows = [(document_id, sheet, i, c, names[c], kind, stored[kind], True) for i, (c, kind) in enumerate(types.items())]
    return spark.createDataFrame(rows, "document_id string, sheet_name string, ordinal int, original_name string, safe_name string, logical_type string, stored_type string, nullable boolean")


def sheet_profile(df: DataFrame, document_id: str, sheet: str) -> DataFrame:
    """A typed table's profile as rows of the store of profiles: one a column, keyed by document and sheet."""
    return profile(df).select(F.lit(document_id).alias("document_id"), F.lit(sheet).alias("sheet_name"), "*")


def sheet_series(df: DataFrame, document_id: str, sheet: str) -> DataFrame:
    """A typed table's time-series record, one row keyed by document and sheet."""
    return sheet_record(df).select(F.lit(document_id).alias("document_id"), F.lit(sheet).alias("sheet_name"), "*")


class Parts(Mapping):
    """Tables by name, each made when it is first asked for: a profile takes jobs of its own, which who asks for columns need not wait for."""

    def __init__(self, **makers: Callable[[], DataFrame]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def register_sheet(raw: DataFrame, store: str, document_id: str, sheet: str, tie: Sequence[str] = ()) -> Mapping[str, DataFrame]:
    """Ingest a raw table whole: its typed rows are written to store and read again, and what the registry keeps of it is returned.

    tables: document_id, sheet_name, table_name, row_count; columns: one row a column; profiles, series: see sheet_profile and sheet_series;
    forecasts: artifacts of the measures that can be forecast, none where the series is not eligible. The caller upserts each by document and
    sheet; the sheet that sorts first is a document's default one.
    """
    spark, types = raw.sparkSession, infer_types(raw)
    write_table(ingest(raw, types), store, document_id, sheet)
    rows = spark.read.parquet(store).where((F.col("document_id") == document_id) & (F.col("sheet_name") == sheet)).drop("document_id", "sheet_name")
    seen = rows.drop("_source_row_number")
    series = sheet_series(seen, document_id, sheet)
    record = series.first()
    names = [m["name"] for m in record["measures"] if m["eligible"]] if record["eligible"] else []
    time = record["time_column"] or seen.columns[0]
    key = table_name(F.lit(document_id), F.lit(sheet)).alias("table_name")
    return Parts(
        tables=lambda: rows.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(document_id).alias("document_id"), F.lit(sheet).alias("sheet_name"), key, "row_count"),
        columns=lambda: registry_rows(spark, document_id, sheet, types), profiles=lambda: sheet_profile(seen, document_id, sheet), series=lambda: series,
        forecasts=lambda: forecast_artifacts(sheet_forecasts(rows.where(F.lit(bool(names))), time, names or [seen.columns[0]], tie or ["_source_row_number"]), document_id, sheet, time),
    )


def write_table(df: DataFrame, path: str, document_id: str, sheet: str) -> None:
    """Replace one sheet's partition of a store of typed tables."""
    keyed = df.withColumns({"document_id": F.lit(document_id), "sheet_name": F.lit(sheet)})
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id", "sheet_name").parquet(path)


def page_texts(pages: DataFrame) -> DataFrame:
    """document_id, page (from 1), content with white space collapsed; empty pages are dropped."""
    return pages.select("document_id", "page", page_text(F.col("content")).alias("content")).where("content is not null")


def file_catalog(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Files under path, without reading them: path, name (safe), type, mime, length, allowed, modified."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    of = lambda table: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), ext)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"[^A-Za-z0-9._-]+", "_")
    return files.select("path", name.alias("name"), of(EXTENSIONS).alias("type"), of(MIME).alias("mime"), "length", (F.col("length") <= max_bytes).alias("allowed"), F.col("modificationTime").alias("modified"))
