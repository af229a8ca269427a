"""Reading raw files into typed tables and conforming them to one schema."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_staged(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = None,
    schema: T.StructType | str | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Scan a path or glob with an explicit schema and only the wanted columns."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path if isinstance(path, str) else list(path))
    return df.select(*columns) if columns else df


def csv_headers(spark: SparkSession, paths: Sequence[str], options: Mapping[str, str]) -> dict[tuple[str, ...], list[str]]:
    """Files below ``paths`` by their header.

    Executors read the first line of each file; one line a file reaches the driver, metadata as a file
    listing is.  Files without a line have no header and are left out.
    """
    lines = spark.read.text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    first = lines.where("block = 0").groupBy("path").agg(F.min_by("value", "at").alias("header"))
    found: dict[tuple[str, ...], list[str]] = {}
    for r in first.orderBy("path").collect():
        names = next(csv.reader([r["header"].lstrip("\ufeff")], delimiter=options.get("sep", options.get("delimiter", ",")), quotechar=options.get("quote", '"')))
        found.setdefault(tuple(names), []).append(unquote(r["path"]))
    return found


def stage_csv(
    spark: SparkSession,
    paths: Sequence[str],
    schema: T.StructType | str,
    ts_columns: Mapping[str, str] | None = None,
    key_options: Mapping[str, str] | None = None,
) -> DataFrame:
    """CSV pages to typed rows; columns follow each file's own header by name, a bad timestamp becomes NULL.

    ``schema`` gives the target types.  Every field is read as text first, so one bad cell costs
    that cell and not the row; pages with fewer columns get NULLs for the rest.  Files are read
    together by header, one scan for each distinct header.
    """
    target = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    ts_columns, options = dict(ts_columns or {}), dict(key_options or {})
    pages = []
    for header, files in csv_headers(spark, paths, options).items():
        as_text = T.StructType([T.StructField(c, T.StringType()) for c in header])
        pages.append(spark.read.options(header=True, enforceSchema=False, **options).schema(as_text).csv(files))
    if not pages:
        return spark.createDataFrame([], target)
    raw = union_sources(pages)
    out = []
    for field in target.fields:
        if field.name not in raw.columns:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif field.name in ts_columns:
            parsed = F.try_to_timestamp(F.col(f"`{field.name}`"), F.lit(ts_columns[field.name]))
            out.append(parsed.cast(field.dataType).alias(field.name))
        else:
            out.append(F.col(f"`{field.name}`").try_cast(field.dataType).alias(field.name))
    return raw.select(*out)


def _json_lines(spark: SparkSession, paths: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The listed fields of each line as text (nested values as JSON text), and ``_corrupt`` for lines that are no JSON."""
    kind = T.StructType([*[T.StructField(c, T.StringType()) for c in fields], T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(list(paths)).where(F.trim("value") != "")
    return lines.select(F.from_json("value", kind, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")


def _from_text(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.from_json(text, kind)
    if isinstance(kind, T.IntegralType):
        # 1672608506.0 is the whole number 1672608506; 4.5 is none.
        real = text.try_cast("double")
        return F.coalesce(text.try_cast(kind), F.when(real == F.floor(real), real.try_cast(kind)))
    return text.try_cast(kind)


def stage_jsonl(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str) -> DataFrame:
    """Newline-delimited JSON, only the fields of ``schema``.

    Fields are read as text and converted one by one: a value of another type (``false`` in a column of
    numbers) becomes NULL and the row stays.  Lines that are no JSON are left out; ``broken_json_lines``
    counts them.
    """
    target = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    rows = _json_lines(spark, paths, target.fieldNames()).where(F.col("_corrupt").isNull())
    return rows.select(*[_from_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in target.fields])


def broken_json_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row: lines that hold text, and how many of them are no JSON."""
    return _json_lines(spark, paths, []).agg(F.count(F.lit(1)).alias("line_count"), F.count("_corrupt").alias("broken_count"))


def source_name(column: Column | None = None) -> Column:
    """File name without folder and extension."""
    name = F.col("_metadata.file_name") if column is None else column
    return F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")


def derive_from_filename(df: DataFrame, parts: Mapping[str, str]) -> DataFrame:
    """Columns cut out of the file name, as {column: regex with one group}."""
    name = F.col("_metadata.file_name")
    return df.select("*", *[F.nullif(F.regexp_extract(name, rx, 1), F.lit("")).alias(c) for c, rx in parts.items()])


def conform_to_schema(
    df: DataFrame, target: T.StructType | str, fills: Mapping[str, Column] | None = None
) -> DataFrame:
    """Columns of ``target`` in its order: missing ones NULL, others cast leniently, NULLs filled."""
    target = T._parse_datatype_string(target) if isinstance(target, str) else target
    have = {f.name: f.dataType for f in df.schema.fields}
    fills = fills or {}
    out = []
    for f in target.fields:
        if f.name not in have:
            c = F.lit(None).cast(f.dataType)
        elif have[f.name] == f.dataType:
            c = F.col(f.name)
        elif isinstance(have[f.name], (T.StructType, T.ArrayType, T.MapType)):
            c = F.to_json(f.name) if isinstance(f.dataType, T.StringType) else F.lit(None).cast(f.dataType)
        else:
            c = F.col(f.name).try_cast(f.dataType)
        if f.name in fills:
            c = F.coalesce(c, fills[f.name].cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def union_sources(dfs: Sequence[DataFrame]) -> DataFrame:
    """Append tables by column name; a column one source lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def comma_number(text: Column) -> Column:
    """'1,234.5' to a double, NULL when it is no number."""
    return F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double")


def false_to_null(text: Column) -> Column:
    """A field holding either ``false`` or a number: the number, or NULL."""
    return F.when(F.lower(F.trim(text)) == "false", F.lit(None)).otherwise(text).try_cast("bigint")


def normalize_mixed(
    df: DataFrame, numbers: Sequence[str] = (), false_or_number: Sequence[str] = (), nested: Sequence[str] = ()
) -> DataFrame:
    """Give columns of mixed content one type each; nested values become JSON text."""
    cols = {c: comma_number(F.col(c)) for c in numbers}
    cols |= {c: false_to_null(F.col(c)) for c in false_or_number}
    cols |= {c: F.to_json(c) for c in nested}
    return df.withColumns(cols)
