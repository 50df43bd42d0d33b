"""Flat files in: encodings, null tokens, headers, catalogues, sets of valid values."""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaspan.sources import files

#: Names of encodings in Python and in Java.
JAVA_NAMES = {"utf-8": "UTF-8", "cp949": "x-windows-949", "euc-kr": "EUC-KR"}
#: Texts that flat-file readers take for null.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
CATALOG_COLUMNS = ["execution_flag", "type", "source", "extension"]
MASTER_TYPES = ("Master", "Reference", "Rule")


def clean_headers(df: DataFrame) -> DataFrame:
    """Column names without byte-order marks and outer blanks."""
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


def null_tokens(df: DataFrame, tokens: list[str] = NULL_TOKENS) -> DataFrame:
    """Text columns with null tokens as nulls. For flat files only: in typed tables such a text is a value."""
    kinds = dict(df.dtypes)
    return df.select(*[F.when(~F.col(f"`{c}`").isin(tokens), F.col(f"`{c}`")).alias(c) if kinds[c] == "string" else F.col(f"`{c}`") for c in df.columns])


def encodings(path: str, suffix: str = "") -> dict[str, str]:
    """The first encoding that the head of each file is in. More of a file is looked at, and checked, when it is read."""
    source = files.FlatFiles({"path": path, "suffix": suffix})
    return {file.path: file.encodings[0] for file in source.files()}


def _flat_files(spark: SparkSession, path: str, suffix: str, separator: str, skip_bad: bool) -> DataFrame:
    spark.dataSource.register(files.FlatFiles)
    reader = spark.read.format("flat_files").option("suffix", suffix).option("separator", separator)
    return reader.option("nulls", "\n".join(NULL_TOKENS)).option("skip_bad", str(skip_bad).lower()).load(path)


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, separator: str = ",", infer: bool = False, skip_bad: bool = False, multiline: bool = False) -> DataFrame:
    """A flat file with a header: all text unless types are inferred, null tokens as nulls, clean header.

    Without an ``encoding`` (as Java names it) the file is read in byte ranges that are decoded in the encoding that fits, see files.FlatFiles; to infer types or for values that hold
    line ends (``multiline``: a file is then one task, however large) the encoding of the file's head is taken.
    """
    if encoding is None and not infer and not multiline:
        files.found(path, "")
        return _flat_files(spark, path, "", separator, skip_bad).drop("file_path", "file_name")
    if encoding is None:
        encoding = max((JAVA_NAMES[e] for e in encodings(path).values()), key=[*JAVA_NAMES.values()].index)
    if encoding != "UTF-8":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # without it only UTF and Latin-1 names are allowed
    reader = spark.read.option("header", True).option("sep", separator).option("encoding", encoding).option("inferSchema", infer)
    reader = reader.option("escape", '"').option("multiLine", multiline).option("mode", "DROPMALFORMED" if skip_bad else "PERMISSIVE")
    return null_tokens(clean_headers(reader.csv(path)))


def read_excel(path: str, spark: SparkSession, sheet: str | None = None) -> DataFrame:
    """A sheet of a workbook, or of each workbook of a folder: all text, null tokens as nulls, clean header, rows streamed by a task for each file."""
    spark.dataSource.register(files.Workbook)
    reader = spark.read.format("workbook").option("nulls", "\n".join(NULL_TOKENS))
    return (reader.option("sheet", sheet) if sheet else reader).load(path)


def read_directory(spark: SparkSession, path: str, suffix: str = ".csv", separator: str = ",", skip_bad: bool = False) -> DataFrame:
    """All files of a directory with the suffix, as one table with file_path and file_name: each in its encoding, null tokens as nulls, columns that a file lacks as nulls."""
    return _flat_files(spark, path, suffix, separator, skip_bad)


def read_existing(spark: SparkSession, paths: dict[str, str], infer: bool = True) -> tuple[dict[str, DataFrame], list[str]]:
    """The tables (Parquet, else flat files) of those paths that exist, by name, and the names of the others."""
    found, missing = {}, []
    for name, path in paths.items():
        try:
            found[name] = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_csv(spark, path, infer=infer)
        except FileNotFoundError:
            missing.append(name)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error.getCondition()):
                raise
            missing.append(name)
    return found, missing


def read_config(path: str) -> dict:
    """A YAML configuration or data contract: plain values only."""
    import yaml

    with open(path, encoding="utf-8") as file:
        return yaml.safe_load(file) or {}


def read_rules(spark: SparkSession, path: str) -> list[tuple[str, str, str | None]]:
    """Active definitions (name, rule1, rule2) of a rule table, in its order: flat file with Use_Flag, RuleName, rule1 and rule2."""
    rows = read_csv(spark, path).where((F.upper(F.trim("Use_Flag")) == "Y") & F.col("rule1").isNotNull()).select("RuleName", "rule1", "rule2")
    return [(r.RuleName.strip(), r.rule1, r.rule2) for r in rows.collect()]


def read_valid_sets(spark: SparkSession, path: str, folder: str = "") -> dict[str, list[str]]:
    """The sets of a valid-value table: flat file with valid_name, ListOrFile and valid_list; files are found in ``folder``."""
    rows = read_csv(spark, path).where("valid_name IS NOT NULL").select("valid_name", "ListOrFile", "valid_list").collect()
    where = lambda kind, text: f"{folder.rstrip('/')}/{text.strip()}" if folder and kind == "file" else text
    return valid_values([(r.valid_name.strip(), (r.ListOrFile or "List").strip().lower(), where((r.ListOrFile or "").strip().lower(), r.valid_list or "")) for r in rows], spark)


def list_files(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """file_path, file_name, file_size (bytes) without reading contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("file_path"), F.regexp_extract("path", r"([^/]+)\z", 1).alias("file_name"), F.col("length").alias("file_size"))


def read_catalog(df: DataFrame) -> DataFrame:
    """Active rows of a source catalogue of known types."""
    missing = [c for c in CATALOG_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"the catalogue lacks {', '.join(missing)}")
    return df.where((F.upper(F.trim("execution_flag")) == "Y") & F.trim("type").isin(*MASTER_TYPES))


def auto_numeric(df: DataFrame, named: str = r"(?i)(cnt|count|pct|%|rows|size|score)", least: float = 0.8) -> DataFrame:
    """Text columns as numbers if their name says so or enough of their non-empty values are numbers; all rows are asked, in one aggregation."""
    from metaspan.operators.stats import to_number

    text = [c for c, t in df.dtypes if t == "string"]
    if not text:
        return df
    shares = df.agg(*[F.avg(F.when(F.trim(F.col(f"`{c}`")) != "", to_number(F.col(f"`{c}`")).isNotNull().cast("double"))).alias(c) for c in text]).first()
    numeric = {c for c in text if re.search(named, c) or (shares[c] is not None and shares[c] >= least)}
    return df.select(*[to_number(F.col(f"`{c}`")).alias(c) if c in numeric else F.col(f"`{c}`") for c in df.columns])


def valid_values(definitions: list[tuple[str, str, str]], spark: SparkSession) -> dict[str, list[str]]:
    """Named sets of valid values from (name, 'List' or 'File', list text or path). They become literals of rules, so they are domain lists, not tables."""
    out: dict[str, list[str]] = {}
    for name, kind, what in definitions:
        if kind.strip().lower() == "file":
            column = read_csv(spark, what).columns[0]
            values = [r[0] for r in read_csv(spark, what).select(F.trim(F.col(f"`{column}`"))).distinct().collect() if r[0]]
        else:
            values = parse_list(what)
        out.setdefault(name, []).extend(v for v in values if v not in out.get(name, []))
    return out


def parse_list(text: str) -> list[str]:
    """A list text: JSON, the same with single quotes, or parts between commas, semicolons or bars."""
    text = (text or "").strip()
    for form in (text, text.replace("'", '"')):
        try:
            parsed = json.loads(form)
        except ValueError:
            continue
        if isinstance(parsed, dict):
            return [str(k) for k in parsed]
        return [str(v) for v in parsed] if isinstance(parsed, list) else [str(parsed)]
    return [p.strip(" '\"") for p in re.split(r"[,;|]", text.strip("[](){}")) if p.strip(" '\"")]


def normal_value(c: Column) -> Column:
    """A reference value: trimmed, inner blanks single."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def file_statistics(df: DataFrame, file_path: str, file_name: str, master_type: str, size_mb: float | None = None) -> DataFrame:
    """One row of file statistics; nothing is sampled."""
    return df.agg(F.count("*").alias("record_cnt")).select(
        F.lit(file_path).alias("file_path"), F.lit(file_name).alias("file_name"), F.lit(master_type).alias("master_type"), "record_cnt", F.lit(len(df.columns)).alias("column_cnt"),
        F.col("record_cnt").alias("sampling_rows"), F.lit(100.0).alias("sampling_pct"), F.lit(size_mb).cast("double").alias("file_size"), F.current_date().alias("work_date"),
    )


def sample_rows(df: DataFrame, n: int, hashed: Column | None = None) -> DataFrame:
    """The n rows of least hash (of all columns, unless another is given): the same rows in any run and partitioning."""
    hashed = F.xxhash64(*df.columns) if hashed is None else hashed
    return df.withColumn("_h", hashed).orderBy("_h", *[c for c, t in df.dtypes if not t.startswith("map")]).limit(n).drop("_h")
