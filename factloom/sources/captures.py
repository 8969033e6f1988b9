"""Sources: trees of captured documents, reference imports, line-up tables, service replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import parse_number, parse_price
from ..functions.text import url_key
from ..operators.tables import latest

META = "source_id string, version_id string, url_final string, http_status int, tier int, kind string, status string, captured_at string, text_path string, sha256 string, bytes long, note string"


def captures(spark: SparkSession, path: str, name: str = "meta.json", multi_line: bool = True) -> DataFrame:
    """Every meta.json under path as a row, with url_key, capture time and folder; files that are not JSON objects
    come out as rows of nulls with their text in _corrupt. name: a pattern of the files' names; without multi_line a
    file holds a capture in each line."""
    raw = spark.read.schema(META + ", _corrupt string").option("recursiveFileLookup", True).option("pathGlobFilter", name).option("multiLine", multi_line).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    return raw.select("*", folder.alias("folder")).withColumn("url_key", url_key(F.col("url_final"))).withColumn("captured", F.try_to_timestamp("captured_at"))


def best_captures(found: DataFrame) -> DataFrame:
    """One capture for each url: the newest, then the better tier, then the longer text."""
    return latest(found.where("url_key is not null"), ["url_key"], [F.desc_nulls_last("captured"), F.asc_nulls_last("tier"), F.desc_nulls_last("bytes"), F.col("source_id")])


def captures_of(found: DataFrame, version: str) -> DataFrame:
    return found.where(F.col("version_id") == version).orderBy(F.asc_nulls_last("tier"), F.desc("captured"), "source_id")


def source_texts(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """(folder, text): whole text files, for grounding."""
    t = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return t.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder"), F.col("value").alias("text"))


def registry(spark: SparkSession, path: str, fields: str = "source_id string, url string, tier int, kind string, status string") -> DataFrame:
    """Consulted sources of {'sources': [...]} files, blocked ones too."""
    return spark.read.schema(f"sources array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in fields.split(','))}>>").option("multiLine", True).json(path).select(F.inline("sources"))


def import_table(spark: SparkSession, path: str, required: list[str], form: str = "csv", sep: str = ";", encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of a CSV file with a header or of JSON lines; bad ones tell why. A byte order mark is
    dropped. Missing columns are an error; a row lacks a required value or cannot be parsed: bad."""
    if form == "csv":
        head = spark.read.option("sep", sep).option("encoding", encoding).option("header", True).csv(path)
        names = [c.lstrip("﻿").strip() for c in head.columns]
        df = head.toDF(*names).withColumn("_corrupt", F.lit(None).cast("string"))
    else:
        df = spark.read.option("encoding", encoding).option("columnNameOfCorruptRecord", "_corrupt").json(path)
        if "_corrupt" not in df.columns:
            df = df.withColumn("_corrupt", F.lit(None).cast("string"))
    if lacking := [c for c in required if c not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(lacking)}")
    empty = F.concat_ws(",", *[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", c) for c in required])
    df = df.withColumn("reason", F.when(F.col("_corrupt").isNotNull(), F.lit("cannot be parsed")).when(empty != "", F.concat(F.lit("empty: "), empty)))
    return df.where("reason is null").drop("reason", "_corrupt"), df.where("reason is not null")


def lineup(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(name, year, price, url, header): rows of pipe tables name | year | price | url, with the lines before the
    table as their provenance."""
    header = F.regexp_replace(F.regexp_extract(F.col(text_col), r"(?s)^(.*?)\n\|", 1), r"^\s+|\s+$", "")
    # The header is cut out before the lines part, else every line would carry its whole text to it.
    rows = texts.select(header.alias("header"), F.split(text_col, "\n").alias("lines")).select("header", F.explode("lines").alias("line")).where(F.col("line").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|\s*$", ""), r"\|"), lambda x: F.trim(x))
    rows = rows.withColumn("c", cells)
    year = F.get("c", F.lit(1)).try_cast("int")
    return rows.where(year.isNotNull()).select(F.get("c", F.lit(0)).alias("name"), year.alias("year"), parse_price(F.get("c", F.lit(2))).alias("price"), F.get("c", F.lit(3)).alias("url"), "header")


def consumption_sentences(text: Column) -> Column:
    """array<struct<urban, highway>> of sentences 'X km/l ... Y km/l'."""
    pattern = F.lit(r"([0-9]+[.,]?[0-9]*) ?km/l[^.;]{0,60}?([0-9]+[.,]?[0-9]*) ?km/l")
    pair = lambda i: F.regexp_extract_all(text, pattern, F.lit(i))
    return F.zip_with(pair(1), pair(2), lambda a, b: F.struct(parse_number(a).alias("urban"), parse_number(b).alias("highway")))


def price_reply(body: Column) -> Column:
    """struct(code, price, month, quote) of a price service's JSON reply; the quote is the pair as written."""
    v = F.try_parse_json(body)
    field = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    return F.struct(field("code").alias("code"), parse_price(field("price")).alias("price"), field("month").alias("month"), F.nullif(F.regexp_extract(body, r'"price"\s*:\s*("[^"]*"|[0-9.]+)', 0), F.lit("")).alias("quote"))


def western(content: Column) -> Column:
    """Windows-1252 bytes as text; every byte is a character there."""
    upper = bytes(range(128, 160))
    return F.translate(F.decode(content, "iso-8859-1"), upper.decode("latin-1"), "".join(bytes([b]).decode("cp1252", "replace") for b in upper))


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 where it is valid, else Windows-1252; a leading byte order mark is dropped."""
    return F.regexp_replace(F.coalesce(F.try_validate_utf8(content.cast("string")), western(content)), "^\ufeff", "")


def decoded_html(content: Column) -> Column:
    """Text of a page's bytes: UTF-16 behind its byte order mark, Windows-1252 where the first 1024 bytes declare it or
    Latin-1, which browsers read alike, else as decoded()."""
    head = F.decode(F.substring(content, 1, 1024), "iso-8859-1")
    declared = F.lower(F.regexp_extract(head, r"(?i)<meta[^>]*charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", 1))
    mark = F.hex(F.substring(content, 1, 2))
    return F.when(mark.isin("FFFE", "FEFF"), F.regexp_replace(F.decode(content, "utf-16"), "^\ufeff", "")).when(declared.isin("iso-8859-1", "latin1", "windows-1252", "cp1252"), western(content)).otherwise(decoded(content))
