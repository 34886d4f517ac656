"""CSV and JSON ingestion with header and field resolution."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names that a field goes by, the first that a table has counts.
ALIASES = {
    "email": ("email", "e-mail", "email_address", "mail"),
    "website": ("website", "url", "site", "domain", "company_url", "web"),
    "name": ("name", "company_name", "company", "business_name", "title"),
    "phone": ("phone", "phone_number", "telephone", "tel"),
    "city": ("city", "town"),
}

PLACE = T.StructType(
    [
        T.StructField("place_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("phone", T.StringType()),
        T.StructField("website", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("user_ratings_total", T.LongType()),
        T.StructField("business_status", T.StringType()),
    ]
)
PLACES_DOCUMENT = T.StructType(
    [
        T.StructField("metadata", T.StructType([T.StructField("state", T.StringType()), T.StructField("niche", T.StringType()), T.StructField("timestamp", T.StringType())])),
        T.StructField(
            "results_by_city",
            T.ArrayType(T.StructType([T.StructField("city", T.StringType()), T.StructField("filtered_places", T.ArrayType(PLACE)), T.StructField("places", T.ArrayType(PLACE))])),
        ),
    ]
)


def normalised_header(names: Sequence[str]) -> list[str]:
    """Lower case, trimmed, spaces as underscores, without a byte order mark; a repeated name gets its number."""
    out: list[str] = []
    for name in names:
        bare = re.sub(r"\s+", "_", name.replace("﻿", "").strip().lower())
        out.append(bare if bare not in out else f"{bare}_{out.count(bare) + len(out)}")
    return out


#: Encodings that a file is tried under, in order; the last reads any bytes.
ENCODINGS = ("UTF-8", "windows-1251", "ISO-8859-1")
#: Letters beyond ASCII in one-byte encodings.
_HIGH = "\u00c0-\u00ff"


def allow(spark: SparkSession, encodings: Sequence[str]) -> None:
    """Let the session decode encodings beyond those of the standard, and bytes that they lack."""
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")
    if any(not e.upper().startswith(("UTF-", "ISO-8859-1", "US-ASCII")) for e in encodings):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def encodings_of(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """(file, encoding, valid_utf8, n_high, n_paired): how each file of ``path`` is to be read, and what that is judged by.

    Each file is judged alone, by the lines of its first block. UTF-8 is taken if it is among ``encodings`` and no line breaks its
    rules. Nearly any bytes are valid in one-byte encodings, so that between windows-1251 and a Latin one the letters
    beyond ASCII decide: in Cyrillic words they stand side by side (``n_paired`` of ``n_high``, a half or more), in Latin
    ones mostly alone. Else the first of ``encodings`` that is left.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).filter("start = 0")
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    alone = f"(?<![{_HIGH}])[{_HIGH}](?![{_HIGH}])"
    seen = lines.select("file", F.is_valid_utf8("value").alias("valid"), F.length(F.regexp_replace(latin, f"[^{_HIGH}]", "")).alias("high"), F.length(F.regexp_replace(latin, f"{alone}|[^{_HIGH}]", "")).alias("paired"))
    seen = seen.groupBy("file").agg(F.min("valid").alias("valid_utf8"), F.sum("high").alias("n_high"), F.sum("paired").alias("n_paired"))
    rest = [e for e in encodings if e.upper() != "UTF-8"] or ["UTF-8"]
    cyrillic = [e for e in rest if e.lower() in ("windows-1251", "cp1251")]
    latins = [e for e in rest if e not in cyrillic]
    choice = F.lit(rest[0])
    if cyrillic and latins:
        choice = F.when(F.col("n_paired") * 2 >= F.greatest("n_high", F.lit(1)), cyrillic[0]).otherwise(latins[0])
    if any(e.upper() == "UTF-8" for e in encodings):
        choice = F.when(F.col("valid_utf8"), "UTF-8").otherwise(choice)
    return seen.select("file", choice.alias("encoding"), "valid_utf8", "n_high", "n_paired")


def encoding_of(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> str:
    """The encoding of all files of ``path``; they must have one."""
    found = sorted(r.encoding for r in encodings_of(spark, path, encodings).select("encoding").distinct().collect())
    if len(found) != 1:
        raise ValueError(f"{path} has files of several encodings: {found}")
    return found[0]


def read_csv(
    spark: SparkSession, path: str, encoding: str | None = "UTF-8", columns: Sequence[str] | None = None, multi_line: bool = True, encodings: Sequence[str] = ENCODINGS, errors: str = "replace"
) -> DataFrame:
    """A CSV with a header, all columns text; of ``columns`` those that it has, with a warning for the others.

    Without an ``encoding`` each file of ``path`` is read by its own, of ``encodings``: rows are split as bytes and decoded
    in the JVM afterwards, so that files of several encodings are one table. Bytes that an encoding lacks become U+FFFD, or
    go with ``errors="ignore"``.
    """
    if errors not in ("replace", "ignore"):
        raise ValueError("errors is replace or ignore")
    rows = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if encoding:
        allow(spark, [encoding])
        df = rows.option("encoding", encoding).csv(path)
        df = df.toDF(*normalised_header(df.columns))
        decoded = lambda c: F.col(f"`{c}`")
    else:
        allow(spark, encodings)
        judged = encodings_of(spark, path, encodings)
        found = sorted({r.encoding for r in judged.select("encoding").distinct().collect()})
        df = rows.option("encoding", "ISO-8859-1").csv(path)
        first = next(e for e in [*found, "ISO-8859-1"] if _reads(df.columns, e))
        names = normalised_header([n.encode("latin-1").decode(first, "replace") for n in df.columns])
        bytes_of = df.select(*(F.encode(F.col(f"`{c}`"), "ISO-8859-1").alias(n) for c, n in zip(df.columns, names, strict=True)), F.col("_metadata.file_path").alias("__file"))
        df = bytes_of.join(judged.select(F.col("file").alias("__file"), F.col("encoding").alias("__encoding")), "__file")

        def decoded(c: str):
            as_ = lambda e: F.make_valid_utf8(F.col(f"`{c}`").cast("string")) if e == "UTF-8" else F.decode(F.col(f"`{c}`"), e)
            out = as_(found[-1])
            for e in found[:-1]:
                out = F.when(F.col("__encoding") == e, as_(e)).otherwise(out)
            return out

    clean = lambda c: (F.replace(decoded(c), F.lit("\ufffd"), F.lit("")) if errors == "ignore" else decoded(c)).alias(c)
    names = [c for c in df.columns if not c.startswith("__")]
    if missing := [c for c in columns or () if c not in names]:
        warnings.warn(f"{path} has no columns {missing}", stacklevel=2)
    return df.select(*(clean(c) for c in (names if columns is None else [c for c in columns if c in names])))


def _reads(names: Sequence[str], encoding: str) -> bool:
    try:
        return bool([n.encode("latin-1").decode(encoding) for n in names])
    except UnicodeDecodeError:
        return False


def read_headerless(spark: SparkSession, path: str, rows: int = 10, least: int = 6) -> DataFrame:
    """(email, result) of a CSV without a header: the first column with an at sign in ``least`` of its first ``rows`` rows, and the next one."""
    df = spark.read.option("header", False).csv(path)
    first = df.limit(rows).agg(*(F.count_if(F.col(c).contains("@")).alias(c) for c in df.columns)).head()
    found = [k for k, c in enumerate(df.columns) if first[c] >= least]
    if not found or found[0] + 1 == len(df.columns):
        raise ValueError(f"no column of {path} holds addresses before another one")
    return df.select(F.col(df.columns[found[0]]).alias("email"), F.col(df.columns[found[0] + 1]).alias("result"))


def files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, modified) of the files that a pattern names; their content is not read."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("modificationTime").alias("modified"))


def latest(spark: SparkSession, pattern: str) -> str | None:
    """The last file by name."""
    return files(spark, pattern).agg(F.max("path")).head()[0]


def latest_of_each(spark: SparkSession, pattern: str, key: str) -> DataFrame:
    """(key, path): the last file by name of each group 1 of the expression ``key`` in the file's name."""
    name = F.regexp_extract(F.substring_index("path", "/", -1), key, 1)
    return files(spark, pattern).select(name.alias("key"), "path").filter("key <> ''").groupBy("key").agg(F.max("path").alias("path"))


def resolve(columns: Sequence[str], aliases: dict[str, Sequence[str]] = ALIASES) -> dict[str, str]:
    """Field to column: names are compared without case, the first alias that the table has counts."""
    by_name = {c.lower(): c for c in columns}
    return {field: next(by_name[a] for a in names if a in by_name) for field, names in aliases.items() if any(a in by_name for a in names)}


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Many names to one: the first column with a value gives it; other columns stay as they are."""
    target: dict[str, list[str]] = {}
    for c in df.columns:
        target.setdefault(names.get(c, c), []).append(c)
    return df.select(*(F.coalesce(*cs).alias(name) for name, cs in target.items()))


def flatten_places(documents: DataFrame) -> DataFrame:
    """A row for each place of each city of nested documents; ``places`` stand in where none is filtered."""
    city = documents.select("metadata", F.explode("results_by_city").alias("c"))
    chosen = F.when(F.size("c.filtered_places") > 0, F.col("c.filtered_places")).otherwise(F.col("c.places"))
    rows = city.select("metadata", F.col("c.city").alias("city"), F.explode(chosen).alias("p"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return rows.select(
        "p.place_id", "p.name", "metadata.state", "city", "metadata.niche", "p.address", "p.phone", "p.website", "p.rating",
        F.col("p.user_ratings_total").alias("reviews"), "p.business_status", F.col("metadata.timestamp").alias("scraped_at"),
        blank("p.phone").alias("has_phone"), blank("p.website").alias("has_website"), (blank("p.phone") | blank("p.website")).alias("has_contact"),
    )


def read_places(spark: SparkSession, path: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Places of JSON files, without files whose path has one of ``exclude``.

    A state that a document lacks is the name of its folder, a niche the start of the file's name before a date.
    """
    documents = spark.read.schema(PLACES_DOCUMENT).option("multiLine", True).json(path).select("*", F.col("_metadata.file_path").alias("file"))
    for part in exclude:
        documents = documents.filter(~F.contains("file", F.lit(part)))
    blank = lambda c: F.nullif(c, F.lit(""))
    folder = blank(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1))
    niche = blank(F.regexp_extract("file", r"([a-z_]+)_\d{8}[^/]*$", 1))
    meta = F.struct(F.coalesce(blank(F.col("metadata.state")), folder).alias("state"), F.coalesce(blank(F.col("metadata.niche")), niche).alias("niche"), F.col("metadata.timestamp").alias("timestamp"))
    return flatten_places(documents.select(meta.alias("metadata"), "results_by_city"))
