"""File sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, IntegralType, MapType, StringType, StructField, StructType

from orrery.functions.text import parse_list, strip
from orrery.operators.positions import with_position
from orrery.sources import schemas

_BAD = "_unreadable"


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Records of a JSON-lines file with ``valid``: readable and with an id. Blank lines are skipped.

    A value of another type than declared is converted where it can be, else null; only a line
    that is not JSON is unreadable.

    With ``strict`` an unreadable line is an error instead. Count the rejects with ``rejects``.
    """
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wanted = StructType.fromDDL(schema)
    # read as text, so that one field of another type does not cost the record
    texts = StructType([StructField(field.name, StringType()) for field in wanted] + [StructField(_BAD, StringType())])
    rows = spark.read.schema(texts).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD).json(path)
    rows = rows.select(*[_typed(field).alias(field.name) for field in wanted], _BAD)
    valid = F.col(_BAD).isNull() & F.col("id").isNotNull() & (F.col("id").cast("string") != "")
    return rows.withColumn("valid", valid)


def _typed(field: StructField) -> Column:
    """A field read as text in its declared type; null where the text is of another."""
    text, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, StringType):
        return text
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.from_json(text, kind)
    if isinstance(kind, IntegralType):
        return F.coalesce(text.try_cast(kind), text.try_cast("double").try_cast(kind))
    return text.try_cast(kind)


def valid_records(rows: DataFrame) -> DataFrame:
    return rows.filter("valid").drop("valid", _BAD)


def rejects(rows: DataFrame) -> DataFrame:
    """How many lines were unreadable and how many had no id."""
    return rows.agg(
        F.count(F.when(F.col(_BAD).isNotNull(), 1)).alias("n_unreadable"),
        F.count(F.when(~F.col("valid") & F.col(_BAD).isNull(), 1)).alias("n_without_id"),
    )


def csv_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """(file, number, text): the records of CSV files in the order of each file, from 1, header included.

    Files are read by lines in as many tasks as they have splits. A line begins a record if an even number of
    quotes stands before it in its file (a doubled quote counts twice, so it changes nothing). Every split
    counts its quotes and, for both cases, its beginnings; sums of these over the earlier splits number the
    lines, and lines of one number are put together. A quote that is never closed makes the rest of
    its file one record, as with any reader.
    """
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("split"),
        F.monotonically_increasing_id().alias("line"), "value")
    odd = (F.length("value") - F.length(F.replace("value", F.lit(quote)))) / len(quote) % 2
    lines = lines.withColumn("quotes", odd.cast("long"))
    in_split = Window.partitionBy("file", "split").orderBy("line")
    earlier = in_split.rowsBetween(Window.unboundedPreceding, -1)
    upto = in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2
    lines = lines.withColumn("inside", inside)
    # beginnings up to this line if the split itself begins outside quotes, and if inside
    lines = lines.withColumn("outer", F.sum(1 - F.col("inside")).over(upto)).withColumn("inner", F.sum("inside").over(upto))
    splits = lines.groupBy("file", "split").agg(
        F.sum("quotes").alias("quotes"), F.max("outer").alias("outer"), F.max("inner").alias("inner"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("within", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    begun = F.when(F.col("within") == 0, F.col("outer")).otherwise(F.col("inner"))
    splits = splits.select("file", "split", "within", F.coalesce(F.sum(begun).over(before), F.lit(0)).alias("begun"))
    mine = F.when(F.col("within") == 0, F.col("outer")).otherwise(F.col("inner"))
    numbered = lines.join(splits, ["file", "split"]).select(
        "file", "split", "line", "value", (F.col("begun") + mine).alias("number"))
    parts = F.array_sort(F.collect_list(F.struct("split", "line", "value")))
    joined = F.array_join(F.transform(parts, lambda part: part["value"]), "\n")
    whole = F.regexp_replace(F.replace(joined, F.lit("\r\n"), F.lit("\n")), "\\A\ufeff|\r\\z", "")
    return numbered.groupBy("file", "number").agg(whole.alias("text"))


def csv_table(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None,
              line_breaks: bool = True) -> DataFrame:
    """Typed CSV with a header; quoted fields may hold doubled quotes and line breaks.

    Any file is read by many tasks. Without line breaks inside fields ``line_breaks=False`` saves
    putting lines together. The header must name the columns in their order; blank records are skipped.
    """
    options = {"quote": '"', "escape": '"'}
    if not line_breaks:
        rows = spark.read.schema(schema).options(header=True, enforceSchema=False, **options).csv(path)
        return rows.select(*columns) if columns else rows
    wanted = StructType.fromDDL(schema)
    names = [field.name for field in wanted]
    head = F.from_csv("text", ", ".join(f"`c{i}` string" for i in range(len(names))), options)
    named = F.array(*[F.lower(F.trim(head[f"c{i}"])) for i in range(len(names))])
    fits = named == F.array(*[F.lit(name.lower()) for name in names])
    wrong = F.raise_error(F.concat(F.lit(f"the header is not {names}: "), F.col("text"))).cast("boolean")
    kept = F.when(F.col("number") > 1, F.col("text") != "").when(F.coalesce(fits, F.lit(False)), F.lit(False)).otherwise(wrong)
    rows = csv_records(spark, path).filter(kept).select(F.from_csv("text", schema, options).alias("row")).select("row.*")
    return rows.select(*columns) if columns else rows


def interactions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Interactions with a real date; a text that is not a date becomes null."""
    rows = csv_table(spark, path, schemas.INTERACTIONS)
    return rows.withColumn("date", F.col("date").try_cast("date"))


def recipes_csv(spark: SparkSession, path: str) -> DataFrame:
    """Records of a CSV file with their list literals as arrays."""
    rows = csv_table(spark, path, schemas.RECIPES_CSV)
    for name in schemas.LIST_COLUMNS:
        rows = rows.withColumn(name, parse_list(F.col(name)))
    numbers = F.transform(parse_list(F.col("nutrition")), lambda n: n.try_cast("double"))
    rows = rows.withColumn("nutrition", numbers)
    return rows.select(*[name for name in StructType.fromDDL(schemas.RECIPES).names])


def recipes(spark: SparkSession, json_path: str | None, csv_path: str | None) -> DataFrame:
    """Records from the JSON-lines file if there is one, else from the CSV file."""
    if json_path and path_exists(spark, json_path):
        return valid_records(json_lines(spark, json_path, schemas.RECIPES))
    if csv_path and path_exists(spark, csv_path):
        return recipes_csv(spark, csv_path)
    raise FileNotFoundError(f"neither {json_path} nor {csv_path}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def free_text(rows: DataFrame, text: str, label: str | None = None, rating: str | None = None,
              max_rows: int | None = None) -> DataFrame:
    """Text rows, all as strings: null and blank texts are dropped, the others trimmed."""
    columns = [strip(F.col(text).cast("string")).alias("text")]
    columns += [F.col(label).cast("string").alias("label")] if label else []
    columns += [F.col(rating).cast("string").alias("rating")] if rating else []
    kept = rows.select(*columns).filter(F.col("text") != "")
    return kept.limit(max_rows) if max_rows is not None else kept


def class_table(spark: SparkSession, path: str) -> DataFrame:
    """(idx, label) of a class file, one label per line, numbered in file order from 0; blank lines are dropped.

    Any number of labels, read by as many tasks as the file has splits.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("split"),
        F.monotonically_increasing_id().alias("line"), strip(F.col("value")).alias("label"))
    placed = with_position(lines.filter(F.col("label") != ""), ["file", "split", "line"], "idx")
    return placed.select("idx", "label")


def class_list(spark: SparkSession, path: str) -> list[str]:
    """The labels of one class file as a list, for families whose classes are columns or slots of a vector."""
    files = spark.read.text(path).select(F.col("_metadata.file_path").alias("file")).distinct().limit(2).collect()
    if len(files) > 1:
        raise ValueError(f"{path}: a class list is one file")
    return [row["label"] for row in class_table(spark, path).orderBy("idx").collect()]  # one entry per declared class


def features(spark: SparkSession, path: str, classes: DataFrame) -> DataFrame:
    """Feature vectors of every family stored below ``path`` that has a class list.

    Families are the partitions of one table, found by listing it; one without classes is left out.
    """
    stored = spark.read.parquet(path)
    listed = classes.select("family").distinct()
    return stored.join(F.broadcast(listed), "family", "left_semi")
