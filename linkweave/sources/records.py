"""Record tables: tab-separated files with checks, and views over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_COLUMNS = ["entity_id", "business_name", "business_address", "country"]
TRUTH_COLUMNS = ["source1_entity_id", "matched_entity_ids"]
MATCH_COLUMNS = TRUTH_COLUMNS
CANDIDATE_COLUMNS = ["source1_entity_id", "candidate_entity_ids"]


class InvalidTable(ValueError):
    """A file that does not have the form it must have."""


def read_table(spark: SparkSession, path: str, columns: list[str], limit: int | None = None, quoted_lines: bool = False) -> DataFrame:
    """A tab-separated file with exactly this header; missing fields are empty strings.

    Short rows are filled up, long rows and other headers are errors.  The header is
    read alone; the rows are checked by the engine as they are scanned.  Large files are
    split at line ends, so a field that begins with a quote must end with one on its
    line; a file where one goes on is an error, unless ``quoted_lines`` says that fields
    may hold line ends, at the price of one task a file.
    """
    first = spark.read.text(path).limit(1).collect()
    header = [x.strip() for x in first[0][0].split("\t")] if first else []
    if len(header) == 1 and "," in header[0]:
        raise InvalidTable(f"{path}: separated by commas, not tabs")
    if header != columns:
        raise InvalidTable(f"{path}: header {header}, not {columns}")
    schema = ", ".join(f"`{c}` string" for c in [*columns, "_corrupt"])
    options = {"sep": "\t", "quote": '"', "escape": '"', "columnNameOfCorruptRecord": "_corrupt"}
    if quoted_lines:
        rows = spark.read.csv(path, header=True, schema=schema, multiLine=True, enforceSchema=True, **options)
    else:
        # A field that begins with a quote and has an odd number of them goes on on the next line.
        goes_on = F.exists(F.split("value", "\t"), lambda x: x.startswith('"') & (F.pmod(F.regexp_count(x, F.lit('"')), F.lit(2)) == 1))
        error = F.raise_error(F.concat(F.lit(f"{path}: a quote that is not closed on its line: "), F.col("value"))).cast("string")
        lines = spark.read.text(path).filter((F.col("value") != "") & (F.col("value") != first[0][0]))
        rows = lines.select(F.from_csv(F.when(F.coalesce(goes_on, F.lit(False)), error).otherwise(F.col("value")), F.lit(schema), options).alias("r")).select("r.*")
    long = F.size(F.split("_corrupt", "\t")) > len(columns)
    checked = rows.select(*[F.when(F.coalesce(long, F.lit(False)), F.raise_error(F.concat(F.lit(f"{path}: too many fields: "), F.col("_corrupt"))).cast("string")).otherwise(F.coalesce(c, F.lit(""))).alias(c) for c in columns])
    return checked.limit(limit) if limit is not None else checked


def read_records(spark: SparkSession, path: str, limit: int | None = None, unique: bool = True) -> DataFrame:
    records = read_table(spark, path, RECORD_COLUMNS, limit)
    if unique and (twice := repeated(records, "entity_id").limit(5).collect()):
        raise InvalidTable(f"{path}: repeated ids, such as {[r[0] for r in twice]}")
    return records


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path).select(F.trim("entity_id").alias("entity_id")).filter("entity_id <> ''")


def read_id_lines(spark: SparkSession, path: str) -> DataFrame:
    """Ids, one a line."""
    return spark.read.text(path).select(F.trim("value").alias("entity_id")).filter("entity_id <> ''")


def first_fields(spark: SparkSession, path: str) -> DataFrame:
    """The different first fields of a file's rows but the header, without CSV quoting."""
    return spark.read.text(path).select(F.trim(F.split("value", "\t")[0]).alias("entity_id")).filter("entity_id not in ('', 'entity_id', 'source1_entity_id')").distinct()


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object a line, such as cached records and scores; fields that are not there are null."""
    return spark.read.schema(schema).json(path)


def repeated(df: DataFrame, column: str) -> DataFrame:
    """(column, n) of values that are there more than once."""
    return df.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")


def id_list(column) -> object:
    """A comma-separated list as an array without blanks."""
    return F.filter(F.transform(F.split(column, ","), lambda x: F.trim(x)), lambda x: x != "")


def truth_faults(truth: DataFrame) -> DataFrame:
    """(source1_entity_id, fault) of rows of a truth table that break its rules."""
    t = truth.withColumn("ids", id_list("matched_entity_ids"))
    faults = {
        "bad_source_prefix": ~F.col("source1_entity_id").startswith("S1-"),
        "repeated_target": F.size("ids") != F.size(F.array_distinct("ids")),
        "source_as_target": F.exists("ids", lambda x: x.startswith("S1-")),
        "bad_target_prefix": F.exists("ids", lambda x: ~x.rlike("^S[123]-")),
    }
    each = t.select("source1_entity_id", F.explode(F.array(*[F.when(c, F.lit(n)) for n, c in faults.items()])).alias("fault")).filter("fault is not null")
    return each.unionByName(repeated(truth, "source1_entity_id").select("source1_entity_id", F.lit("repeated_source").alias("fault")))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth table; rows that break its rules are errors."""
    truth = read_table(spark, path, TRUTH_COLUMNS)
    if bad := truth_faults(truth).limit(5).collect():
        raise InvalidTable(f"{path}: {[(r[0], r[1]) for r in bad]}")
    return truth


def truth_pairs(truth: DataFrame) -> DataFrame:
    """(s1_id, tid), a row a match; tid is null for a record without one."""
    return truth.select(F.col("source1_entity_id").alias("s1_id"), F.explode_outer(id_list("matched_entity_ids")).alias("tid"))


def er_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records made of documents: four words as name, a number and five words as address, three sources by id."""
    t = F.split(F.regexp_replace(F.trim(F.col("text"), F.lit(" \t\n")), "[ \t\n]+", " "), " ")
    source = F.when(F.col("doc_id") % 3 == 0, "S1-").when(F.col("doc_id") % 3 == 1, "S2-").otherwise("S3-")
    address = F.when(F.col("doc_id") % 29 == 0, "").otherwise(F.concat((F.col("n_chars") % 997).cast("string"), F.lit(" "), F.array_join(F.slice(t, 5, 5), " ")))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.concat(source, F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("entity_id"), F.array_join(F.slice(t, 1, 4), " ").alias("business_name"), address.alias("business_address"), F.col("lang").alias("country"), F.md5(F.lower(F.regexp_replace("text", "[^A-Za-z]+", " "))).alias("k"))


def of_source(records: DataFrame, *prefixes: str) -> DataFrame:
    return records.filter(F.substring("entity_id", 1, 2).isin(*prefixes))


def er_truth(records: DataFrame) -> DataFrame:
    """(s1_id, tid) of records of equal letters."""
    s1 = of_source(records, "S1").select(F.col("entity_id").alias("s1_id"), "k")
    return s1.join(of_source(records, "S2", "S3").select(F.col("entity_id").alias("tid"), "k"), "k").select("s1_id", "tid")
