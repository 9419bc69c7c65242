"""Sources and sinks: raw issue documents, type mappings, generator batches, teacher answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleanup import clean_reports

NAMED = "struct<name:string>"
RAW = f"id string, key string, fields struct<issuetype:struct<id:string,name:string>,project:struct<key:string>,status:{NAMED},created:string,summary:string,description:string,environment:string,versions:array<{NAMED}>>"
URL_HOST = r"https?://([^/\s<>\"'():]+)"


def read_json_lines(spark: SparkSession, path: str, schema: str, partitions: int | None = None) -> DataFrame:
    """Declared schema; gzipped files are one task each, so their rows are dealt anew before any work."""
    df = spark.read.schema(schema).json(path)
    return df.repartition(partitions) if partitions else df


def write_json_lines(df: DataFrame, path: str, compression: str | None = None) -> None:
    """UTF-8, one object a line."""
    df.write.mode("errorifexists").json(path, compression=compression)


def flat_issue(tracker: Column, raw: Column) -> list[Column]:
    """S3: the flat record of a raw document; missing levels are null, missing versions empty."""
    f = raw["fields"]
    return [
        tracker.alias("tracker"),
        raw["id"].alias("id"),
        raw["key"].alias("key"),
        f["project"]["key"].alias("project"),
        f["issuetype"]["id"].alias("issuetype_id"),
        f["issuetype"]["name"].alias("issuetype"),
        f["status"]["name"].alias("status"),
        f["created"].alias("created"),
        f["summary"].alias("summary"),
        f["description"].alias("description"),
        f["environment"].alias("environment"),
        F.coalesce(F.transform(f["versions"], lambda v: v["name"]), F.array().cast("array<string>")).alias("versions"),
    ]


def extraction_audit(issues: DataFrame, expected: DataFrame) -> DataFrame:
    """Per tracker and in total: found, expected, difference."""
    found = issues.groupBy("tracker").agg(F.count("*").alias("found")).join(expected, "tracker", "full_outer").na.fill(0, ["found", "expected"])
    out = found.rollup("tracker").agg(F.sum("found").alias("found"), F.sum("expected").alias("expected"))
    return out.select(F.coalesce("tracker", F.lit("total")).alias("tracker"), "found", "expected", (F.col("found") - F.col("expected")).alias("difference"))


def bug_types(spark: SparkSession, mapping: dict[str, dict[str, str]]) -> DataFrame:
    """D3 as a table (tracker, issuetype, code)."""
    return spark.createDataFrame([(t, k, c) for t, kinds in mapping.items() for k, c in kinds.items()], "tracker string, issuetype string, code string")


def select_bugs(issues: DataFrame, types: DataFrame) -> DataFrame:
    """By a broadcast of the mapping, which is a file's size; no shuffle."""
    return issues.join(F.broadcast(types.filter("code = 'Bug Report'").select("tracker", "issuetype")), ["tracker", "issuetype"], "left_semi")


def described(c: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s", " ")), F.lit("")) != ""


def bug_counts(bugs: DataFrame) -> DataFrame:
    """R2."""
    out = bugs.rollup("tracker").agg(F.count("*").alias("bugs"), F.count_if(described(F.col("description"))).alias("with_description"))
    return out.select(F.coalesce("tracker", F.lit("total")).alias("tracker"), "bugs", "with_description", (F.col("with_description") / F.col("bugs")).alias("share"))


def parse_batches(files: DataFrame) -> DataFrame:
    """Text of ``@@@ id``, summary line, ``@@@``, body blocks -> id, summary, body; fields trimmed."""
    text = F.regexp_replace("text", "\r\n", "\n")
    block = F.explode(F.filter(F.split(text, r"(?m)^@@@ (?=\S)"), lambda b: F.trim(b) != ""))
    rows = files.select(block.alias("b"))
    pattern = r"(?s)^([^\n]*)\n([^\n]*)\n@@@[ \t]*(?:\n(.*))?$"
    return rows.filter(F.col("b").rlike(pattern)).select(*[F.regexp_replace(F.regexp_extract("b", pattern, i), r"^\s+|\s+$", "").alias(c) for i, c in enumerate(("id", "summary", "body"), 1)])


def parse_answers(files: DataFrame, schema: str) -> DataFrame:
    """One object a line that is not blank -> the files' other columns, line number, raw, answer.

    answer is null where the line is no JSON object, so that ``answer is null`` names bad lines by their number.
    """
    others = [F.col(f"`{c}`") for c in files.columns if c != "text"]
    lines = files.select(*others, F.posexplode(F.split("text", "\n")).alias("pos", "raw")).filter(F.trim("raw") != "")
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("raw")).startswith("OBJECT"), F.lit(False))
    return lines.select(*others, (F.col("pos") + 1).cast("int").alias("line"), "raw", F.when(is_object, F.from_json("raw", schema)).alias("answer"))


def foreign_hosts(records: DataFrame, allowed: tuple[str, ...], codes: tuple[str, ...]) -> DataFrame:
    """(id, rule, found): hosts outside the allowed domains, and variation codes in the text."""
    own = lambda h: F.exists(F.array(*map(F.lit, allowed)), lambda a: (h == a) | h.endswith(F.concat(F.lit("."), a)))
    hosts = F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit(URL_HOST), F.lit(1)), lambda h: ~own(h)))
    leaks = F.array_compact(F.array(*[F.when(F.col("text").rlike(rf"\b{c}\b"), F.lit(c)) for c in codes]))
    each = F.concat(F.transform(hosts, lambda h: F.struct(F.lit("host").alias("rule"), h.alias("found"))), F.transform(leaks, lambda c: F.struct(F.lit("code").alias("rule"), c.alias("found"))))
    return records.select("id", F.explode(each).alias("x")).select("id", "x.*")


def public_row(df: DataFrame) -> DataFrame:
    """Id tracker:key, nulls of summary empty."""
    return df.select(F.concat_ws(":", "tracker", "key").alias("id"), F.lit("public").alias("source"), "tracker", "project", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("description", F.lit("")).alias("description"))


def cleaned_public_row(df: DataFrame) -> DataFrame:
    """Public rows as they go into sets: cleaned first, as models see them. df also has ``wiki``."""
    return public_row(clean_reports(df))


def generated_row(df: DataFrame, specs: DataFrame) -> DataFrame:
    """A generated record's area is its project; specs are a file's size."""
    return df.join(F.broadcast(specs.select("id", "area")), "id").select("id", F.lit("synthetic").alias("source"), F.lit("synthetic").alias("tracker"), F.col("area").alias("project"), "summary", F.col("body").alias("description"))
