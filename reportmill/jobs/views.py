"""Bug reports, labels, predictions and events derived from the driver's tables, as DataFrames and as SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workers import small_batches
from ..operators.labels import CHECKS
from ..operators.sampling import u
from ..operators.scoring import blank_tokens, state_json

SEED = "20261008"
BUG_TYPES = {"Bug": "Bug Report", "Defect": "Bug Report", "Task": "Task", "Story": "Feature"}
#: What a report's description ends in, by doc_id % 12.
FRAGMENTS = (
    "1. Open the page\n2. Press save\n3. Look at the list",
    "### Steps to reproduce\n1. Open\n2. Save\n### Expected result\nThe row is saved\n### Actual result\nThe row is lost",
    "### Steps to reproduce\n\n### Expected result\n-\n### Actual result\n[image]",
    "The page should open at once.",
    "Version: 4.18.2 on stand qa1",
    "Build: latest\nSeen in prod",
    "```\na\nb\nc\nd\ne\nf\ng\n```\nThe job hangs",
    "h2. Where\n{code:java}\nint a = 1;\nint b = 2;\n{code}\n*bold* text",
    "java.lang.IllegalStateException: closed\n\tat a.b.C(C.java:1)\n\tat a.b.D(D.java:2)\n\tat a.b.E(E.java:3)\n\tat a.b.F(F.java:4)\n\tat a.b.G(G.java:5)\n\tat a.b.H(H.java:6)\nThen it stops",
    "See [the log](https://logs.example.com:8080/x?a=1&b=2) and https://prod.example.org/a. ![shot](a.png)",
    "<!-- fill\nthis in --> ~~old value~~ Expected: works &lt;b&gt;",
    "**Expected result:** it works\n**Actual result:** it does not work",
)


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _u_sql(seed: str, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}|' || {key}), 1, 12))::BIGINT / 281474976710656.0)"


u_sql = _u_sql


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports over the documents' whole texts: a planted fragment follows the text, and the first line is the summary."""
    small_batches(spark)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.col("doc_id")
    first = F.substring_index("text", "\n", 1)
    summary = F.concat(F.when(n % 5 == 0, "[Area] ").otherwise(""), F.when(n % 11 == 0, "Add ").otherwise(""), first, F.when(n % 13 == 0, "?").otherwise(""))
    fragment = F.element_at(F.array(*map(F.lit, FRAGMENTS)), (n % 12 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, BUG_TYPES)), (n % 4 + 1).cast("int"))
    return d.select(
        n.alias("doc_id"),
        F.concat_ws(":", "source", n.cast("string")).alias("id"),
        n.cast("string").alias("key"),
        F.lit("public").alias("source"),
        F.col("source").alias("tracker"),
        F.concat("lang", (n % 7).cast("string")).alias("project"),
        kind.alias("issuetype"),
        summary.alias("summary"),
        F.when(n % 97 != 0, F.concat("text", F.lit("\n\n"), fragment)).alias("description"),
        (n % 12 == 7).alias("wiki"),
    )


_fragments = " ".join(f"WHEN {i} THEN {_text(f)}" for i, f in enumerate(FRAGMENTS))
_kinds = " ".join(f"WHEN {i} THEN {_text(k)}" for i, k in enumerate(BUG_TYPES))
REPORTS = f"""reports AS (
  SELECT doc_id, source || ':' || doc_id AS id, doc_id::VARCHAR AS key, 'public' AS source, source AS tracker, lang || (doc_id % 7) AS project,
    CASE doc_id % 4 {_kinds} END AS issuetype,
    CASE WHEN doc_id % 5 = 0 THEN '[Area] ' ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN 'Add ' ELSE '' END || split_part(text, chr(10), 1) || CASE WHEN doc_id % 13 = 0 THEN '?' ELSE '' END AS summary,
    CASE WHEN doc_id % 97 <> 0 THEN text || chr(10) || chr(10) || CASE doc_id % 12 {_fragments} END END AS description,
    doc_id % 12 = 7 AS wiki
  FROM documents)"""


def chance(seed: str, check: Column, key: Column) -> Column:
    return u(seed, F.concat_ws("|", check, key))


def labels_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, check, gold, tag) of labelled documents; low quality misses more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").join(reports(spark, sf_dir).select("doc_id", "id"), "doc_id")
    each = labels.select("id", "quality", F.explode(F.array(*map(F.lit, CHECKS))).alias("check"))
    least = F.when(F.col("quality") == 1, 0.8).otherwise(0.4)
    tag = F.when(u("tag", F.col("id")) < 0.4, "core").otherwise("added")
    return each.select("id", "check", (chance("gold", F.col("check"), F.col("id")) < least).alias("gold"), tag.alias("tag"))


_checks = ", ".join(f"('{c}')" for c in CHECKS)
LABELS = f"""labels_long AS (
  SELECT id, c."check" AS "check", {_u_sql('gold', """c."check" || '|' || id""")} < CASE WHEN quality = 1 THEN 0.8 ELSE 0.4 END AS gold,
    CASE WHEN {_u_sql('tag', 'id')} < 0.4 THEN 'core' ELSE 'added' END AS tag
  FROM labels JOIN reports USING (doc_id) CROSS JOIN (VALUES {_checks}) AS c("check"))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, id, check, gold, tag, p) of two models, the new one surer where it is right."""
    out = None
    for model, right in (("old", 0.30), ("new", 0.38)):
        x = chance(model, F.col("check"), F.col("id"))
        p = F.when(F.col("gold"), right + 0.6 * x).otherwise(0.7 - 0.65 * x)
        rows = labels_long(spark, sf_dir).select(F.lit(model).alias("model"), "id", "check", "gold", "tag", (F.floor(p * 10000) / 10000).alias("p"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _scored_sql(model: str, right: float) -> str:
    x = _u_sql(model, """"check" || '|' || id""")
    return f"SELECT '{model}' AS model, id, \"check\", gold, tag, floor(CASE WHEN gold THEN {right}::DOUBLE + 0.6::DOUBLE * {x} ELSE 0.7::DOUBLE - 0.65::DOUBLE * {x} END * 10000) / 10000 AS p FROM labels_long"


SCORED = f"scored AS ({_scored_sql('old', 0.30)} UNION ALL {_scored_sql('new', 0.38)})"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with a description: tokens by blanks, of the text and of the JSON state, and a mark of rare parts."""
    r = reports(spark, sf_dir).filter(F.col("description").isNotNull())
    return r.select("id", "tracker", "project", "summary", "description", blank_tokens(F.col("description")).alias("tokens"), blank_tokens(state_json()).alias("state_tokens"), (F.col("doc_id") % 7 == 0).alias("rare"))


#: The JSON of a state in SQL.
STATE = """('{"summary":' || to_json(summary) || ',"description":' || to_json(description) || '}')"""
CANDIDATES = rf"""candidates AS (
  SELECT id, tracker, project, summary, description, length(regexp_extract_all(description, '[^ \t\n\r\f\v]+'))::INTEGER AS tokens, length(regexp_extract_all({STATE}, '[^ \t\n\r\f\v]+'))::INTEGER AS state_tokens, doc_id % 7 = 0 AS rare
  FROM reports WHERE description IS NOT NULL)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue events: repository, number, time and the issue as its tracker sends it."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    state = F.when(F.col("event_type") == "error", "closed").otherwise("open")
    label = F.when(F.col("event_id") % 3 == 0, "Bug").when(F.col("event_id") % 3 == 1, "bug").otherwise("question")
    status = F.when(F.col("event_id") % 4 == 0, "in progress").when(F.col("event_id") % 4 == 1, "OPEN").otherwise("later")
    body = F.when(F.col("event_id") % 6 != 0, F.concat(F.lit("### Steps\n_No response_\nvalue "), F.floor("value").cast("string")))
    issue = F.struct(
        F.col("user_id").alias("number"),
        F.concat(F.lit("Issue "), F.col("user_id").cast("string")).alias("title"),
        body.alias("body"),
        state.alias("state"),
        F.struct(F.when(F.col("event_id") % 9 == 2, "Bug").alias("name")).alias("type"),
        F.array(F.struct(label.alias("name")), F.struct(status.alias("name"))).alias("labels"),
    )
    return e.select((F.col("user_id") % 3).alias("repo"), F.col("user_id").alias("number"), "ts", "event_id", issue.alias("issue"))


EVENTS = r"""issue_events AS (
  SELECT user_id % 3 AS repo, user_id AS number, ts, event_id,
    event_id % 3 < 2 OR event_id % 9 = 2 AS is_bug,
    CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 4 = 1 THEN 'Open' WHEN event_id % 4 = 0 THEN 'In Progress' ELSE 'Submitted' END AS state,
    'Issue ' || user_id AS summary,
    CASE WHEN event_id % 6 <> 0 THEN '### Steps' || chr(10) || chr(10) || 'value ' || floor(value)::BIGINT ELSE '' END AS description
  FROM events)"""
