"""Registered queries, one an operator of the inventory, each with SQL of the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleanup, rules
from ..functions import text as T
from ..operators import decide as D
from ..operators import evaluate as E
from ..operators import labels as L
from ..operators import sampling as S
from ..operators import scoring as X
from ..operators.shared import shared_folder
from ..sources import issues as I
from ..streaming import comments as C
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
R, CAND = f"WITH {V.REPORTS} ", f"WITH {V.REPORTS}, {V.CANDIDATES} "
LAB = f"WITH {V.REPORTS}, {V.LABELS} "
SCO = f"WITH {V.REPORTS}, {V.LABELS}, {V.SCORED} "
EV = f"WITH {V.EVENTS} "
SEED = V.SEED


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Sources -------------------------------------------------------------------------------------------------------------
def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as JSON text of raw issue documents; some levels are missing."""
    r = V.reports(spark, sf_dir)
    named = lambda c: F.struct(c.alias("name"))
    fields = F.struct(
        F.struct(F.lit("1").alias("id"), F.col("issuetype").alias("name")).alias("issuetype"),
        F.when(F.col("doc_id") % 10 != 0, F.struct(F.col("project").alias("key"))).alias("project"),
        "summary",
        "description",
        F.when(F.col("doc_id") % 3 == 0, F.array(named(F.lit("1.0")), named(F.lit("1.1")))).alias("versions"),
        F.lit("dropped").alias("customfield_1"),
    )
    return r.select("tracker", F.to_json(F.struct("id", "key", fields.alias("fields"))).alias("line"))


@query(R + "SELECT tracker, id, key, CASE WHEN doc_id % 10 <> 0 THEN project END AS project, issuetype, NULL::VARCHAR AS status, summary, description, CASE WHEN doc_id % 3 = 0 THEN '1.0,1.1' ELSE '' END AS versions FROM reports")
def s3_flatten(spark, sf_dir):
    raw = _raw(spark, sf_dir).select("tracker", F.from_json("line", I.RAW).alias("raw"))
    flat = raw.select(*I.flat_issue(F.col("tracker"), F.col("raw")))
    return flat.select("tracker", "id", "key", "project", "issuetype", "status", "summary", "description", F.array_join("versions", ",").alias("versions"))


@query(R + "SELECT tracker, id, summary FROM reports")
def s1_s2_json_round_trip(spark, sf_dir):
    """Written as JSON lines and read back with a declared schema; the folder is the session's warehouse."""
    import uuid

    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/reports-{uuid.uuid4().hex}"
    I.write_json_lines(V.reports(spark, sf_dir).select("tracker", "id", "summary"), path, "gzip")
    return I.read_json_lines(spark, path, "tracker string, id string, summary string")


@query(R + "SELECT coalesce(tracker, 'total') AS tracker, count(*) AS found, 50 * count(DISTINCT tracker) AS expected, count(*) - 50 * count(DISTINCT tracker) AS difference FROM reports GROUP BY ROLLUP (tracker)")
def s4_extraction_audit(spark, sf_dir):
    r = V.reports(spark, sf_dir)
    return I.extraction_audit(r, r.select("tracker").distinct().withColumn("expected", F.lit(50).cast("long")))


@query(R + r"SELECT key AS id, trim(regexp_replace(summary, '\s+$', '')) AS summary, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Body of ' || key END AS body FROM reports")
def s5_generator_batches(spark, sf_dir):
    block = F.concat(F.lit("@@@ "), F.col("key"), F.lit("\r\n"), F.col("summary"), F.lit("\r\n@@@\r\n"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("Body of "), F.col("key"))), F.lit("\r\n"))
    files = V.reports(spark, sf_dir).groupBy("tracker", "project").agg(F.array_join(F.collect_list(block), "").alias("text"))
    return I.parse_batches(files)


@query(R + "SELECT key, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 2 = 0 END AS steps, 1 AS line FROM reports UNION ALL SELECT key, doc_id % 3 = 0, 3 FROM reports")
def s6_teacher_answers(spark, sf_dir):
    """Two answers a file with a blank line between; every fifth first line is broken."""
    n = F.col("doc_id")
    first = F.when(n % 5 == 0, '{"id": ').otherwise(F.concat(F.lit('{"steps": '), (n % 2 == 0).cast("string"), F.lit("}")))
    files = V.reports(spark, sf_dir).select("key", F.concat(first, F.lit('\n\n{"steps": '), (n % 3 == 0).cast("string"), F.lit("}\n")).alias("text"))
    return I.parse_answers(files, "steps boolean").select("key", F.col("answer.steps").alias("steps"), "line")


# Cleanup -------------------------------------------------------------------------------------------------------------
@query(R + "SELECT id, regexp_replace(coalesce(description, ''), chr(13) || chr(10) || '?', chr(10), 'g') AS text FROM reports")
def p1_line_feeds(spark, sf_dir):
    return V.reports(spark, sf_dir).select("id", T.line_feeds(F.col("description")).alias("text"))


@query("SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS text FROM pages")
def p3_comments(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.without_comments(F.col("html")).alias("text"))


@query(R + "SELECT id, replace(description, '~~old value~~', '') AS text FROM reports")
def p4_struck(spark, sf_dir):
    return V.reports(spark, sf_dir).select("id", T.without_struck(F.col("description")).alias("text"))


@query(R + r"SELECT id, trim(regexp_replace(summary, '^\s*(?:\[[^\]]*\]\s*)+', '')) AS summary FROM reports")
def p5_summary_tags(spark, sf_dir):
    return V.reports(spark, sf_dir).select("id", T.without_tags(F.col("summary")).alias("summary"))


@query(R + r"SELECT id, regexp_replace(description, '!\[[^\]]*\]\([^)\s]*\)', '[image]', 'g') AS text FROM reports")
def p6_media(spark, sf_dir):
    return V.reports(spark, sf_dir).select("id", T.media_marked(F.col("description")).alias("text"))


@query(R + r"SELECT id, regexp_replace(regexp_replace(description, '\[([^\]\n]+)\]\((https?://[^)\s]+)\)', '\1 \2', 'g'), '<?https?://([^/\s<>\"''()]+)(?:[^\s<>\"'']*[^\s<>\"''.,;:!?)\]])?>?', '[link: \1]', 'g') AS text FROM reports")
def p7_links(spark, sf_dir):
    return V.reports(spark, sf_dir).select("id", T.links_marked(F.col("description")).alias("text"))


@query(R + "SELECT id, replace(description, chr(10) || 'f' || chr(10) || 'g' || chr(10) || '```', chr(10) || '[… truncated]' || chr(10) || '```') AS text FROM reports")
def p8_fences(spark, sf_dir):
    return V.reports(spark, sf_dir).select("id", T.fences_cut(F.col("description")).alias("text"))


@query(R + r"SELECT id, regexp_replace(regexp_replace(description, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM reports WHERE description IS NOT NULL")
def p12_blank_lines(spark, sf_dir):
    return V.reports(spark, sf_dir).filter("description is not null").select("id", T.blank_lines_joined(F.col("description")).alias("text"))


@query(EV + "SELECT event_id, description FROM issue_events")
def p14_skipped_answers(spark, sf_dir):
    return D.normalized(V.events(spark, sf_dir)).select("event_id", "description")


@query()
def p13_clean_reports(spark, sf_dir):
    return cleanup.clean_reports(V.reports(spark, sf_dir)).select("id", "tracker", "summary", "description")


@query()
def p2_p13_clean_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.lit("").alias("summary"), F.col("html").alias("description"), F.lit(False).alias("wiki"))
    return cleanup.clean_reports(pages).select("page_id", "description")


# Filters and rules ---------------------------------------------------------------------------------------------------
def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    trackers = V.reports(spark, sf_dir).select("tracker").distinct()
    return trackers.select("tracker", F.explode(F.create_map(*[F.lit(x) for kv in V.BUG_TYPES.items() for x in kv])).alias("issuetype", "code"))


@query(R + "SELECT id, tracker, issuetype FROM reports WHERE issuetype IN ('Bug', 'Defect')")
def r1_select_bugs(spark, sf_dir):
    return I.select_bugs(V.reports(spark, sf_dir), _types(spark, sf_dir)).select("id", "tracker", "issuetype")


@query(R + "SELECT coalesce(tracker, 'total') AS tracker, count(*) AS bugs, count(*) FILTER (trim(coalesce(description, '')) <> '') AS with_description, round(count(*) FILTER (trim(coalesce(description, '')) <> '') / count(*), 6) AS share FROM reports GROUP BY ROLLUP (tracker)")
def r2_bug_counts(spark, sf_dir):
    return _six(I.bug_counts(V.reports(spark, sf_dir)), "share")


FLAGS = r"""
  (regexp_matches(d, '(?im)^[^0-9A-Za-z_À-ɏ]*(?:steps|how to reproduce|to reproduce|reproduction)\b') OR length(regexp_extract_all(d, '(?m)^\s*\d+[.)]\s+\S')) >= 2) AS steps,
  regexp_matches(d, '(?i)\bexpected\b') AS expected, regexp_matches(d, '(?i)\b(?:version|build)\s*:?\s*#?v?\d|\b\d+\.\d+\.\d+') AS version,
  length(list_distinct(list_transform(regexp_extract_all(d, '(?im)^\s*(?:#{1,6}\s*|\*\*)(steps|expected|actual|observed)', 1), lambda x: lower(x)))) >= 2 AS template"""


@query(R + f"SELECT id, {FLAGS} FROM (SELECT id, coalesce(description, '') AS d FROM reports)")
def r3_flags(spark, sf_dir):
    return V.reports(spark, sf_dir).select("id", rules.flags(F.coalesce("description", F.lit(""))).alias("f")).select("id", "f.*")


_shares = ", ".join(f"round(avg({c}::INT), 6) AS {c}" for c in ("steps", "expected", "version", "template"))


@query(R + f""", f AS (SELECT id, tracker, {FLAGS} FROM (SELECT id, tracker, coalesce(description, '') AS d FROM reports)), p AS (SELECT 'pool' AS part, * FROM f UNION ALL SELECT 'sample', * FROM f WHERE {V.u_sql(SEED, 'id')} < 0.2)
  SELECT part, coalesce(tracker, 'total') AS tracker, count(*) AS n, {_shares} FROM p GROUP BY part, ROLLUP (tracker)""")
def r4_flag_shares(spark, sf_dir):
    """How often each rare part is there, in the pool and in a sample of it, by tracker and in all."""
    flagged = V.reports(spark, sf_dir).select("id", "tracker", rules.flags(F.coalesce("description", F.lit(""))).alias("f")).select("id", "tracker", "f.*")
    return _six(S.part_shares(flagged, S.bernoulli(flagged, 0.2, SEED)), "steps", "expected", "version", "template")


TASK = r"'(?i)^[^0-9A-Za-z_À-ɏ]*(?:add|allow|support|update|upgrade|improve|implement|remove|make|use|create|enable|refactor|document|provide|introduce|need|please)\b'"


@query(CAND + rf"SELECT id, concat_ws(',', CASE WHEN NOT regexp_matches(summary || chr(10) || description, '(?i)\b(?:expect\w*|should|instead|supposed|must|correct(?:ly)?)\b') THEN 'expected' END, CASE WHEN regexp_matches(summary, {TASK}) OR rtrim(summary) LIKE '%?' THEN 'actual' END) AS missing FROM candidates")
def r5_likely_missing(spark, sf_dir):
    return V.candidates(spark, sf_dir).select("id", F.array_join(rules.likely_missing(F.col("summary"), F.col("description")), ",").alias("missing"))


_WORDS = "array_to_string(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), ' ')"
GAP = rf"""(NOT regexp_matches(summary, {TASK}) AND (tokens <= 60 OR starts_with({_WORDS.format('description')}, {_WORDS.format('summary')})
  OR (length(regexp_extract_all(description, '(?m)^\s*\d+[.)]\s+\S')) >= 2 AND NOT regexp_matches(description, '{rules.RESULT_WORDS}'))))"""


@query(CAND + f"SELECT id, {GAP} AS gap FROM candidates")
def r6_ordinary_gap(spark, sf_dir):
    return V.candidates(spark, sf_dir).select("id", rules.ordinary_gap(F.col("summary"), F.col("description"), F.col("tokens")).alias("gap"))


@query(R + r"SELECT id, CASE WHEN regexp_matches(summary || chr(10) || description, '\b4\.\d+\.\d+') THEN true WHEN doc_id % 12 = 5 THEN false END AS build FROM reports WHERE description IS NOT NULL")
def r7_build_version(spark, sf_dir):
    r = V.reports(spark, sf_dir).filter("description is not null")
    return r.select("id", rules.build_version(F.col("summary"), F.col("description"), r"\b4\.\d+\.\d+").alias("build"))


@query(R + r"SELECT id, concat_ws(',', CASE WHEN regexp_matches(t, '(?i)\bqa1\b') THEN 'qa1' END, CASE WHEN regexp_matches(t, '(?i)\bstage\b') THEN 'stage' END, CASE WHEN regexp_matches(t, '(?i)\bprod(?:uction)?\b') THEN 'prod' END) AS environments FROM (SELECT id, summary || chr(10) || description AS t FROM reports WHERE description IS NOT NULL)")
def r8_environments(spark, sf_dir):
    r = V.reports(spark, sf_dir).filter("description is not null")
    return r.select("id", F.array_join(rules.environments(F.col("summary"), F.col("description")), ",").alias("environments"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = V.reports(spark, sf_dir).filter("description is not null")
    return r.select("id", "doc_id", "description", rules.read_lines("description").alias("l"))


@query(R + "SELECT id, CASE doc_id % 12 WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 10 THEN 0 WHEN 11 THEN 2 ELSE 0 END AS sections FROM reports WHERE description IS NOT NULL")
def r9_sections(spark, sf_dir):
    return _lines(spark, sf_dir).select("id", F.size("l.sections").alias("sections"))


@query(R + "SELECT id, CASE WHEN doc_id % 12 = 2 THEN 'actual' ELSE '' END AS image_only, CASE WHEN doc_id % 12 = 2 THEN 'steps,expected' ELSE '' END AS empty FROM reports WHERE description IS NOT NULL")
def r10_r11_images_and_empty(spark, sf_dir):
    return _lines(spark, sf_dir).select("id", F.array_join(rules.image_only(F.col("l.sections")), ",").alias("image_only"), F.array_join(rules.empty_sections(F.col("l.sections")), ",").alias("empty"))


@query()
def r12_r15_strict_missing(spark, sf_dir):
    return _lines(spark, sf_dir).select("id", F.array_join(rules.strict_missing(F.col("description"), F.col("l")), ",").alias("missing"))


@query()
def completeness_by_tracker(spark, sf_dir):
    """The flagship: bugs, cleaned, held against the strict criteria, as rates per tracker."""
    bugs = I.select_bugs(V.reports(spark, sf_dir), _types(spark, sf_dir))
    lines = cleanup.clean_reports(bugs).withColumn("l", rules.read_lines("description")).withColumn("missing", rules.strict_missing(F.col("description"), F.col("l")))
    rates = [F.round(F.avg(F.array_contains("missing", c).cast("int")), 6).alias(f"{c}_missing") for c in ("steps", "expected", "actual")]
    return lines.groupBy("tracker").agg(F.count("*").alias("bugs"), F.round(F.avg((F.size("missing") == 0).cast("int")), 6).alias("complete"), *rates)


@query(EV + "SELECT event_id, CASE WHEN is_bug THEN 'bug' ELSE 'other' END AS type, state, summary, description FROM issue_events")
def r16_normalize(spark, sf_dir):
    return D.normalized(V.events(spark, sf_dir)).select("event_id", "type", "state", "summary", "description")


@query(EV + "SELECT event_id, state FROM issue_events WHERE is_bug AND state IS NOT NULL")
def r17_triggered(spark, sf_dir):
    return D.triggered(D.normalized(V.events(spark, sf_dir))).select("event_id", "state")


VERDICT = "CASE WHEN greatest(p, 1 - p) < 0.827 THEN 'unsure' WHEN p >= 0.5 THEN 'present' ELSE 'missing' END"


@query(SCO + f'SELECT model, id, "check", {VERDICT} AS verdict FROM scored')
def r18_verdicts(spark, sf_dir):
    return V.scored(spark, sf_dir).select("model", "id", "check", D.verdict(F.col("p"), 0.827).alias("verdict"))


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled reports, cleaned, with the new model's chances and the labels side by side."""
    s = V.scored(spark, sf_dir).filter("model = 'new'")
    wide = s.groupBy("id").agg(*[F.max(F.when(F.col("check") == c, F.col("p"))).alias(f"p_{c}") for c in L.CHECKS], *[F.max(F.when(F.col("check") == c, F.col("gold"))).alias(f"gold_{c}") for c in L.CHECKS])
    windows = X.window_count(X.blank_tokens(X.state_json())).alias("windows")
    r = cleanup.clean_reports(V.reports(spark, sf_dir)).select("id", "tracker", "summary", "description", F.lit("Open").alias("state"), windows)
    return r.join(wide, "id")


@query()
def r19_decide(spark, sf_dir):
    return D.decided(_wide(spark, sf_dir)).select("id", *L.CHECKS, "long", F.array_join("environments", ",").alias("environments"), F.array_join("image_only", ",").alias("image_only"))


@query()
def r19_decide_strict(spark, sf_dir):
    return D.decided(_wide(spark, sf_dir), D.Settings(strict=True)).select("id", *L.CHECKS)


@query()
def r20_r21_comments(spark, sf_dir):
    d = D.decided(_wide(spark, sf_dir))
    return d.select("id", D.complete().alias("complete"), D.comment().alias("comment"))


@query(EV + "SELECT event_id, substr(sha256('{\"summary\":' || to_json(summary) || ',\"description\":' || to_json(description) || CASE WHEN state IS NULL THEN '' ELSE ',\"state\":\"' || state || '\"' END || ',\"settings\":\"" + str(D.Settings()).replace("'", "''") + "\"}'), 1, 16) AS fp FROM issue_events")
def r22_fingerprint(spark, sf_dir):
    return D.normalized(V.events(spark, sf_dir)).select("event_id", D.fingerprint().alias("fp"))


@query(R + "SELECT id FROM reports WHERE length(summary) + length(description) <= 500")
def r23_short_reports(spark, sf_dir):
    return V.reports(spark, sf_dir).filter(F.length("summary") + F.length("description") <= 500).select("id")


@query(R + "SELECT id, 'host' AS rule, 'logs.example.com' AS found FROM reports WHERE doc_id % 12 = 9 AND doc_id % 97 <> 0 UNION ALL SELECT id, 'code', 'qa1' FROM reports WHERE doc_id % 12 = 4 AND doc_id % 97 <> 0")
def r24_foreign_hosts(spark, sf_dir):
    return I.foreign_hosts(V.reports(spark, sf_dir).select("id", F.col("description").alias("text")), ("example.org",), ("qa1", "zz9"))


_asked = " ".join(f"WHEN '{c}' THEN '{q}'" for c, q in L.QUESTIONS.items())


@query(LAB + f'SELECT r.id, summary, description, l."check" AS "check", CASE l."check" {_asked} END AS question, CASE WHEN gold THEN 0.05 ELSE 0.95 END AS p_false, CASE WHEN gold THEN 0.95 ELSE 0.05 END AS p_true, gold AS label FROM labels_long l JOIN reports r USING (id)')
def r25_training_rows(spark, sf_dir):
    """State, question map and smoothed targets of each row, taken apart by check."""
    rows = L.training_rows(V.reports(spark, sf_dir), V.labels_long(spark, sf_dir), 0.1)
    each = rows.select("id", "state.*", "questions", F.explode("gold").alias("check", "g"))
    return each.select("id", "summary", "description", "check", F.col("questions")[F.col("check")]["text"].alias("question"), F.round("g.p_false", 6).alias("p_false"), F.round("g.p_true", 6).alias("p_true"), F.col("g.label").alias("label"))


@query(R + "SELECT tracker || ':' || key AS id, 'public' AS source, tracker, project, summary, coalesce(description, '') AS description FROM reports")
def r26_public_rows(spark, sf_dir):
    return I.public_row(V.reports(spark, sf_dir))


@query(R + f"""SELECT batch, string_agg(line, chr(10) ORDER BY place, id) AS lines, count(*)::INTEGER AS n FROM (SELECT id, {V.u_sql('batches', 'id')} AS place, (row_number() OVER (ORDER BY {V.u_sql('batches', 'id')}, id) - 1) // 20 AS batch,
  '{{"id":' || to_json(id) || ',"summary":' || to_json(summary) || CASE WHEN description IS NULL THEN '' ELSE ',"description":' || to_json(description) END || '}}' AS line FROM reports) GROUP BY batch""")
def r27_teacher_batches(spark, sf_dir):
    return L.batches(V.reports(spark, sf_dir))


# Joins ---------------------------------------------------------------------------------------------------------------
@query(LAB + 'SELECT r.id, tracker, "check", gold FROM reports r JOIN labels_long l USING (id)')
def j1_labelled(spark, sf_dir):
    return V.reports(spark, sf_dir).select("id", "tracker").join(V.labels_long(spark, sf_dir).drop("tag"), "id")


@query(LAB + "SELECT id FROM reports WHERE id NOT IN (SELECT id FROM labels_long)")
def j2_without_label(spark, sf_dir):
    return L.without_label(V.reports(spark, sf_dir), V.labels_long(spark, sf_dir))


@query(R + "SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'extra' ELSE 'missing' END AS problem FROM (SELECT id FROM reports WHERE doc_id % 2 = 0) a FULL JOIN (SELECT id FROM reports WHERE doc_id % 3 = 0) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL")
def j3_u2_id_difference(spark, sf_dir):
    r = V.reports(spark, sf_dir)
    return L.id_difference(r.filter("doc_id % 2 = 0"), r.filter("doc_id % 3 = 0"))


@query(CAND + "SELECT id FROM candidates WHERE id NOT IN (SELECT id FROM labels JOIN reports USING (doc_id)) AND (tracker, project) NOT IN (SELECT (tracker, project) FROM reports WHERE doc_id % 50 = 0)")
def j4_j5_unused(spark, sf_dir):
    r = V.reports(spark, sf_dir)
    used = r.join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id"), "doc_id", "left_semi")
    return S.without_used(V.candidates(spark, sf_dir), used, r.filter("doc_id % 50 = 0")).select("id")


@query(R + "SELECT tracker, project FROM reports WHERE doc_id % 9 = 0 INTERSECT SELECT tracker, project FROM reports WHERE doc_id % 10 = 0")
def j6_u3_shared_projects(spark, sf_dir):
    r = V.reports(spark, sf_dir)
    return S.shared_projects(r.filter("doc_id % 9 = 0"), r.filter("doc_id % 10 = 0"))


@query("SELECT 'syn-train-' || item_id AS id, 'synthetic' AS source, 'synthetic' AS tracker, 'area' || (item_id % 5) AS project, substr(text, 1, 40) AS summary, text AS description FROM benchmark")
def j7_generated_rows(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumn("id", F.concat(F.lit("syn-train-"), F.col("item_id").cast("string")))
    specs = b.select("id", F.concat(F.lit("area"), (F.col("item_id") % 5).cast("string")).alias("area"))
    return I.generated_row(b.select("id", F.substring("text", 1, 40).alias("summary"), F.col("text").alias("body")), specs)


@query(R + "SELECT id, CASE WHEN doc_id % 3 = 0 THEN 'second' WHEN doc_id % 2 = 0 THEN 'first' END AS steps FROM reports WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def j8_label_precedence(spark, sf_dir):
    r = V.reports(spark, sf_dir)
    return L.latest_labels([r.filter("doc_id % 2 = 0").select("id", F.lit("first").alias("steps")), r.filter("doc_id % 3 = 0").select("id", F.lit("second").alias("steps"))])


@query(SCO + 'SELECT a.id, a."check", a.p AS p_old, b.p AS p_new FROM scored a JOIN scored b ON a.id = b.id AND a."check" = b."check" WHERE a.model = \'old\' AND b.model = \'new\'')
def j9_old_and_new(spark, sf_dir):
    s = V.scored(spark, sf_dir)
    side = lambda m: s.filter(F.col("model") == m).select("id", "check", F.col("p").alias(f"p_{m}"))
    return side("old").join(side("new"), ["id", "check"])


@query(SCO + "SELECT l.id, l.\"check\", CASE WHEN n.p IS NULL THEN l.gold ELSE n.p >= 0.5 END AS gold, n.p IS NOT NULL AS was_ruled FROM labels_long l LEFT JOIN (SELECT * FROM scored WHERE model = 'new' AND p > 0.9) n ON l.id = n.id AND l.\"check\" = n.\"check\"")
def j10_adjudicated(spark, sf_dir):
    rulings = V.scored(spark, sf_dir).filter("model = 'new' and p > 0.9").select("id", "check", (F.col("p") >= 0.5).alias("gold"))
    return L.adjudicated(V.labels_long(spark, sf_dir), rulings)


# Aggregations --------------------------------------------------------------------------------------------------------
@query(R + "SELECT tracker, project, count(*) AS n FROM reports GROUP BY tracker, project")
def a1_counts(spark, sf_dir):
    return V.reports(spark, sf_dir).groupBy("tracker", "project").agg(F.count("*").alias("n"))


@query(CAND + "SELECT coalesce(tracker, 'total') AS tracker, count(*) AS n, round_even(quantile_cont(tokens, 0.5), 0)::BIGINT AS median, round_even(quantile_cont(tokens, 0.9), 0)::BIGINT AS p90, round_even(quantile_cont(tokens, 0.99), 0)::BIGINT AS p99, round(avg((tokens > 767)::INT), 6) AS over_767, round(avg((tokens > 895)::INT), 6) AS over_895 FROM (SELECT tracker, state_tokens AS tokens FROM candidates) GROUP BY ROLLUP (tracker)")
def a2_token_profile(spark, sf_dir):
    return _six(E.token_profile(V.candidates(spark, sf_dir).select("tracker", F.col("state_tokens").alias("tokens"))), "over_767", "over_895")


COUNTED = """counted AS (SELECT {by}, count(*) AS n, count(*) FILTER (gold = (p >= 0.5)) AS r, count(*) FILTER (NOT gold) AS no_n, count(*) FILTER (p < 0.5) AS said, count(*) FILTER (NOT gold AND p < 0.5) AS no_found, avg(greatest(p, 1 - p)) AS conf FROM scored GROUP BY {by}),
  bins AS (SELECT {by}, least(floor(greatest(p, 1 - p) * 10), 9) AS b, abs(sum(greatest(p, 1 - p)) - count(*) FILTER (gold = (p >= 0.5))) AS gap FROM scored GROUP BY ALL),
  gaps AS (SELECT {by}, sum(gap) AS gap FROM bins GROUP BY {by})"""
WILSON = "round(CASE WHEN {n} > 0 THEN {clamp}((({h}::DOUBLE / {n}) + 3.8416 / (2 * {n})) / (1 + 3.8416 / {n}) {sign} 1.96 * sqrt(({h}::DOUBLE / {n}) * (1 - {h}::DOUBLE / {n}) / {n} + 3.8416 / (4.0 * {n} * {n})) / (1 + 3.8416 / {n})) END, 6)"


def _wilson_sql(h: str, n: str, low: bool) -> str:
    return WILSON.format(h=h, n=n, sign="-" if low else "+", clamp="greatest(0.0, " if low else "least(1.0, ").replace("greatest(0.0, (", "greatest(0.0, ").replace("least(1.0, (", "least(1.0, ")


_by = 'model, "check"'


@query(SCO + ", " + COUNTED.format(by=_by) + f""" SELECT {_by}, n, round(r / n, 6) AS accuracy, {_wilson_sql('r', 'n', True)} AS accuracy_low, {_wilson_sql('r', 'n', False)} AS accuracy_high, no_n, no_found,
  round(no_found / nullif(no_n, 0), 6) AS recall_no, {_wilson_sql('no_found', 'no_n', True)} AS recall_low, {_wilson_sql('no_found', 'no_n', False)} AS recall_high, round(no_found / nullif(said, 0), 6) AS precision_no, round(conf, 6) AS mean_confidence, round(gap / n, 6) AS ece FROM counted JOIN gaps USING ({_by})""")
def a3_a4_a5_metrics(spark, sf_dir):
    return _six(E.check_metrics(V.scored(spark, sf_dir)), "accuracy", "accuracy_low", "accuracy_high", "recall_no", "recall_low", "recall_high", "precision_no", "mean_confidence", "ece")


@query(SCO + f"SELECT {_by}, count(*) AS n, count(*) FILTER (NOT gold) AS no_n, count(*) FILTER (NOT gold AND v = 'missing') AS no_said_no, count(*) FILTER (NOT gold AND v = 'unsure') AS no_unsure, count(*) FILTER (NOT gold AND v = 'present') AS no_said_yes, count(*) FILTER (gold AND v = 'missing') AS yes_said_no, round(count(*) FILTER (v <> 'unsure') / count(*), 6) AS coverage, round(count(*) FILTER (v <> 'unsure' AND gold = (v = 'present')) / nullif(count(*) FILTER (v <> 'unsure'), 0), 6) AS accuracy_decided FROM (SELECT *, {VERDICT} AS v FROM scored) GROUP BY {_by}")
def a6_bot_view(spark, sf_dir):
    return _six(E.bot_view(V.scored(spark, sf_dir), 0.827), "coverage", "accuracy_decided")


@query()
def r26_cleaned_rows(spark, sf_dir):
    """Public rows as they are assembled: of the cleaned text."""
    return I.cleaned_public_row(V.reports(spark, sf_dir))


@query()
def a7_bot_counts(spark, sf_dir):
    return D.bot_counts(D.decided(_wide(spark, sf_dir)))


@query(SCO + f"SELECT {_by}, round(coalesce(count(*) FILTER (gold AND p < 0.5) / nullif(count(*) FILTER (gold), 0), 0), 6) AS false_missing FROM scored GROUP BY {_by}")
def a8_false_missing(spark, sf_dir):
    return _six(E.false_missing(V.scored(spark, sf_dir)), "false_missing")


@query(SCO + f"SELECT model, \"check\", count(*) AS n, round(count(*) FILTER (gold = (p >= 0.5)) / count(*), 6) AS accuracy FROM (SELECT model, id, \"check\", gold, p FROM scored UNION ALL SELECT 'always_yes', id, \"check\", gold, 1.0 FROM labels_long) GROUP BY {_by}")
def a9_always_yes(spark, sf_dir):
    s = E.with_always_yes(V.scored(spark, sf_dir).select("model", "id", "check", "gold", "p"))
    return _six(E.check_metrics(s), "accuracy").select("model", "check", "n", "accuracy")


@query(SCO + "SELECT \"check\", count(*) AS n, count(*) FILTER (gold = l) AS agree, CASE WHEN count(*) FILTER (gold) < count(*) FILTER (NOT gold) THEN 'yes' ELSE 'no' END AS minority, least(count(*) FILTER (gold), count(*) FILTER (NOT gold)) AS minority_n, CASE WHEN count(*) FILTER (gold) < count(*) FILTER (NOT gold) THEN count(*) FILTER (gold AND l) ELSE count(*) FILTER (NOT gold AND NOT l) END AS minority_agree, count(*) FILTER (gold = l) >= 0.85 * count(*) AS passes FROM (SELECT *, p >= 0.5 AS l FROM scored WHERE model = 'old') GROUP BY \"check\"")
def a10_agreement(spark, sf_dir):
    old = V.scored(spark, sf_dir).filter("model = 'old'")
    return L.agreement(old.select("id", "check", "gold"), old.select("id", "check", (F.col("p") >= 0.5).alias("gold")))


@query(LAB + 'SELECT tag AS "set", "check", round(avg(gold::INT), 6) AS share_yes, count(*) AS n FROM labels_long GROUP BY tag, "check"')
def a11_balance(spark, sf_dir):
    return _six(L.balance(V.labels_long(spark, sf_dir).withColumnRenamed("tag", "set")), "share_yes")


_slices = "CASE WHEN \"check\" IS NOT NULL THEN 'check' WHEN tag IS NOT NULL THEN 'tag' ELSE 'overall' END AS slice, coalesce(\"check\", tag, 'all') AS key"


@query(SCO + f""", s AS (SELECT *, greatest(p, 1 - p) AS c, (gold = (p >= 0.5))::INT AS ok FROM scored WHERE model = 'new'),
  g AS (SELECT {_slices}, count(*) AS n, avg(ok) AS accuracy, avg(c) AS conf, avg((p - gold::INT) * (p - gold::INT)) AS brier FROM s GROUP BY GROUPING SETS ((), ("check"), (tag))),
  b AS (SELECT {_slices}, b, abs(sum(c) - sum(ok)) AS gap FROM (SELECT *, least(floor(c * 10), 9) AS b FROM s) GROUP BY GROUPING SETS ((b), ("check", b), (tag, b)))
  SELECT g.slice, g.key, n, round(accuracy, 6) AS accuracy, round(conf, 6) AS mean_confidence, round(e.gap / n, 6) AS ece, round(brier, 6) AS brier FROM g JOIN (SELECT slice, key, sum(gap) AS gap FROM b GROUP BY ALL) e ON g.slice = e.slice AND g.key = e.key""")
def a12_sliced(spark, sf_dir):
    return _six(E.sliced(V.scored(spark, sf_dir).filter("model = 'new'")), "accuracy", "mean_confidence", "ece", "brier")


@query(SCO + """, s AS (SELECT "check", round(greatest(p, 1 - p), 6) AS c, (gold <> (p >= 0.5))::INT AS bad FROM scored WHERE model = 'new'),
  r AS (SELECT "check", c, count(*) OVER w AS rows, sum(bad) OVER w AS errors, count(*) OVER (PARTITION BY "check") AS total FROM s WINDOW w AS (PARTITION BY "check" ORDER BY c DESC)),
  x AS (SELECT DISTINCT * FROM r)
  SELECT "check", max(total) AS n, round(1 - arg_min(errors / rows, rows) FILTER (rows >= ceil(0.5 * total)), 6) AS accuracy_50, round(1 - arg_min(errors / rows, rows) FILTER (rows >= ceil(0.8 * total)), 6) AS accuracy_80 FROM x GROUP BY "check\"""")
def a13_selective_accuracy(spark, sf_dir):
    return _six(E.risk_coverage(V.scored(spark, sf_dir).filter("model = 'new'")).drop("aurc"), "accuracy_50", "accuracy_80")


@query()
def a13_risk_coverage(spark, sf_dir):
    return _six(E.risk_coverage(V.scored(spark, sf_dir).filter("model = 'new'")), "aurc", "accuracy_50", "accuracy_80")


@query(R + """, rows AS (SELECT r.*, CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'eval' END AS "set" FROM reports r, generate_series(1, CASE WHEN doc_id % 200 = 3 THEN 2 ELSE 1 END) WHERE doc_id % 150 <> 7)
  SELECT 'broken' AS rule, '{broken ' || doc_id AS key, NULL AS detail FROM reports WHERE doc_id % 150 = 7 UNION ALL SELECT 'unexpected field', id, 'note' FROM rows WHERE doc_id % 50 = 1
  UNION ALL SELECT 'missing field', id, 'project' FROM rows WHERE doc_id % 60 = 5 UNION ALL SELECT 'blank', id, 'description' FROM rows WHERE doc_id % 97 = 0 UNION ALL SELECT DISTINCT 'duplicate', id, '2' FROM rows WHERE doc_id % 200 = 3
  UNION ALL SELECT 'count', "set" || '/public', count(*)::VARCHAR FROM rows GROUP BY "set" HAVING "set" = 'eval' UNION ALL SELECT 'count', 'style/synthetic', '0'
  UNION ALL SELECT 'shared project', concat_ws('/', tracker, p), count(DISTINCT "set")::VARCHAR FROM (SELECT *, CASE WHEN doc_id % 60 <> 5 THEN project END AS p FROM rows) GROUP BY tracker, p HAVING count(DISTINCT "set") > 1""")
def a14_set_problems(spark, sf_dir):
    """Every rule over raw JSON lines, in which fields are added, left out, blank and repeated; only the train set has its size."""
    n = F.col("doc_id")
    r = V.reports(spark, sf_dir).withColumn("set", F.when(n % 2 == 0, "train").otherwise("eval"))
    row = F.struct("id", "source", "tracker", F.when(n % 60 != 5, F.col("project")).alias("project"), "summary", "description", F.when(n % 50 == 1, F.struct(n.alias("of"))).alias("note"), F.when(n % 9 == 1, True).alias("core"))
    raw = F.when(n % 150 == 7, F.concat(F.lit("{broken "), n.cast("string"))).otherwise(F.to_json(row))
    lines = r.select("set", n, raw.alias("raw"))
    twice = lines.filter((n % 200 == 3) & (n % 150 != 7))
    lines = lines.unionByName(twice).drop("doc_id")
    train = r.filter("set = 'train'").filter(n % 150 != 7).count()
    return L.raw_set_problems(lines, {("train", "public"): train, ("eval", "public"): 1, ("style", "synthetic"): 2})


_broken = " UNION ALL ".join(
    [
        "SELECT 'broken' AS rule, 'line ' || doc_id AS key FROM a WHERE doc_id % 20 = 1",
        "SELECT 'missing key', id || ':actual' FROM a WHERE doc_id % 20 = 2",
        "SELECT 'extra key', id || ':other' FROM a WHERE doc_id % 20 = 3",
        "SELECT 'not boolean', id || ':steps' FROM a WHERE doc_id % 20 = 4",
        "SELECT 'missing id', id FROM a WHERE doc_id % 20 IN (1, 5)",
    ]
)


@query(R + f", a AS (SELECT * FROM reports) {_broken}")
def a15_answer_problems(spark, sf_dir):
    n = F.col("doc_id") % 20
    value = {c: F.lit(f'"{c}": true') for c in L.CHECKS}
    value["steps"] = F.when(n == 4, '"steps": "maybe"').otherwise('"steps": true')
    value["actual"] = F.when(n != 2, '"actual": true')
    answer = F.concat(F.lit('{"id": "'), F.col("id"), F.lit('", '), F.concat_ws(", ", *value.values(), F.when(n == 3, '"other": true')), F.lit("}"))
    r = V.reports(spark, sf_dir)
    answers = r.filter(n != 5).select(F.col("doc_id").alias("line"), F.when(n == 1, "{broken").otherwise(answer).alias("answer"))
    return L.answer_problems(answers, r.select("id"))


@query("SELECT 'V' || c.c AS code, count(user_id) AS n FROM generate_series(0, 40) AS c(c) LEFT JOIN events ON user_id % 40 = c.c GROUP BY c.c HAVING count(user_id) < 300")
def a16_a17_coverage(spark, sf_dir):
    """Variation codes that too few specs have; V40 is in none."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.array(F.concat(F.lit("V"), (F.col("user_id") % 40).cast("string"))).alias("codes"))
    return L.thin_codes(e, tuple(f"V{i}" for i in range(41)), 300)


_MADE = """made AS (SELECT 'syn-' || item_id AS id, item_id AS n FROM benchmark)"""


@query(f"""WITH {_MADE} SELECT 'missing id' AS rule, id, NULL AS found FROM made WHERE n % 10 = 0 UNION ALL SELECT 'duplicate id', id, '2' FROM made WHERE n % 10 = 1
  UNION ALL SELECT 'blank', id, 'summary' FROM made WHERE n % 10 = 2 UNION ALL SELECT 'host', id, 'evil.example.org' FROM made WHERE n % 10 = 3
  UNION ALL SELECT 'code', id, 'X13' FROM made WHERE n % 10 = 4 UNION ALL SELECT 'foreign id', 'odd-' || n, NULL FROM made WHERE n % 10 = 5""")
def a16_record_problems(spark, sf_dir):
    """Generated records of the benchmark's passages, a fault in six of ten."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    n, kind = F.col("item_id"), F.col("item_id") % 10
    own = F.concat(F.when(kind == 5, "odd-").otherwise("syn-"), n.cast("string"))
    tail = F.when(kind == 3, " see https://evil.example.org/a").when(kind == 4, " as X13 says").otherwise(" see https://docs.example.com/a")
    records = b.filter(kind != 0).select(own.alias("id"), F.when(kind == 2, " ").otherwise("A title").alias("summary"), F.concat("text", tail).alias("description"), F.explode(F.when(kind == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    specs = b.filter(kind != 5).select(F.concat(F.lit("syn-"), n.cast("string")).alias("id"))
    return L.record_problems(specs, records.drop("copy"), ("example.com",), ("X13", "X14"))


@query(CAND + "SELECT tracker, CASE WHEN tokens <= 60 THEN 0 WHEN tokens <= 250 THEN 1 WHEN tokens <= 767 THEN 2 ELSE 3 END AS bucket, count(*) AS n, count(DISTINCT project) AS projects FROM candidates GROUP BY ALL")
def a18_sample_report(spark, sf_dir):
    c = V.candidates(spark, sf_dir).withColumn("bucket", F.coalesce(S.length_bucket(F.col("tokens")), F.lit(3)))
    return c.groupBy("tracker", "bucket").agg(F.count("*").alias("n"), F.countDistinct("project").alias("projects"))


@query(CAND + f"""SELECT id, c."check", max({V.u_sql('w', "c.\"check\" || '|' || id || '|' || w.w || '|' || array_to_string(t[w.w * 639 + 1 : w.w * 639 + 767], ' ')")}) AS p, count(*) AS windows
  FROM (SELECT id, state_tokens AS tokens, regexp_extract_all({V.STATE}, '[^ \\t\\n\\r\\f\\v]+') AS t FROM candidates) x, (VALUES ('steps'), ('actual')) AS c("check"), generate_series(0, 20) AS w(w) WHERE w.w < greatest(ceil((tokens - 128) / 639), 1) GROUP BY ALL""")
def a19_f1_f3_window_scores(spark, sf_dir):
    """Windows of the JSON states by token offsets, scored one by one by a stub that reads a window's text, rolled up."""
    c = V.candidates(spark, sf_dir).select("id", X.state_json().alias("json"))
    each = c.withColumn("t", X.tokenized(F.col("json"))).select("id", "json", F.posexplode("t.windows").alias("window", "w"))
    text = F.regexp_replace(F.substring(F.col("json"), F.col("w.begin") + 1, F.col("w.end") - F.col("w.begin")), r"[ \t\n\r\f\x0B]+", " ")
    asked = each.select("id", "window", text.alias("text"), F.explode(F.array(F.lit("steps"), F.lit("actual"))).alias("check"))
    return D.window_rollup(asked.withColumn("p", S.u("w", F.concat_ws("|", "check", "id", F.col("window").cast("string"), "text"))))


def _stub_predictor():
    """A predictor that reads the text only: its length and its md5 give the chances."""
    import hashlib

    def predict(pdf):
        chance = [int(hashlib.md5((t or "").encode()).hexdigest()[:12], 16) / (1 << 48) for t in pdf["text"]]
        return pdf.assign(p=chance)[["id", "p"]]

    return predict


@query(CAND + "SELECT id, ('0x' || substr(md5(description), 1, 12))::BIGINT / 281474976710656.0 AS p FROM candidates")
def f1_scored_batches(spark, sf_dir):
    text = V.candidates(spark, sf_dir).select("id", F.col("description").alias("text"))
    return D.scored_batches(text, _stub_predictor, "id string, p double")


@query(R + "SELECT id, 7 AS questions, 'noul' AS kind FROM reports")
def f4_question_rows(spark, sf_dir):
    r = V.reports(spark, sf_dir).select("id", L.questions().alias("q"))
    return r.select("id", F.size("q").alias("questions"), F.col("q")["steps"]["type"].alias("kind"))


@query(CAND + "SELECT id, state_tokens AS tokens FROM candidates")
def f2_token_lengths(spark, sf_dir):
    """Tokens of the JSON state by the helper, with the tokenizer of blanks; files of the tokenizers library go the same way."""
    c = V.candidates(spark, sf_dir).select("id", X.state_json().alias("json"))
    return c.select("id", X.tokenized(F.col("json"))["tokens"].alias("tokens"))


# Samples -------------------------------------------------------------------------------------------------------------
def _u(seed: str, key: str = "id") -> str:
    return V.u_sql(seed, key)


@query(CAND + f"SELECT id FROM candidates WHERE {_u(SEED)} < 0.05")
def w1_bernoulli(spark, sf_dir):
    return S.bernoulli(V.candidates(spark, sf_dir), 0.05, SEED).select("id")


QUOTA = """, c AS (SELECT tracker, count(*) AS n FROM candidates GROUP BY tracker), f AS (SELECT tracker, n, round({t} * sqrt(n) / sum(sqrt(n)) OVER (), 9) AS fair FROM c),
  q AS (SELECT tracker, n, (floor(fair) + CASE WHEN row_number() OVER (ORDER BY round(fair - floor(fair), 9) DESC, tracker) <= {t} - sum(floor(fair)) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM f)"""


@query(CAND + QUOTA.format(t=110) + " SELECT tracker, n, quota FROM q")
def w2_quotas(spark, sf_dir):
    return S.quota_table(V.candidates(spark, sf_dir), 110)


@query(CAND + f""", s AS (SELECT tracker, project, count(*) AS n FROM candidates GROUP BY ALL), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY tracker ORDER BY {_u(SEED, "tracker || '|' || project")}, project ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(n) OVER (PARTITION BY tracker) AS total, row_number() OVER (PARTITION BY tracker ORDER BY {_u(SEED, "tracker || '|' || project")}, project) AS nth, count(*) OVER (PARTITION BY tracker) AS projects FROM s)
  SELECT tracker, project, n FROM r WHERE before < 0.3 * total AND nth < projects""")
def w3_eval_projects(spark, sf_dir):
    return S.eval_projects(V.candidates(spark, sf_dir), 0.3, SEED)


_weight = f"pow({_u(SEED)}, CASE WHEN rare THEN 1.0 / 3 ELSE 1.0 END)"


@query(CAND + f"SELECT id, tracker FROM candidates QUALIFY row_number() OVER (PARTITION BY tracker ORDER BY {_weight} DESC, id) <= 5")
def w4_weighted_pick(spark, sf_dir):
    return S.weighted_pick(V.candidates(spark, sf_dir), ["tracker"], 5, SEED).select("id", "tracker")


@query(CAND + QUOTA.format(t=110) + """, b AS (SELECT c.*, quota, CASE WHEN tokens <= 60 THEN 0 WHEN tokens <= 250 THEN 1 WHEN tokens <= 767 THEN 2 END AS bucket FROM candidates c JOIN q USING (tracker)),
  """ + f"""m AS (SELECT *, coalesce(row_number() OVER (PARTITION BY tracker, bucket ORDER BY {_weight} DESC, id) <= CASE bucket WHEN 0 THEN round_even(quota * 0.3, 0) WHEN 2 THEN round_even(quota * 0.3, 0) WHEN 1 THEN quota - 2 * round_even(quota * 0.3, 0) END, false) AS ok FROM b),
  t AS (SELECT *, quota - sum(ok::INT) OVER (PARTITION BY tracker) AS short, row_number() OVER (PARTITION BY tracker, ok ORDER BY pow({_u(SEED + '+')}, CASE WHEN rare THEN 1.0 / 3 ELSE 1.0 END) DESC, id) AS nth FROM m)
  SELECT id, tracker, coalesce(bucket, 3) AS bucket FROM t WHERE ok OR nth <= short""")
def w5_stratified_pick(spark, sf_dir):
    c = V.candidates(spark, sf_dir)
    return S.stratified_pick(c, S.quota_table(c, 110), SEED).select("id", "tracker", F.coalesce("bucket", F.lit(3)).alias("bucket"))


@query()
def w6_w7_sample(spark, sf_dir):
    return S.sample(V.candidates(spark, sf_dir), (60, 30, 10), SEED).select("id", "tracker", "project", "part")


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that fit, without a label and outside the projects held for eval."""
    c = V.candidates(spark, sf_dir)
    used = V.reports(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id"), "doc_id", "left_semi")
    free = S.without_used(c.filter(F.col("tokens") <= S.ROOM), used, S.eval_projects(c, 0.3, SEED))
    return free.select("id", "tracker", rules.likely_missing(F.col("summary"), F.col("description")).alias("missing"), F.col("summary").rlike(rules.TASK_START).alias("task"), rules.ordinary_gap(F.col("summary"), F.col("description"), F.col("tokens")).alias("gap"))


POOL = f"""s AS (SELECT tracker, project, count(*) AS n FROM candidates GROUP BY ALL), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY tracker ORDER BY {_u(SEED, "tracker || '|' || project")}, project ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(n) OVER (PARTITION BY tracker) AS total, row_number() OVER (PARTITION BY tracker ORDER BY {_u(SEED, "tracker || '|' || project")}, project) AS nth, count(*) OVER (PARTITION BY tracker) AS projects FROM s),
  pool AS (SELECT *, regexp_matches(summary, {TASK}) AS task, regexp_matches(summary, {TASK}) OR rtrim(summary) LIKE '%?' OR NOT regexp_matches(summary || chr(10) || description, '(?i)\\b(?:expect\\w*|should|instead|supposed|must|correct(?:ly)?)\\b') AS rich FROM candidates
    WHERE tokens <= 767 AND id NOT IN (SELECT id FROM labels JOIN reports USING (doc_id)) AND (tracker, project) NOT IN (SELECT (tracker, project) FROM r WHERE before < 0.3 * total AND nth < projects))"""


@query(CAND + f""", {POOL}, a AS (SELECT id, task, rich, {_u(SEED)} AS u, row_number() OVER (PARTITION BY rich ORDER BY {_u(SEED)}, id) AS n FROM pool), b AS (SELECT *, CASE WHEN rich AND n <= 40 THEN 'train' WHEN rich AND n <= 60 THEN 'dev_enriched' END AS part FROM a),
  c AS (SELECT *, row_number() OVER (PARTITION BY part IS NULL ORDER BY u, id) AS m FROM b), d AS (SELECT id, task, u, coalesce(part, CASE WHEN m <= 20 THEN 'dev_plain' END) AS part FROM c),
  e AS (SELECT *, row_number() OVER (PARTITION BY part IS NULL AND task ORDER BY u, id) AS k FROM d) SELECT id, coalesce(part, 'mine') AS part FROM e WHERE part IS NOT NULL OR task AND k <= 30""")
def w8_top_up(spark, sf_dir):
    return S.top_up(_pool(spark, sf_dir), (40, 20, 20, 30), SEED, F.col("task")).select("id", "part")


@query(CAND + f", {POOL}, found AS (SELECT * FROM pool WHERE {GAP})" + QUOTA.format(t=80).replace("FROM candidates", "FROM found") + f" SELECT id, tracker FROM found JOIN q USING (tracker) QUALIFY row_number() OVER (PARTITION BY tracker ORDER BY {_u(SEED)}, id) <= quota")
def w9_gap_mining_ordinary(spark, sf_dir):
    """Candidates that fit, are not used and show an ordinary gap, by quotas of what is left."""
    c = _pool(spark, sf_dir).filter("gap")
    return S.by_quota(c, S.quota_table(c, 80), SEED).select("id", "tracker")


@query(CAND + QUOTA.format(t=80) + f" SELECT id, tracker FROM candidates JOIN q USING (tracker) QUALIFY row_number() OVER (PARTITION BY tracker ORDER BY {_u(SEED)}, id) <= quota")
def w9_gap_mining(spark, sf_dir):
    c = V.candidates(spark, sf_dir)
    return S.by_quota(c, S.quota_table(c, 80), SEED).select("id", "tracker")


@query(CAND + f"SELECT id, CASE WHEN row_number() OVER (ORDER BY {_u(SEED)}, id) <= round_even(count(*) OVER () * 2 / 3, 0) THEN 'train' ELSE 'dev' END AS part FROM candidates")
def w10_two_thirds(spark, sf_dir):
    return S.split_two_thirds(V.candidates(spark, sf_dir), SEED).select("id", "part")


@query(ORACLES["w10_two_thirds"])
def w10_two_thirds_whole(spark, sf_dir):
    """The same split; both take all candidates."""
    return w10_two_thirds(spark, sf_dir)


@query(f"WITH {V.REPORTS}, {V.CANDIDATES}, {V.LABELS} SELECT id, CASE WHEN row_number() OVER (ORDER BY {_u(SEED)}, id) <= round_even(count(*) OVER () * 2 / 3, 0) THEN 'train' ELSE 'dev' END AS part FROM candidates JOIN labels_long USING (id) WHERE \"check\" = 'actual' AND NOT gold")
def w10_mined(spark, sf_dir):
    """The split of mined rows: only those that the labels found without an actual result."""
    return S.split_mined(V.candidates(spark, sf_dir), V.labels_long(spark, sf_dir), SEED).select("id", "part")


@query(CAND + f"SELECT id, row_number() OVER (PARTITION BY tokens <= 767 ORDER BY {_u(SEED)}, id) <= CASE WHEN tokens <= 767 THEN 90 ELSE 10 END AS core FROM candidates")
def w11_core_flags(spark, sf_dir):
    return S.core_flags(V.candidates(spark, sf_dir), 90, 10, SEED).select("id", "core")


def _w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = V.labels_long(spark, sf_dir).groupBy("id").agg(F.max(F.when(F.col("check") == "actual", F.col("gold"))).alias("actual"), F.max(F.when(F.col("check") == "expected", F.col("gold"))).alias("expected"), F.first("tag").alias("tag"))
    return wide.withColumn("core", F.col("tag") == "core").drop("tag")


@query(LAB + f""", w AS (SELECT id, max(gold) FILTER ("check" = 'actual') AS actual, max(gold) FILTER ("check" = 'expected') AS expected, any_value(tag) = 'core' AS core FROM labels_long GROUP BY id),
  k AS (SELECT id, CASE WHEN core THEN 'core' WHEN NOT actual THEN 'actual' WHEN NOT expected THEN 'expected' END AS kind FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {_u(SEED)}, id) AS nth FROM k WHERE kind IS NOT NULL),
  t AS (SELECT *, CASE WHEN kind = 'core' THEN 0 WHEN kind = 'actual' AND nth <= 10 THEN 1 WHEN kind = 'expected' THEN 2 ELSE 3 END AS tier FROM r)
  SELECT id, tier FROM t WHERE tier = 0 UNION ALL (SELECT id, tier FROM t WHERE tier > 0 ORDER BY tier, nth LIMIT 20)""")
def w12_priority_fill(spark, sf_dir):
    return S.priority_fill(_w12(spark, sf_dir), 20, SEED).select("id", "tier")


@query()
def w13_gate_rows_cleaned(spark, sf_dir):
    """Short by their cleaned state, by chance, and in the table's order."""
    short = D.short_reports(cleanup.clean_reports(V.reports(spark, sf_dir)))
    return S.top_by_chance(short, 40, SEED).orderBy("doc_id").select("doc_id", "id")


@query()
def r23_short_states(spark, sf_dir):
    return D.short_reports(cleanup.clean_reports(V.reports(spark, sf_dir))).select("id")


@query(R + f"SELECT id FROM reports WHERE length(summary) + length(description) <= 700 ORDER BY {_u(SEED)}, id LIMIT 40")
def w13_gate_rows(spark, sf_dir):
    short = V.reports(spark, sf_dir).filter(F.length("summary") + F.length("description") <= 700)
    return S.top_by_chance(short, 40, SEED).select("id")


@query(CAND + f"SELECT id, {_u(SEED)} AS place FROM candidates ORDER BY 2")
def w14_shuffled(spark, sf_dir):
    return V.candidates(spark, sf_dir).select("id", S.u(SEED, F.col("id")).alias("place")).orderBy("place", "id")


@query(CAND + f"SELECT id FROM candidates ORDER BY {_u(SEED)}, id LIMIT 50")
def w15_uniform(spark, sf_dir):
    return S.top_by_chance(V.candidates(spark, sf_dir), 50, SEED).select("id")


# Sets, gates, streams ------------------------------------------------------------------------------------------------
@query(R + "SELECT CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'eval' END AS \"set\", id, summary FROM reports UNION ALL SELECT CASE WHEN item_id % 4 = 0 THEN 'style' ELSE 'train' END, CASE WHEN item_id % 4 = 0 THEN 'syn-style-' ELSE 'syn-train-' END || item_id, substr(text, 1, 40) FROM benchmark")
def u1_u4_assembled(spark, sf_dir):
    public = V.reports(spark, sf_dir).select(F.when(F.col("doc_id") % 2 == 0, "train").otherwise("eval").alias("set"), "id", "summary")
    prefix = F.when(F.col("item_id") % 4 == 0, "syn-style-").otherwise("syn-train-")
    generated = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.concat(prefix, F.col("item_id").cast("string")).alias("id"), F.substring("text", 1, 40).alias("summary"))
    return L.assembled(public, generated)


@query(SCO + ", " + COUNTED.format(by=_by) + f""", m AS (SELECT {_by}, coalesce(no_found / nullif(no_n, 0), 0) AS recall, coalesce(no_found / nullif(said, 0), 0) AS prec, gap / n AS ece FROM counted JOIN gaps USING ({_by})),
  fm AS (SELECT {_by}, coalesce(count(*) FILTER (gold AND p < 0.5) / nullif(count(*) FILTER (gold), 0), 0) AS f FROM scored WHERE id IN (SELECT id FROM labels_long WHERE tag = 'core') GROUP BY {_by}),
  j AS (SELECT a."check", a.recall - b.recall AS recall, a.prec - b.prec AS prec, b.ece - a.ece AS ece, coalesce(fb.f, 0) - coalesce(fa.f, 0) AS risen FROM m a JOIN m b ON a."check" = b."check" AND a.model = 'new' AND b.model = 'old'
    LEFT JOIN fm fa ON fa."check" = a."check" AND fa.model = 'new' LEFT JOIN fm fb ON fb."check" = a."check" AND fb.model = 'old')
  SELECT "check", 'recall missing did not rise' AS reason FROM j WHERE "check" IN ('expected', 'actual') AND recall >= 0
  UNION ALL SELECT "check", 'recall_no fell by ' || printf('%.1f', 100 * recall) || ' points' FROM j WHERE recall > 0.05 UNION ALL SELECT "check", 'precision_no fell by ' || printf('%.1f', 100 * prec) || ' points' FROM j WHERE prec > 0.05
  UNION ALL SELECT "check", 'false missing on present rose by ' || printf('%.1f', 100 * risen) || ' points' FROM j WHERE risen > 0.05
  UNION ALL SELECT "check", 'ECE rose by ' || printf('%.3f', ece) FROM j WHERE "check" IN ('steps', 'expected', 'actual', 'build_version') AND ece > 0.03""")
def g1_model_gate(spark, sf_dir):
    """The older model as the one that wants to replace the newer, which is better: the gate has reasons to give."""
    s = V.scored(spark, sf_dir)
    side = lambda m: s.filter(F.col("model") == m)
    core = V.labels_long(spark, sf_dir).filter("tag = 'core'").select("id").distinct()
    return E.model_gate(side("new"), side("old"), core)


BOT = f"""bot AS (SELECT model, "check", count(*) FILTER (v <> 'unsure') AS decided, count(*) FILTER (v <> 'unsure' AND gold <> (v = 'present')) AS wrong, count(*) FILTER (NOT gold AND v = 'missing') AS missing_found FROM (SELECT *, {VERDICT} AS v FROM scored) GROUP BY ALL)"""


def _bot(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    v = V.scored(spark, sf_dir).filter(F.col("model") == model).withColumn("v", D.verdict(F.col("p"), 0.827))
    return v.groupBy("check").agg(F.count_if(F.col("v") != "unsure").alias("decided"), F.count_if((F.col("v") != "unsure") & (F.col("gold") != (F.col("v") == "present"))).alias("wrong"), F.count_if(~F.col("gold") & (F.col("v") == "missing")).alias("missing_found"))


@query(SCO + f""", {BOT}, u AS (SELECT a."check", m.metric, CASE m.metric WHEN 'decided' THEN a.decided WHEN 'wrong' THEN a.wrong ELSE a.missing_found END AS was, CASE m.metric WHEN 'decided' THEN b.decided WHEN 'wrong' THEN b.wrong ELSE b.missing_found END AS now
  FROM bot a JOIN bot b ON a."check" = b."check", (VALUES ('decided'), ('wrong'), ('missing_found')) AS m(metric) WHERE a.model = 'new' AND b.model = 'old')
  SELECT "check", metric, was, now, CASE WHEN metric = 'wrong' THEN now - was ELSE was - now END AS worse_by FROM u WHERE CASE WHEN metric = 'wrong' THEN now - was ELSE was - now END >= 2""")
def g2_regressions(spark, sf_dir):
    return E.regressions(_bot(spark, sf_dir, "old"), _bot(spark, sf_dir, "new"))


@query(SCO + f', {BOT} SELECT a."check", a.decided AS decided_was, a.wrong AS wrong_was, a.missing_found AS missing_found_was, b.decided AS decided_now, b.wrong AS wrong_now, b.missing_found AS missing_found_now FROM bot a JOIN bot b ON a."check" = b."check" WHERE a.model = \'old\' AND b.model = \'new\'')
def g3_summary(spark, sf_dir):
    return E.summary(_bot(spark, sf_dir, "new"), _bot(spark, sf_dir, "old"))


@query(SCO + f", {BOT} SELECT \"check\", decided, wrong, missing_found, 'published' AS state FROM bot WHERE model = 'new' UNION ALL SELECT DISTINCT a.\"check\", b.decided, b.wrong, b.missing_found, 'held back' FROM bot a JOIN bot b ON a.\"check\" = b.\"check\" WHERE a.model = 'new' AND b.model = 'old' AND (a.decided - b.decided >= 2 OR b.wrong - a.wrong >= 2 OR a.missing_found - b.missing_found >= 2)")
def g3_refreshed(spark, sf_dir):
    """The older model's counts are the baseline, the newer's replace them; when the older's come back, the audit holds them back."""
    path = shared_folder(spark, "baseline")
    old, new = _bot(spark, sf_dir, "old"), _bot(spark, sf_dir, "new")
    E.refresh(old, path)
    E.refresh(new, path)
    held = E.publish(old, path).select("check").distinct()
    stands = E.baseline(spark, path).withColumn("state", F.lit("published"))
    return stands.unionByName(old.join(held, "check", "left_semi").withColumn("state", F.lit("held back")))


def _stub(text: Column) -> dict[str, Column]:
    """Chances from the text's md5 alone, so that SQL has the same."""
    return {c: S.u(c, text) for c in L.CHECKS}


def _flow_sql(settings: D.Settings) -> str:
    """states, verdicts and comments of issue_events by the stub; their texts hold no rule's subject but a blank description."""
    fields = "'{\"summary\":' || to_json(summary) || ',\"description\":' || to_json(description) || ',\"state\":\"' || state || '\",\"settings\":\"" + str(settings).replace("'", "''") + "\"}'"
    verdict = "CASE WHEN greatest({p}, 1 - {p}) < " + str(settings.threshold) + " THEN 'unsure' WHEN {p} >= 0.5 THEN 'present' ELSE 'missing' END"
    said = {c: verdict.format(p=V.u_sql(c, "txt")) for c in L.CHECKS}
    said["steps"] = f"CASE WHEN description = '' THEN 'missing' ELSE {said['steps']} END"
    text = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    some = lambda cases: "list_filter([" + ", ".join(cases) + "], lambda x: x IS NOT NULL)"
    missing = some([f"CASE WHEN {c} = 'missing' THEN {text(f'- **{D.NAMES[c]}**: {D.ADVICE[c]}')} END" for c in D.BLOCKERS])
    unsure = some([f"CASE WHEN {c} = 'unsure' THEN '**{D.NAMES[c]}**' END" for c in D.BLOCKERS])
    hints = some([f"CASE WHEN {c} = 'missing' THEN {text('- ' + t)} END" for c, t in D.HINTS.items()])
    return f"""states AS (SELECT repo, number, ts, event_id, state, description, substr(sha256({fields}), 1, 16) AS fp, summary || chr(10) || description AS txt FROM issue_events WHERE is_bug AND state IS NOT NULL),
  verdicts AS (SELECT *, {", ".join(f"{x} AS {c}" for c, x in said.items())} FROM states),
  lists AS (SELECT *, {missing} AS lacks, {unsure} AS unclear, {hints} AS hints, {" AND ".join(f"{c} = 'present'" for c in D.BLOCKERS)} AS complete FROM verdicts),
  flow AS (SELECT repo, number, ts, event_id, fp, complete, concat_ws(chr(10) || chr(10),
    CASE WHEN len(lacks) > 0 THEN '**This report lacks:**' || chr(10) || chr(10) || array_to_string(lacks, chr(10)) WHEN len(unclear) > 0 THEN '**Parts of this report are unclear.**' ELSE '✅ **Nothing is lacking here.**' END,
    CASE WHEN len(unclear) > 0 THEN 'Not sure about: ' || array_to_string(unclear, ', ') || '. Please check ' || CASE WHEN len(unclear) > 1 THEN 'them' ELSE 'it' END || ' yourself.' END,
    CASE WHEN len(hints) > 0 THEN '<details>' || chr(10) || '<summary>Suggestions (' || len(hints) || ')</summary>' || chr(10) || chr(10) || array_to_string(hints, chr(10)) || chr(10) || chr(10) || '</details>' END,
    '<sub>State at reading: ' || state || '.</sub>') AS comment FROM lists)"""


QUIET = D.Settings(success_comment=False)


_golds = " UNION ALL ".join(f"SELECT '{c}' AS \"check\", {c} AS v, {V.u_sql('gold-' + c, 'txt')} < 0.6 AS gold FROM verdicts" for c in L.CHECKS)


@query(EV + f""", {_flow_sql(QUIET)}, g AS ({_golds}) SELECT "check", count(*) AS n, count(*) FILTER (v <> 'unsure') AS decided, count(*) FILTER (v <> 'unsure' AND gold = (v = 'missing')) AS wrong, count(*) FILTER (NOT gold) AS missing_n,
  count(*) FILTER (NOT gold AND v = 'missing') AS missing_found, count(*) FILTER (gold AND v = 'missing') AS false_missing FROM g GROUP BY "check\"""")
def a7_state_counts(spark, sf_dir):
    """Counts after all decision rules, over the issue events' states, whose rules SQL can follow."""
    states = C.states(V.events(spark, sf_dir), QUIET)
    decided = D.decided(D.replayed(states, D.recorded(states, _stub)), QUIET)
    text = F.concat_ws("\n", "summary", "description")
    return D.bot_counts(decided.withColumns({f"gold_{c}": S.u(f"gold-{c}", text) < 0.6 for c in L.CHECKS}))


@query(EV + f""", {_flow_sql(QUIET)}, h AS (SELECT *, coalesce(max((NOT complete)::INT) OVER (PARTITION BY repo, number ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had, lag(fp) OVER (PARTITION BY repo, number ORDER BY ts, event_id) AS was FROM flow)
  SELECT repo, number, event_id, fp, complete, CASE WHEN had = 0 AND complete THEN 'silent' WHEN had = 0 THEN 'created' WHEN fp = was THEN 'skipped' ELSE 'updated' END AS action, comment FROM h""")
def t1_flow(spark, sf_dir):
    """Events to actions and comments: the stub's answers are recorded once a state and replayed."""
    events = V.events(spark, sf_dir)
    scores = D.recorded(C.states(events, QUIET), _stub)
    return C.actions(C.flow(events, scores, QUIET)).select("repo", "number", "event_id", "fp", "complete", "action", "comment")


@query(EV + f", {_flow_sql(QUIET)} SELECT repo, number, arg_max(fp, (ts, event_id)) AS fp, arg_max(comment, (ts, event_id)) AS comment FROM flow GROUP BY repo, number HAVING bool_or(NOT complete)")
def t1_t4_stream(spark, sf_dir):
    """The comments that stand after all events came as a stream, in a few micro-batches and in no order of time."""
    events, base = V.events(spark, sf_dir), shared_folder(spark, "stream")
    events.repartition(6, F.xxhash64("event_id")).write.parquet(f"{base}/events")
    D.recorded(C.states(events, QUIET), _stub).write.parquet(f"{base}/scores")  # once, not again in each micro-batch
    scores = spark.read.parquet(f"{base}/scores")
    incoming = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/events")
    out = C.stream_flow(incoming, C.replay(scores), QUIET).writeStream.foreachBatch(C.upsert_comments(f"{base}/comments", 2))
    run = out.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return C.current_comments(spark.read.parquet(f"{base}/comments")).select("repo", "number", "fp", "comment")


@query(EV + f"SELECT event_id, {V.u_sql('steps', V.STATE)} AS p_steps, 1 AS windows, 0 AS scored_again FROM issue_events WHERE is_bug AND state IS NOT NULL")
def s7_replay(spark, sf_dir):
    """Answers of a part of the states are recorded, then of the others only; a third run scores none, and all is replayed."""
    states = C.states(V.events(spark, sf_dir), D.Settings())
    store = X.AnswerStore(spark, shared_folder(spark, "answers"), "stub", {"settings": str(D.Settings())})
    score = lambda rows: rows.withColumns({f"p_{c}": p for c, p in _stub(F.col("text")).items()})
    store.update(states.filter("state = 'Open'"), score)
    store.update(states, score)
    again = store.update(states, score)
    return store.replay(states).select("event_id", "p_steps", "windows", F.lit(again).alias("scored_again"))


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = D.triggered(D.normalized(V.events(spark, sf_dir)))
    return issues.select("repo", "number", "ts", "event_id", F.sha2(F.concat_ws("|", "summary", "description", "state"), 256).alias("fp"), (S.u("done", F.col("event_id").cast("string")) < 0.5).alias("complete"))


CHECKED = f"""checked AS (SELECT repo, number, ts, event_id, sha256(summary || '|' || description || '|' || state) AS fp, {V.u_sql('done', 'event_id')} < 0.5 AS complete FROM issue_events WHERE is_bug AND state IS NOT NULL)"""


@query(EV + f""", {CHECKED}, h AS (SELECT *, coalesce(max((NOT complete)::INT) OVER (PARTITION BY repo, number ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had, lag(fp) OVER (PARTITION BY repo, number ORDER BY ts, event_id) AS was FROM checked)
  SELECT event_id, CASE WHEN had = 0 AND complete THEN 'silent' WHEN had = 0 THEN 'created' WHEN fp = was THEN 'skipped' ELSE 'updated' END AS action FROM h""")
def t2_actions(spark, sf_dir):
    return C.actions(_checked(spark, sf_dir)).select("event_id", "action")


@query(EV + f", {CHECKED} SELECT repo, number, event_id, fp FROM checked QUALIFY row_number() OVER (PARTITION BY repo, number ORDER BY ts DESC, event_id DESC) = 1")
def t3_t4_latest(spark, sf_dir):
    return C.latest(_checked(spark, sf_dir)).select("repo", "number", "event_id", "fp")
