"""From chances and rules to verdicts, counts, comments and fingerprints."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.workers import giving_back, small_batches
from .labels import CHECKS

BLOCKERS = ("steps", "expected", "actual", "build_version")
STATES = ("Submitted", "Open", "In Progress")


@dataclass(frozen=True)
class Settings:
    """Job parameters that decisions depend on."""

    threshold: float = 0.827
    build_pattern: str | None = None
    stands: tuple[str, ...] = R.STANDS
    strict: bool = False
    success_comment: bool = True
    version: str = "1"
    states: tuple[str, ...] = field(default=STATES)


def normalized(events: DataFrame, bug_labels: tuple[str, ...] = ("bug",), status_labels: tuple[str, ...] = STATES) -> DataFrame:
    """Issue struct -> type, state, summary, description beside the other columns."""
    labels = F.transform(F.coalesce("issue.labels", F.array().cast("array<struct<name:string>>")), lambda x: F.lower(x["name"]))
    bug = F.lower(F.coalesce("issue.type.name", F.lit(""))) == "bug"
    for b in bug_labels:
        bug = bug | F.array_contains(labels, b.lower())
    status = F.coalesce(*[F.when(F.array_contains(labels, s.lower()), s) for s in status_labels], F.lit("Submitted"))
    body = F.regexp_replace(F.coalesce("issue.body", F.lit("")), r"(?dm)^_No response_[ \t]*$", "")
    return events.withColumns({"type": F.when(bug, "bug").otherwise("other"), "state": F.when(F.col("issue.state") == "open", status), "summary": F.col("issue.title"), "description": body}).drop("issue")


def triggered(issues: DataFrame, states: tuple[str, ...] = STATES) -> DataFrame:
    """Bugs in a listed state; a closed one has none."""
    return issues.filter((F.col("type") == "bug") & F.col("state").isin(*states))


def verdict(p: Column, threshold: float) -> Column:
    """R18."""
    return F.when(F.greatest(p, 1 - p) < threshold, "unsure").when(p >= 0.5, "present").otherwise("missing")


def decided(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """df(summary, description (cleaned), windows, p_<check> ...) with a verdict a check and the hints' columns.

    In order: threshold; long reports' present blockers are unsure; no description has no steps; blank sections; the strict
    list; the build rule, both ways.
    """
    small_batches(df.sparkSession)
    lines = df.withColumn("_lines", R.read_lines("description"))
    secs = F.col("_lines.sections")
    long = F.col("windows") > 1
    empty = R.empty_sections(secs)
    strict = R.strict_missing(F.col("description"), F.col("_lines")) if settings.strict else F.array().cast("array<string>")
    build = R.build_version(F.col("summary"), F.col("description"), settings.build_pattern)
    out = {}
    for c in CHECKS:
        v = verdict(F.col(f"p_{c}"), settings.threshold)
        if c in BLOCKERS:
            v = F.when(long & (v == "present"), "unsure").otherwise(v)
        if c == "steps":
            v = F.when(F.col("description") == "", "missing").otherwise(v)
        if c in ("steps", "expected"):
            v = F.when(F.array_contains(empty, c), "missing").otherwise(v)
        if c in ("steps", "expected", "actual") and settings.strict:
            v = F.when(F.array_contains(strict, c), "missing").otherwise(v)
        if c == "build_version":
            v = F.when(build, "present").when(~build, "missing").otherwise(v)
        out[c] = v
    hints = {"long": long, "environments": R.environments(F.col("summary"), F.col("description"), settings.stands), "image_only": R.image_only(secs)}
    return lines.withColumns(out | hints).drop("_lines")


def complete(df: DataFrame | None = None) -> Column:
    """No blocker is missing or unsure."""
    out = F.lit(True)
    for c in BLOCKERS:
        out = out & ~F.col(c).isin("missing", "unsure")
    return out


def short_reports(cleaned: DataFrame, most: int = 500) -> DataFrame:
    """Reports whose cleaned summary and description have at most so many characters together."""
    return cleaned.filter(F.length("summary") + F.length(F.coalesce("description", F.lit(""))) <= most)


def state_key() -> Column:
    """What a recorded answer belongs to: the cleaned state alone."""
    return F.sha2(F.to_json(F.struct("summary", "description")), 256)


def recorded(states: DataFrame, score: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """(state, p_<check> ..., windows): each cleaned state's answers, once; score maps a text column to chances.

    A predictor outside of Spark goes through ``scored_batches`` over the same distinct states.
    """
    once = states.select(state_key().alias("state"), F.concat_ws("\n", "summary", "description").alias("_text")).dropDuplicates(["state"])
    answers = {f"p_{c}": p for c, p in score(F.col("_text")).items()}
    return once.withColumns(answers).withColumn("windows", F.lit(1)).drop("_text")


def replayed(states: DataFrame, scores: DataFrame, asked: Column | None = None) -> DataFrame:
    """States with their recorded answers; a state that was never scored stops the job, by naming it.

    asked tells which rows need an answer; the others get none.
    """
    answers = scores.withColumnRenamed("state", "_of")
    key = state_key() if asked is None else F.when(asked, state_key())
    known = states.withColumn("_state", key).join(answers, F.col("_state") == F.col("_of"), "left")
    wrong = F.concat(F.lit("no recorded answer for state "), F.col("_state"))
    checked = F.when(F.col("_state").isNotNull() & F.col("_of").isNull(), F.raise_error(wrong).cast("int")).otherwise(F.col("windows"))
    return known.withColumn("windows", checked).drop("_state", "_of")


# Own wording; nothing outside depends on it.
NAMES = {"steps": "Steps to reproduce", "expected": "Expected result", "actual": "Actual result", "build_version": "Build version"}
ADVICE = {
    "steps": "list the steps by which somebody else can see this; where no way is known, the circumstances help.",
    "expected": "which outcome did you count on?",
    "actual": "which outcome did you get? A message, a value or what the screen did.",
    "build_version": "which build was it? A number tells more than a moving name does.",
}
STRICT_ADVICE = ADVICE | {
    "steps": "two list entries or more, or something to paste and run.",
    "expected": "a headed section, or one plain sentence below the title, that names the right outcome.",
    "actual": "evidence below the title: quoted output, a number, a log excerpt or a picture; a bare complaint does not do.",
}
HINTS = {
    "summary_what": "The title could name the fault rather than a wish.",
    "summary_where": "The title could name the affected part.",
    "summary_when": "The title could name what sets the fault off.",
}
LONG_NOTE = "Only pieces of this long text were looked at together, so nothing found in one of them counts as certain."


def comment(settings: Settings = Settings()) -> Column:
    """From decided() columns and state."""
    advice = STRICT_ADVICE if settings.strict else ADVICE
    missing = F.array_compact(F.array(*[F.when(F.col(c) == "missing", F.lit(f"- **{NAMES[c]}**: {advice[c]}")) for c in BLOCKERS]))
    unsure = F.array_compact(F.array(*[F.when(F.col(c) == "unsure", F.lit(f"**{NAMES[c]}**")) for c in BLOCKERS]))
    image = F.transform("image_only", lambda f: F.concat(F.lit("A few words beside the picture of the "), f, F.lit(" outcome would help.")))
    hints = F.concat(F.array_compact(F.array(*[F.when(F.col(c) == "missing", F.lit(t)) for c, t in HINTS.items()])), image)
    head = F.when(F.size(missing) > 0, F.concat(F.lit("**This report lacks:**\n\n"), F.array_join(missing, "\n"))).when(F.size(unsure) > 0, "**Parts of this report are unclear.**").otherwise("✅ **Nothing is lacking here.**")
    not_sure = F.when(F.size(unsure) > 0, F.concat(F.lit("Not sure about: "), F.array_join(unsure, ", "), F.lit(". Please check "), F.when(F.size(unsure) > 1, "them").otherwise("it"), F.lit(" yourself.")))
    folded = F.when(F.size(hints) > 0, F.concat(F.lit("<details>\n<summary>Suggestions ("), F.size(hints).cast("string"), F.lit(")</summary>\n\n"), F.array_join(F.transform(hints, lambda h: F.concat(F.lit("- "), h)), "\n"), F.lit("\n\n</details>")))
    where = F.when(F.size("environments") > 0, F.concat(F.lit(" Environment: "), F.array_join("environments", ", "), F.lit("."))).otherwise("")
    footer = F.concat(F.lit("<sub>State at reading: "), F.col("state"), F.lit("."), where, F.lit("</sub>"))
    return F.concat_ws("\n\n", head, not_sure, F.when(F.col("long"), LONG_NOTE), folded, footer)


def fingerprint(settings: Settings = Settings()) -> Column:
    """16 hex digits over all that a comment depends on."""
    own = F.to_json(F.struct("summary", "description", "state", F.lit(str(settings)).alias("settings")))
    return F.substring(F.sha2(own, 256), 1, 16)


def bot_counts(df: DataFrame) -> DataFrame:
    """decided() rows with gold_<check> -> (check, n, decided, wrong, missing_n, missing_found, false_missing)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("v"), F.col(f"gold_{c}").alias("gold")) for c in CHECKS])).alias("x")).select("x.*")
    no, said_no = ~F.col("gold"), F.col("v") == "missing"
    return long.groupBy("check").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("v") != "unsure").alias("decided"),
        F.count_if((F.col("v") != "unsure") & (F.col("gold") == said_no)).alias("wrong"),
        F.count_if(no).alias("missing_n"),
        F.count_if(no & said_no).alias("missing_found"),
        F.count_if(~no & said_no).alias("false_missing"),
    )


def window_rollup(scores: DataFrame) -> DataFrame:
    """(id, window, check, p) -> largest chance over a report's windows, and their number."""
    return scores.groupBy("id", "check").agg(F.max("p").alias("p"), F.count("*").alias("windows"))


def token_windows(df: DataFrame, size: int = 60, step: int = 40) -> DataFrame:
    """(id, window, tokens) of overlapping windows of blank-separated tokens; at least one a report."""
    tokens = F.regexp_extract_all(F.col("text"), F.lit(r"\S+"), F.lit(0))
    last = F.greatest(F.ceil((F.size("t") - size) / step), F.lit(0))
    each = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda w: F.struct(w.alias("window"), F.slice("t", (w * step + 1).cast("int"), size).alias("tokens")))
    return df.withColumn("t", tokens).select("id", F.explode(each).alias("w")).select("id", "w.window", "w.tokens")


def scored_batches(df: DataFrame, make_predictor, schema: str) -> DataFrame:
    """a pluggable predictor, made once a task, over batches sorted by text length; it maps a pandas frame to one."""

    def run(batches):
        predict = make_predictor()
        for pdf in batches:
            yield predict(pdf.iloc[pdf["text"].str.len().argsort(kind="stable")])

    small_batches(df.sparkSession)
    return df.mapInPandas(giving_back(run), schema)
