"""Issue events to one up-to-date comment an issue: keyed state on a stream, and the same over a table.

A stream goes through two keyed states. The first knows the newest event's fingerprint of each issue and marks what changed,
so that an unchanged report is neither scored nor decided again; the second knows the issue's comment and its newest event.
Events may come in any order and any batches: what is newest goes by (ts, event_id), an old event that comes late never
rewrites a newer comment, and one that would have created the comment creates it with the newest text. So the comments that
stand at the end are those of the table form, whatever the batches were.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import cleanup
from ..functions.workers import giving_back, small_batches
from ..operators import decide as D
from ..operators.labels import CHECKS

KEY = ("repo", "number")


def states(events: DataFrame, settings: D.Settings = D.Settings()) -> DataFrame:
    """T1, first half: issue events (a table or a stream) -> cleaned reports of bugs in a checked state, with a fingerprint."""
    issues = D.triggered(D.normalized(events, status_labels=settings.states), settings.states)
    cleaned = cleanup.clean_reports(issues.withColumn("wiki", F.lit(False))).drop("wiki")
    return cleaned.withColumn("fp", D.fingerprint(settings))


def flow(events: DataFrame, scores: DataFrame, settings: D.Settings = D.Settings()) -> DataFrame:
    """Normalise, trigger, clean, look scores up, decide, comment.

    scores(state, p_<check> ..., windows) is a table as ``decide.recorded`` gives it; the result has a verdict a check, ``fp``,
    ``complete`` and ``comment`` and goes to ``actions``, or on a stream to ``stream_actions``.
    """
    decided = D.decided(D.replayed(states(events, settings), scores), settings)
    return decided.withColumns({"complete": D.complete(), "comment": D.comment(settings)})


def latest(events: DataFrame) -> DataFrame:
    """The last event of each issue (ties: larger event_id)."""
    row = F.struct(*[c for c in events.columns if c not in KEY])
    return events.groupBy(*KEY).agg(F.max_by(row, F.struct("ts", "event_id")).alias("r")).select(*KEY, "r.*")


def actions(checked: DataFrame, success_comment: bool = False) -> DataFrame:
    """T2 over a table (repo, number, ts, event_id, fp, complete): what each event does to its issue's comment.

    Before the first event that creates a comment all are silent; from it on a fingerprint like the one before is skipped,
    another one updates.
    """
    order = Window.partitionBy(*KEY).orderBy("ts", "event_id")
    creates = F.lit(True) if success_comment else ~F.col("complete")
    so_far = F.coalesce(F.max(creates.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = checked.withColumns({"_had": so_far, "_last": F.lag("fp").over(order)})
    action = F.when((F.col("_had") == 0) & ~creates, "silent").when(F.col("_had") == 0, "created").when(F.col("fp") == F.col("_last"), "skipped").otherwise("updated")
    return marked.withColumn("action", action).drop("_had", "_last")


def comments_table(checked: DataFrame, success_comment: bool = False) -> DataFrame:
    """T4 over a table of events (repo, number, ts, event_id, fp, complete, comment): the comment of each issue that has one.

    It exists once an event creates it, and says what the newest event says.
    """
    creates = F.lit(True) if success_comment else ~F.col("complete")
    newest = F.max_by(F.struct("ts", "event_id", "fp", "comment"), F.struct("ts", "event_id"))
    each = checked.groupBy(*KEY).agg(F.max(creates).alias("has"), newest.alias("n"))
    return each.filter("has").select(*KEY, "n.*")


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ORDER = ["ts", "event_id"]
#: Groups of issues that a handler gets at once; each issue has its own entry in the group's map. A checkpoint holds for one number.
BUCKETS = 256
_ISSUE = "repo long, number long"
#: Null ids and times inside the handlers, where all four are longs: before all others, as in an ORDER BY.
_NONE = -(1 << 63)


def _keyed(df: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    """A state by issue, over groups of issues: a handler's own cost is paid once a group and micro-batch, not once an issue.

    State variables need the store that keeps them on disk. Times pass the handlers as microseconds.
    """
    df.sparkSession.conf.set(_STORE, _ROCKS)
    longs = {c: F.coalesce(F.unix_micros(F.col(c).cast("timestamp")) if c == "ts" else F.col(c).cast("long"), F.lit(_NONE)) for c in (*KEY, *_ORDER)}
    groups = df.withColumns(longs).withColumn("_group", F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)))
    out = groups.groupBy("_group").transformWithStateInPandas(processor, schema.replace("ts timestamp", "ts long"), "Append", "None")
    back = {c: F.nullif(c, F.lit(_NONE)) for c in (*KEY, *_ORDER, "said_ts", "said_event") if c in out.columns}
    return out.withColumns({c: F.timestamp_micros(v) if c.endswith("ts") else v for c, v in back.items()})


class _Issues:
    """A group's events of one micro-batch, by issue and time, beside what the state knows of each issue."""

    def __init__(self, rows: Iterator[pd.DataFrame], known: Callable[[tuple], tuple | None]):
        pdf = pd.concat(list(rows), ignore_index=True)
        repo, number, ts, event_id = (pdf[c].to_numpy(np.int64) for c in (*KEY, *_ORDER))
        order = np.lexsort((event_id, ts, number, repo))
        self.rows = pdf.iloc[order].reset_index(drop=True)
        repo, number, self.ts, self.event_id = (x[order] for x in (repo, number, ts, event_id))
        self.first = np.ones(len(order), bool)
        self.first[1:] = (np.diff(repo) != 0) | (np.diff(number) != 0)
        self.start = np.flatnonzero(self.first)
        self.last = np.append(self.start[1:], len(order)) - 1
        self.of = np.cumsum(self.first) - 1
        self.keys = list(zip(repo[self.start].tolist(), number[self.start].tolist(), strict=True))
        self.known = [known(k) for k in self.keys]
        there = np.array([k is not None for k in self.known], bool)
        self.had = there[self.of]
        self.known_ts, self.known_id = (self.of_known(i, _NONE).astype(np.int64) for i in (0, 1))
        #: Is an event not newer than the newest that is known?
        self.late = self.had & ((self.ts < self.known_ts) | (self.ts == self.known_ts) & (self.event_id <= self.known_id))

    def of_known(self, field: int, otherwise=None) -> np.ndarray:
        """A field of what is known, a value an event."""
        each = np.empty(len(self.known), object)
        each[:] = [otherwise if k is None else k[field] for k in self.known]
        return each[self.of]


class _Changes(StatefulProcessor):
    """Marks events whose fingerprint is not that of the event before; a late one is held against the newest."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getMapState("newest", _ISSUE, "ts long, event_id long, fp string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        g = _Issues(rows, self.newest.getValue)
        fp = g.rows["fp"].to_numpy(object)
        held = g.late | g.first | np.concatenate([[False], g.late[:-1]])
        before = np.where(held, g.of_known(2), np.concatenate([[None], fp[:-1]]))
        changed = (fp != before).astype(bool) | pd.isna(fp)
        for i, end in enumerate(g.last.tolist()):
            if not g.late[end]:
                self.newest.updateValue(g.keys[i], (int(g.ts[end]), int(g.event_id[end]), fp[end]))
        yield g.rows.drop(columns="_group", errors="ignore").assign(changed=changed)

    def close(self) -> None:
        pass


class _Actions(StatefulProcessor):
    """What each event does to its issue's comment. State: the newest event with its text, and the comment's id."""

    def __init__(self, success_comment: bool):
        self.success_comment = success_comment

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.issues = handle.getMapState("issues", _ISSUE, "ts long, event_id long, fp string, comment string, id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        g = _Issues(rows, self.issues.getValue)
        pdf, late = g.rows, g.late
        changed = pdf["changed"].to_numpy(bool)
        # what an event leaves as the newest: itself, or for late ones what was newest before; an unchanged one keeps the text
        said_ts, said_id = np.where(late, g.known_ts, g.ts), np.where(late, g.known_id, g.event_id)
        said_fp = np.where(late, g.of_known(2), pdf["fp"].to_numpy(object))
        spoke = np.maximum.accumulate(np.where(changed & ~late, np.arange(len(pdf)), -1))
        said = np.where(spoke >= g.start[g.of], pdf["comment"].to_numpy(object)[spoke], g.of_known(3))
        creates = np.full(len(pdf), True) if self.success_comment else pdf["complete"].eq(False).to_numpy(bool)
        so_far = np.cumsum(creates) - creates
        own = [None if k is None else k[4] for k in g.known]
        commented = np.array([x is not None for x in own], bool)[g.of]
        has = commented | (so_far > so_far[g.start][g.of])
        action = np.where(has, np.where(~late & changed, "updated", "skipped"), np.where(creates, "created", "silent"))
        for i in np.flatnonzero(action == "created").tolist():
            own[g.of[i]] = int(g.event_id[i])
        for i, end in enumerate(g.last.tolist()):
            was = g.known[i]
            if not late[end] or was[4] != own[i]:
                text = None if pd.isna(said[end]) else said[end]
                self.issues.updateValue(g.keys[i], (int(said_ts[end]), int(said_id[end]), said_fp[end], text, own[i]))
        ids = np.array([0 if x is None else x for x in own], np.int64)[g.of]
        out = pdf[[*KEY, *_ORDER, "fp", "complete"]].assign(action=action.astype(object), comment_id=pd.arrays.IntegerArray(ids, action == "silent"))
        written = (action == "created") | (action == "updated")
        yield out.assign(comment=np.where(written, said, None), said_ts=said_ts, said_event=said_id, said_fp=said_fp)

    def close(self) -> None:
        pass


def changes(states_: DataFrame) -> DataFrame:
    """states() of a stream with ``changed``: has the report another fingerprint than the issue's event before?"""
    rows = states_.select(*KEY, *_ORDER, "fp", "state", "summary", "description")
    return _keyed(rows, _Changes(), "repo long, number long, ts timestamp, event_id long, fp string, state string, summary string, description string, changed boolean")


def stream_actions(checked: DataFrame, success_comment: bool = False) -> DataFrame:
    """T2 on a stream of checked events (repo, number, ts, event_id, fp, complete; comment and changed where they are known).

    A row an event: its action, the comment's id and text where one is written, and the event that the text speaks of
    (said_ts, said_event, said_fp), which is a newer one where an old event comes late and creates the comment.
    """
    own = checked.columns
    text = F.col("comment") if "comment" in own else F.lit(None).cast("string")
    if "changed" not in own:
        marked = _keyed(checked.select(*KEY, *_ORDER, "fp", "complete", text.alias("comment")), _Changes(), "repo long, number long, ts timestamp, event_id long, fp string, complete boolean, comment string, changed boolean")
    else:
        marked = checked.select(*KEY, *_ORDER, "fp", "complete", text.alias("comment"), "changed")
    out = "repo long, number long, ts timestamp, event_id long, fp string, complete boolean, action string, comment_id long, comment string, said_ts timestamp, said_event long, said_fp string"
    return _keyed(marked, _Actions(success_comment), out)


def stream_flow(events: DataFrame, score: Callable[[DataFrame], DataFrame], settings: D.Settings = D.Settings()) -> DataFrame:
    """T1, T2 on a stream: events to actions and comments; an unchanged report is neither scored nor decided.

    score maps rows with ``changed``, summary and description to rows with p_<check> ... and windows; it is asked for the
    changed ones only: the others come with no text and may get nulls.
    """
    marked = changes(states(events, settings))
    asked = marked.withColumns({c: F.when(F.col("changed"), F.col(c)).otherwise("") for c in ("summary", "description")})
    decided = D.decided(score(asked), settings)
    changed = F.col("changed")
    checked = decided.withColumns({"complete": F.when(changed, D.complete()), "comment": F.when(changed, D.comment(settings))})
    return stream_actions(checked, settings.success_comment)


def replay(scores: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A score for ``stream_flow`` from recorded answers; unchanged rows look nothing up."""
    return lambda rows: D.replayed(rows, scores, F.col("changed"))


def predictor(make_predictor: Callable) -> Callable[[DataFrame], DataFrame]:
    """A score for ``stream_flow`` by a live predictor: a pandas frame of texts to one chance a check; made once a task."""

    def score(rows: DataFrame) -> DataFrame:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + "".join(f", p_{c} double" for c in CHECKS) + ", windows int"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            predict = make_predictor()
            for pdf in batches:
                asked = pdf[pdf["changed"]]
                given = predict(asked) if len(asked) else pd.DataFrame(index=asked.index)
                out = pdf.copy()
                for c in CHECKS:
                    out[f"p_{c}"] = given[f"p_{c}"] if len(asked) else np.nan
                out["windows"] = (given["windows"] if len(asked) else pd.Series(dtype=float)).reindex(pdf.index).fillna(0).astype("int32")
                yield out

        small_batches(rows.sparkSession)
        return rows.mapInPandas(giving_back(run), schema)

    return score


_COMPACT = 16


def _folders(spark: SparkSession, path: str) -> dict[int, object]:
    """The sink's finished folders: a batch by its number, what was compacted up to batch n by -(n + 1)."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatus(hadoop) if fs.exists(hadoop) else []
    own = {int(f.getPath().getName()[6:]): f.getPath() for f in found if f.getPath().getName().startswith("batch=")}
    return {n: p for n, p in own.items() if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}


def upsert_comments(path: str, compact_every: int = _COMPACT) -> Callable[[DataFrame, int], None]:
    """T4: a foreachBatch sink of ``stream_actions`` rows: one row an issue of a batch, one folder a batch.

    Each so many batches all folders are merged to one row an issue; what the merge before had taken in is removed, so that
    readers of a moment ago lose nothing and no more than two merges and two rounds of batches stand. A batch that runs again
    replaces its own rows only, and rows that are met twice change nothing, as the newest wins.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.filter(F.col("action").isin("created", "updated"))
        if "said_ts" in batch.columns:
            rows = rows.withColumns({"ts": F.col("said_ts"), "event_id": F.col("said_event"), "fp": F.col("said_fp")}).drop("said_ts", "said_event", "said_fp")
        latest(rows).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if (batch_id + 1) % compact_every:
            return
        have = _folders(spark, path)
        merges = sorted((n for n in have if n < 0), reverse=True)  # the oldest first
        if -(batch_id + 1) not in have:
            current_comments(spark.read.parquet(path)).drop("batch").write.mode("overwrite").parquet(f"{path}/batch={-(batch_id + 1)}")
        before = [n for n in merges if n > -(batch_id + 1)]
        if before:
            last = before[-1]
            for n, folder in have.items():
                if last < n < 0 or 0 <= n < -last:
                    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    return write


def current_comments(written: DataFrame) -> DataFrame:
    """The single comment of each issue: the row that speaks of its newest event."""
    return latest(written)
