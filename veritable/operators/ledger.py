"""Project ledger tables: memory, feedback, preferences, policies.

The ledger is append-only rows (parquet in a shared folder in production);
"the current state" of an item is its latest version, taken with a grouped
``max_by`` (map-side combined, so an item with a huge history is still one
partial row per task), never a sort of the whole history.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.functions.exprs import with_scalars

# Rating weights and the context keys feedback may carry.
RATING_WEIGHTS = {"useful": 2.0, "not_useful": -1.0, "incorrect": -2.0}
CONTEXT_KINDS = {"axis": "axes", "kpi": "kpis", "chart_kind": "chart_kinds", "confidence": "confidence"}
POLICY_WEIGHT_KEYS = {"axes": "axis_weight", "kpis": "kpi_weight", "chart_kinds": "chart_weight",
                      "confidence": "confidence_weight"}
POLICY_WEIGHT_RANGE = (0.0, 3.0)

MEMORY_SCHEMA = ("id string, project_id string, statement string, category string, status string, scope string, "
                 "columns array<string>, version int, valid_to string, updated_at string")
FEEDBACK_SCHEMA = ("run_id string, project_id string, item_type string, item_key string, rating string, "
                   "correction string, context string, created_at string")


POLICY_SCHEMA = ("policy_id string, project_id string, version int, status string, weights map<string,double>, "
                 "parent_id string")


def _latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key by ``order``; rows equal in that are told apart by their whole content."""
    rest = [c for c in rows.columns if c not in keys]
    whole = F.struct(*[F.col(c) for c in rest])
    # maps have no order: their entries by key have one
    told = [F.array_sort(F.map_entries(c)).alias(c) if isinstance(rows.schema[c].dataType, T.MapType) else F.col(c) for c in rest if c not in order]
    last = rows.groupBy(*keys).agg(F.max_by(whole, F.struct(*[F.col(c) for c in order], *told)).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def latest_versions(history: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """L3: the latest version row of every item (grouped max_by, no window)."""
    return _latest(history, [key], [version, *(c for c in ("updated_at",) if c in history.columns)])


def in_force(history: DataFrame, as_of: str) -> DataFrame:
    """The latest versions as they stand on ``as_of``: active items past ``valid_to`` are expired."""
    due = (F.col("status") == "active") & (F.col("valid_to") < as_of)
    return latest_versions(history).withColumn("status", F.when(due, F.lit("expired")).otherwise(F.col("status")))


def active_memory(history: DataFrame, project_id: str, table_columns: list[str], as_of: str) -> DataFrame:
    """L1: items of a project active on ``as_of``; dataset-scoped items need a column in common with the table."""
    here = F.array(*[F.lit(c.casefold()) for c in table_columns]).cast("array<string>")
    theirs = F.transform(F.coalesce("columns", F.array().cast("array<string>")), F.lower)
    related = (F.col("scope") != "dataset") | F.arrays_overlap(theirs, here)
    mine = (F.col("project_id") == project_id) & (F.col("status") == "active")
    return in_force(history, as_of).where(mine & F.coalesce(related, F.lit(False)))


def expire(history: DataFrame, as_of: str) -> DataFrame:
    """L2: new version rows marking active items past ``valid_to`` as expired."""
    due = latest_versions(history).where((F.col("status") == "active") & (F.col("valid_to") < as_of))
    return due.withColumns({"status": F.lit("expired"), "version": F.col("version") + 1,
                            "updated_at": F.lit(as_of)}).select(*history.columns)


def _statement_key() -> Column:
    return F.lower(F.trim("statement"))


def new_versions(history: DataFrame, changes: DataFrame) -> DataFrame:
    """L3: the rows that ``changes`` add to a history (or to its current state): version = latest + 1.

    A new statement is skipped if it repeats an active one of the project; of
    equal new statements in one batch the one with the smallest id is added.
    """
    now = latest_versions(history)
    known = now.select("id", F.col("version").alias("_at"))
    updates = changes.join(known, "id").withColumn("version", F.col("_at") + 1).select(*history.columns)
    fresh = changes.join(known, "id", "left_anti").withColumn("_said", _statement_key())
    taken = now.where("status = 'active'").select("project_id", _statement_key().alias("_said"))
    fresh = fresh.join(taken, ["project_id", "_said"], "left_anti")
    active = _latest(fresh.where("status = 'active'").withColumn("_order", F.lit(0)), ["project_id", "_said", "id"], ["_order"])
    first = active.groupBy("project_id", "_said").agg(F.min("id").alias("id"))
    added = active.join(first, ["project_id", "_said", "id"], "left_semi").drop("_order")
    added = added.unionByName(fresh.where("status <> 'active'")).withColumn("version", F.lit(1))
    return added.select(*history.columns).unionByName(updates)


def upsert(history: DataFrame, changes: DataFrame) -> DataFrame:
    """L3: the history with ``changes`` appended as new versions (see ``new_versions``)."""
    return history.unionByName(new_versions(history, changes))


def restore(history: DataFrame, requests: DataFrame, as_of: str) -> DataFrame:
    """L3: ``requests`` (id, version): the content of an old version as a new version; nothing is erased."""
    newest = latest_versions(history).select("id", F.col("version").alias("_at"))
    old = _latest(history.join(requests.select("id", "version").distinct(), ["id", "version"], "left_semi"),
                  ["id", "version"], [])
    again = old.join(newest, "id").withColumns({"version": F.col("_at") + 1, "updated_at": F.lit(as_of)})
    return history.unionByName(again.select(*history.columns))


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """L4: one rating per (run, item type, item key): the latest wins."""
    return _latest(feedback, ["run_id", "item_type", "item_key"], ["created_at"])


def pending_lessons(feedback: DataFrame) -> DataFrame:
    """L4: an ``incorrect`` rating with a correction opens a pending lesson;
    re-rating the item replaces it (only the latest rating counts)."""
    cur = latest_feedback(feedback)
    return cur.filter((F.col("rating") == "incorrect") & (F.length(F.trim(F.coalesce("correction", F.lit("")))) > 0)).select(
        F.concat_ws(":", "run_id", "item_type", "item_key").alias("lesson_id"), "project_id",
        F.col("correction").alias("statement"), F.lit("pending").alias("status"), "created_at")


def review_lessons(lessons: DataFrame, reviews: DataFrame) -> DataFrame:
    """Pending -> approved / rejected by ``reviews`` (lesson_id, decision, optionally ``edited``).

    A lesson that was reviewed before keeps its status. An edited statement
    replaces the lesson's own when it is approved.
    """
    edited = F.col("edited") if "edited" in reviews.columns else F.lit(None).cast("string")
    asked = reviews.select("lesson_id", "decision", edited.alias("edited"))
    opened = F.col("status") == "pending"
    status = (F.when(opened & (F.col("decision") == "approve"), "approved")
              .when(opened & (F.col("decision") == "reject"), "rejected").otherwise(F.col("status")))
    said = F.when(opened & (F.col("decision") == "approve"), F.coalesce("edited", "statement")).otherwise(F.col("statement"))
    return lessons.join(asked, "lesson_id", "left").select("lesson_id", "project_id", said.alias("statement"),
                                                           status.alias("status"))


def approve_into_memory(history: DataFrame, lessons: DataFrame, reviews: DataFrame, as_of: str) -> DataFrame:
    """The memory history after a review: every lesson approved in it becomes an active item (by ``upsert``)."""
    before = lessons.where("status = 'pending'").select("lesson_id")
    approved = review_lessons(lessons, reviews).where("status = 'approved'").join(before, "lesson_id", "left_semi")
    items = approved.select(
        F.concat(F.lit("lesson:"), "lesson_id").alias("id"), "project_id", "statement", F.lit("context").alias("category"),
        F.lit("active").alias("status"), F.lit("project").alias("scope"), F.array().cast("array<string>").alias("columns"),
        F.lit(0).alias("version"), F.lit(None).cast("string").alias("valid_to"), F.lit(as_of).alias("updated_at"))
    return upsert(history, items.select(*history.columns))


def project_ratings(feedback: DataFrame, project_id: str) -> DataFrame:
    """The ratings a project's profile rests on: the latest of every item, of that project only."""
    return latest_feedback(feedback).where(F.col("project_id") == project_id)


def preference_profile(feedback: DataFrame, project_id: str) -> DataFrame:
    """Per (kind, value) the summed rating weight and the count of a project's current ratings."""
    def lookup(table: dict) -> Column:
        return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])

    rated = project_ratings(feedback, project_id).select(
        lookup(RATING_WEIGHTS)[F.col("rating")].alias("w"), F.explode(F.from_json("context", "map<string,string>")).alias("k", "v"))
    told = rated.select(lookup(CONTEXT_KINDS)[F.col("k")].alias("kind"), F.lower(F.trim("v")).alias("value"), "w")
    told = told.where("kind IS NOT NULL AND value <> '' AND w IS NOT NULL")
    return told.groupBy("kind", "value").agg(F.round(F.sum("w"), 3).alias("score"),
                                             F.count(F.lit(1)).cast("bigint").alias("count"))


def rank_items(items: DataFrame, profile: DataFrame, columns: dict[str, str], weights: dict[str, float] | None = None) -> DataFrame:
    """Stable re-ranking of items by preference; values never change.

    ``columns`` maps a profile kind to the item column that holds its value;
    an item's preference is the sum of its values' scores, each times the
    policy's weight for the kind (1 unless ``weights`` says otherwise).
    """
    out = items.withColumn("preference", F.lit(0.0))
    for kind, column in columns.items():
        scores = profile.where(F.col("kind") == kind).select(F.col("value").alias("_value"), F.col("score").alias("_score"))
        out = out.join(scores, F.lower(F.trim(column)) == F.col("_value"), "left")
        weight = float((weights or {}).get(POLICY_WEIGHT_KEYS[kind], 1.0))
        out = out.withColumn("preference", F.col("preference") + F.coalesce("_score", F.lit(0.0)) * weight).drop("_value", "_score")
    return out.orderBy(F.col("preference").desc(), F.col("default_position"))


def policy_check(profile: DataFrame, candidate: dict[str, float], parent: dict[str, float],
                 samples: DataFrame) -> DataFrame:
    """Alignment of candidate and parent weights; the candidate is
    validated when its weights are in 0..3 and it aligns at least as well as
    its parent (or there is no feedback yet). ``samples`` are the ratings
    behind the profile (``project_ratings``)."""
    def align(rules, tag):
        w = F.create_map(*[x for kind, key in POLICY_WEIGHT_KEYS.items()
                           for x in (F.lit(kind), F.lit(float(rules.get(key, 1.0))))])
        wt = F.coalesce(w[F.col("kind")], F.lit(1.0))
        return profile.agg(F.coalesce(F.sum(F.greatest(F.col("score"), F.lit(0.0)) * wt), F.lit(0.0)).alias(f"p_{tag}"),
                           F.coalesce(F.sum(F.abs(F.least(F.col("score"), F.lit(0.0))) * wt), F.lit(0.0)).alias(f"n_{tag}"))
    a, b = align(candidate, "c"), align(parent, "b")
    guard = all(POLICY_WEIGHT_RANGE[0] <= float(v) <= POLICY_WEIGHT_RANGE[1] for v in candidate.values())
    s = samples.agg(F.count(F.lit(1)).alias("samples"))
    j = with_scalars(with_scalars(a, b), s)
    ca = F.round(100 * F.col("p_c") / F.greatest(F.lit(1.0), F.col("p_c") + F.col("n_c")), 1)
    ba = F.round(100 * F.col("p_b") / F.greatest(F.lit(1.0), F.col("p_b") + F.col("n_b")), 1)
    gate = (F.col("samples") == 0) | (ca >= ba)
    return j.select(ca.alias("candidate_alignment"), ba.alias("baseline_alignment"),
                    F.round(ca - ba, 1).alias("alignment_delta"), F.lit(guard).alias("guardrails_passed"),
                    gate.alias("quality_gate_passed"), F.col("samples").cast("bigint").alias("samples"),
                    F.when(F.lit(guard) & gate, "validated").otherwise("rejected").alias("status"))


def activate(policies: DataFrame, policy_id: str) -> DataFrame:
    """Make a validated policy its project's active one and retire the one before; any other status changes nothing."""
    chosen = policies.where((F.col("policy_id") == policy_id) & (F.col("status") == "validated")).select(
        F.col("project_id").alias("_project"))
    j = with_scalars(policies, chosen)
    same = F.col("project_id") == F.col("_project")
    status = (F.when(same & (F.col("policy_id") == policy_id), "active")
              .when(same & (F.col("status") == "active"), "retired").otherwise(F.col("status")))
    return j.withColumn("status", status).select(*policies.columns)


def roll_back(policies: DataFrame, project_id: str) -> DataFrame:
    """The active policy's parent becomes active again; without an active policy or a known parent nothing changes."""
    own = policies.where(F.col("project_id") == project_id)
    pair = own.where("status = 'active'").select("policy_id", F.col("parent_id").alias("_parent")).join(
        own.select(F.col("policy_id").alias("_parent")), "_parent")
    last = pair.agg(F.max(F.struct("policy_id", "_parent")).alias("p")).select(F.col("p.policy_id").alias("_from"),
                                                                               F.col("p._parent").alias("_to"))
    status = (F.when(F.col("policy_id") == F.col("_from"), "retired").when(F.col("policy_id") == F.col("_to"), "active")
              .otherwise(F.col("status")))
    return with_scalars(policies, last).withColumn("status", status).select(*policies.columns)


def counters(memory: DataFrame, lessons: DataFrame, feedback: DataFrame, project_id: str, as_of: str) -> DataFrame:
    """A project's active memory items on ``as_of``, pending lessons, corrections and useful ratings."""
    own = F.col("project_id") == project_id

    def number(condition: Column, name: str) -> Column:
        return F.count_if(condition).cast("bigint").alias(name)

    m = in_force(memory, as_of).where(own).agg(number(F.col("status") == "active", "active_memory"))
    lessons_open = lessons.where(own).agg(number(F.col("status") == "pending", "pending_lessons"))
    f = project_ratings(feedback, project_id).agg(number(F.col("rating") == "incorrect", "corrections"),
                                                  number(F.col("rating") == "useful", "useful"))
    return with_scalars(with_scalars(m, lessons_open), f)


class MemoryStore:
    """L3: a memory history in a shared folder whose current state is a snapshot and the rows appended since.

    Every append is a folder of its own and counts once its name stands in the
    list of commits, which is written last: a writer that dies before leaves
    rows that no reader sees. ``compact`` folds what is new into a snapshot and
    notes which commits that covers, so ``current`` reads the latest snapshot
    and the folders of later commits alone, whatever order writers finish in.
    The history stays whole (old versions can be restored). Latest versions
    are a maximum, so the fold of snapshot and new rows is that of all rows.
    The names of commits since the last snapshot pass through the driver:
    compact now and then.
    """

    COMMITS = "commit string, kind string, committed timestamp"

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def append(self, rows: DataFrame) -> None:
        self.commit(self.stage(rows))

    def upsert(self, changes: DataFrame) -> None:
        self.append(new_versions(self.current(), changes))

    def stage(self, rows: DataFrame) -> str:
        """Write rows where no reader looks yet; the name of the commit."""
        commit = uuid.uuid4().hex
        fields = self.spark.createDataFrame([], MEMORY_SCHEMA).columns
        rows.select(*fields).write.parquet(f"{self.root}/rows/commit={commit}")
        return commit

    def commit(self, commit: str, kind: str = "rows") -> None:
        row = self.spark.createDataFrame([(commit, kind)], "commit string, kind string")
        row.withColumn("committed", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    def history(self) -> DataFrame:
        """All committed versions."""
        return self._rows().join(self._commits().where("kind = 'rows'").select("commit"), "commit", "left_semi").drop("commit")

    def current(self) -> DataFrame:
        """The latest version of every item; reads the last snapshot and what was committed after it."""
        snapshot, names = self._since()
        return self._state(snapshot, names)

    def compact(self) -> None:
        snapshot, names = self._since()
        if not names:
            return
        commit = uuid.uuid4().hex
        self._state(snapshot, names).write.parquet(f"{self.root}/snapshots/{commit}")
        covered = self.spark.createDataFrame([(n,) for n in names], "commit string")
        if snapshot:
            covered = covered.unionByName(self._covered(snapshot))
        covered.coalesce(1).write.parquet(f"{self.root}/covered/{commit}")
        self.commit(commit, "snapshot")

    def _commits(self) -> DataFrame:
        return self.spark.read.schema(self.COMMITS).parquet(f"{self.root}/commits")

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(f"{MEMORY_SCHEMA}, commit string").parquet(f"{self.root}/rows")

    def _covered(self, snapshot: str) -> DataFrame:
        return self.spark.read.schema("commit string").parquet(f"{self.root}/covered/{snapshot}")

    def _since(self) -> tuple[str | None, list[str]]:
        """The last snapshot and the commits that it does not cover."""
        commits = self._commits()
        last = commits.where("kind = 'snapshot'").orderBy(F.desc("committed"), "commit").first()
        new = commits.where("kind = 'rows'").select("commit")
        if last is not None:
            new = new.join(self._covered(last["commit"]), "commit", "left_anti")
        return last and last["commit"], sorted(r["commit"] for r in new.collect())

    def _state(self, snapshot: str | None, names: list[str]) -> DataFrame:
        rows = self._rows().where(F.col("commit").isin(names)).drop("commit")
        if snapshot:
            rows = rows.unionByName(self.spark.read.schema(MEMORY_SCHEMA).parquet(f"{self.root}/snapshots/{snapshot}"))
        return latest_versions(rows)
