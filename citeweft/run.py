"""A run: seeds, then steps (expand, resolve, filter, rank) and labels in turn, until a rule stops it.

State is DataFrames in the shared folder; the driver holds counters only. ``step`` is idempotent while labels are
awaited.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .functions.udfs import canonical
from .model import EXCLUDE, INCLUDE, RunSettings
from .manifest import Manifest, hash_rows
from .operators import eligibility, estimate, expand, prisma, rank, resolve, stopping
from .sinks import exports
from .sources import files
from .storage import durable

#: What a run keeps in tables.
TABLES = ("decisions", "frontier", "expanded", "aliases", "provenance", "merges", "registry")
READY, AWAITING, STOPPED = "ready", "awaiting_labels", "stopped"


class LabelError(ValueError):
    """Labels that do not fit the records that wait for them."""


class Run:
    """One review over works and edges (src, dst, direction, provider).

    ``members``: keys of each membership set that an arm names. ``vectors``: rows (key, v) for the ranker by embedding.
    Works that resolve to one are merged: the registry holds the merged work, under the smallest key, and edges of all
    its keys are followed from there.
    """

    def __init__(self, works: DataFrame, edges: DataFrame, settings: RunSettings = RunSettings(), members: dict[str, DataFrame] | None = None, vectors: DataFrame | None = None):  # noqa: B008
        self.spark: SparkSession = works.sparkSession
        self.members, self.vectors = members or {}, vectors
        lost = sorted({a.member_of for a in settings.arms if a.member_of is not None} - set(self.members))
        if lost:
            raise ValueError(f"no membership set {', '.join(map(repr, lost))}")
        if settings.ranker == "embedding" and vectors is None:
            raise ValueError("the ranker by embedding needs vectors")
        self.manifest = Manifest(settings)
        self.registry = works.limit(0)
        self.settings, self.works, self.edges = settings, works, durable(edges)
        self.phase, self.n = READY, 0
        self.events: list[str] = []
        self.rounds: list[dict] = []
        self.trail: list[dict] = []
        self.rejected: list[dict] = []
        self.merges = self.spark.createDataFrame([], "rep string, members long, tier string, score double")
        self.decisions = self._empty("key string, decision string")
        self.frontier = self.expanded = self._empty("key string")
        self.aliases = self._empty("key string, rep string")
        self.provenance = self._empty("trial string, parent string, key string, provider string, direction string, iteration int")
        self.pending: DataFrame | None = None
        self.stopped_by: str | None = None

    def _empty(self, ddl: str) -> DataFrame:
        return self.spark.createDataFrame([], ddl)

    def _rows(self, rows: list[dict], ddl: str) -> DataFrame:
        """A row for each round, columns by name."""
        names = [c.split()[0] for c in ddl.split(", ")]
        return self.spark.createDataFrame([tuple(r[c] for c in names) for r in rows], ddl)

    def init(self, idents: DataFrame) -> int:
        """Resolves seed identifiers (ident); they count as included. Returns how many were found.

        Each goes to the first provider, in the order of precedence, that knows it; what none knows is looked up as it
        stands, then in lower case, among all names.
        """
        found = durable(files.resolve_seeds(idents, files.aliases_by_provider(self.works), list(self.settings.dedup.precedence)))
        rest = files.resolve_identifiers(found.where("key is null").select("ident"), files.aliases(self.works))
        found = durable(found.where("key is not null").select("ident", "key").union(rest))
        lost = found.where("key is null").count()
        keys = durable(found.where("key is not null").select("key").distinct())
        n = keys.count()
        self.decisions = durable(keys.select("key", F.lit(INCLUDE).alias("decision")))
        self.frontier = keys
        seed = keys.select(F.lit("t").alias("trial"), F.lit(None).cast("string").alias("parent"), "key", F.lit("seed").alias("provider"), F.lit("seed").alias("direction"), F.lit(0).alias("iteration"))
        self.provenance = durable(seed)
        self.events.append(exports.audit_line("seed_resolved", n=n, unresolved=lost))
        self.n_seeds = n
        return n

    def step(self) -> DataFrame | None:
        """The next round's ranked candidates (rank, key, score); None when the run is over."""
        if self.phase == AWAITING:
            return self.pending
        if self.phase == STOPPED:
            return None
        if self.n >= self.settings.max_iterations:
            return self._stop("max_iterations")
        # works that are not resolved have nothing to expand
        ready = self.frontier.join(self.works.where("not coalesce(unresolved, false)").select("key"), "key", "left_semi")
        ready = durable(ready.withColumn("trial", F.lit("t")))
        self.expanded = durable(self.expanded.union(self.frontier.select("key")).distinct())
        if ready.isEmpty():
            self._finish(0, 0, 0, 0)
            return None
        self.n += 1
        found = durable(expand.neighbours(self.edges, ready, self.works, self.settings.directions).withColumn("iteration", F.lit(self.n)))
        self.provenance = durable(self.provenance.unionByName(found))
        raw = durable(self.works.join(found.select("key").distinct(), "key", "left_semi"))
        records = raw.select("key", "title_norm", "year", S.normalize_surname(F.get("authors", F.lit(0))["surname"]).alias("surname"), "doi")
        labels, matched = resolve.resolve(records, self.settings.dedup)
        labels = durable(labels)
        new = durable(labels.where("not suspicious and key <> rep").select("key", "rep"))
        events = durable(resolve.merge_events(labels, matched))
        self.merges = durable(self.merges.union(events.select("rep", "members", "tier", F.col("score").cast("double"))))
        if not new.isEmpty():
            self._merge(raw, durable(labels.where("not suspicious").select("key", "rep")), new)
        self.provenance = durable(resolve.apply_aliases(self.provenance, self.aliases))
        merged = self.works.join(resolve.apply_aliases(raw.select("key"), self.aliases).distinct(), "key", "left_semi")
        fresh = durable(eligibility.fresh(merged, self.decisions).withColumn("reason", eligibility.reason(self.settings.eligibility)))
        for r in fresh.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason").collect():  # a row for each reason
            self.rejected.append({"iteration": self.n, "reason": r.reason, "n": r.n})
            self.events.append(exports.audit_line("ineligible", iteration=self.n, reason=r.reason, n=r.n))
        terms = S.tokenize(F.concat_ws(" ", "title", "abstract"))
        eligible = fresh.where("reason is null").withColumn("terms", terms)
        inc = self.works.join(self.decisions.where(F.col("decision") == INCLUDE), "key", "left_semi").withColumn("terms", terms)
        scores = rank.build(self.settings.ranker)(inc, eligible, self.provenance, self.vectors)
        self.pending = durable(rank.top(scores, self.settings.top_k))
        self.manifest.record(self.n, candidates=hash_rows(self.pending.select("rank", "key", F.round("score", 8).alias("score"))))
        self._counts = ready.count(), found.count(), merged.count(), eligible.count()
        self.phase = AWAITING
        if self.pending.isEmpty():
            return self.label(self._empty("key string, decision string"), allow_empty=True)
        return self.pending

    def _merge(self, raw: DataFrame, labels: DataFrame, new: DataFrame) -> None:
        """Puts the works that resolve to one into the registry as one; edges go by its key from now on."""
        together = durable(labels.join(new.select("rep").distinct(), "rep", "left_semi").select("key", "rep"))
        merged = durable(resolve.merge(raw.join(together.select("key"), "key", "left_semi"), together, self.settings.dedup.precedence))
        self.registry = durable(resolve.upsert(self.registry, merged, new))
        self.works = durable(resolve.upsert(self.works, merged, new))
        self.aliases = durable(resolve.flatten_aliases(self.aliases.union(new)).select(F.col("key"), F.col("rep")).where("key <> rep")) if not self.aliases.isEmpty() else new
        self.edges = durable(resolve.apply_aliases(resolve.apply_aliases(self.edges, new, "src"), new, "dst").distinct())

    def label(self, labels: DataFrame, allow_empty: bool = False) -> None:
        """Takes decisions (key, decision) on pending records; of repeated keys any one counts. Then the rules decide."""
        if self.phase != AWAITING:
            raise LabelError("no records wait for labels")
        rows = durable(labels.where("key <> ''").select("key", F.lower("decision").alias("decision")).dropDuplicates(["key"]))
        unknown = rows.join(self.pending.select("key"), "key", "left_anti").count()
        if unknown:
            raise LabelError(f"{unknown} labels are for records that do not wait for one")
        wrong = rows.where(~F.col("decision").isin(INCLUDE, EXCLUDE, "")).count()
        if wrong:
            raise LabelError(f"{wrong} labels are neither include nor exclude")
        said = rows.where("decision <> ''")
        if said.isEmpty() and not allow_empty:
            raise LabelError("no label says anything")
        self.decisions = durable(self.decisions.join(said, "key", "left_anti").union(said.select("key", "decision")))
        new = said.where(F.col("decision") == INCLUDE).select("key")
        self.frontier = durable(expand.enqueue(new, self.expanded, self._empty("key string")))
        n = said.count()
        included = new.count()
        self._finish(n, included, *self._counts[1:3])

    def _finish(self, screened: int, included: int, raw: int, deduped: int) -> None:
        before = self.rounds[-1] if self.rounds else {"cumulative_screened": 0, "cumulative_included": self.n_seeds}
        left = self.frontier.join(self.expanded, "key", "left_anti").count() if self.phase == AWAITING else 0
        self.rounds.append(
            {
                "trial": "t",
                "n": self.n,
                "n_raw": raw,
                "n_after_dedup": deduped,
                "n_screened": screened,
                "n_included": included,
                "cumulative_screened": before["cumulative_screened"] + screened,
                "cumulative_included": before["cumulative_included"] + included,
                "frontier_size": left,
                "yield_rate": included / screened if screened else 0.0,
            }
        )
        found = self.estimate()
        self.trail.append({"trial": "t", "n": self.n, "estimable": bool(found.get("estimable")), "n_hat": found.get("n_hat"), "recall": found.get("recall"), "recall_low": found.get("recall_low")})
        self.pending, self.phase = None, READY
        decision = stopping.rule_set(self.evaluate(), [r for r, _ in self.settings.rules], self.settings.combine).where(F.col("n") == self.n).collect()
        if decision and decision[0].stop:
            self._stop(decision[0].stopped_by)

    def history(self) -> DataFrame:
        ddl = "trial string, n int, n_raw long, n_after_dedup long, n_screened long, n_included long, cumulative_screened long, cumulative_included long, frontier_size long, yield_rate double"
        return self._rows(self.rounds, ddl)

    def evaluate(self) -> DataFrame:
        """The decisions of all rules for all rounds; exhaustion is always among them."""
        rules = dict(self.settings.rules) | {"exhaustion": {}}
        h = self.history()
        trail = self._rows(self.trail, "trial string, n int, estimable boolean, n_hat double, recall double, recall_low double")
        return stopping.evaluate(h, trail, rules)

    def _stop(self, why: str | None) -> None:
        self.phase, self.stopped_by = STOPPED, why
        self.events.append(exports.audit_line("stopped", rule=why, iteration=self.n))

    def estimate(self, method: str | None = None) -> dict:
        """The recall estimate of the included works over the settings' arms."""
        arms = self.settings.arms
        if len(arms) < 2:
            return {"method": method or self.settings.stop_method, "estimable": False, "reason": "fewer_than_two_arms"}
        inc = self.decisions.where(F.col("decision") == INCLUDE)
        rows = estimate.with_sets(self.provenance.where("direction <> 'seed'"), self.members)
        h = durable(estimate.capture_histories(rows, inc, {a.name: estimate.arm_predicate(a, set(self.members)) for a in arms}))
        return estimate.estimate_recall(h, [a.name for a in arms], method or self.settings.stop_method)

    def run_to_saturation(self, screen: Callable[[DataFrame], DataFrame]) -> None:
        """Steps and labels until the run stops; screen: candidates to (key, decision)."""
        while self.phase != STOPPED:
            pending = self.step()
            if pending is not None and self.phase == AWAITING:
                self.label(screen(pending), allow_empty=True)

    def counts(self) -> dict[str, int]:
        """The flow diagram's counts."""
        w = self.provenance.groupBy("key").agg(F.collect_set("direction").alias("directions"))
        bad = self.spark.createDataFrame([(r["n"],) for r in self.rejected], "n long")
        return prisma.counts(w, self.decisions, self.merges, bad).collect()[0].asDict()

    def report(self) -> str:
        """The run in Markdown."""
        said = [r.asDict() for r in self.evaluate().orderBy("n", "rule").collect()] if self.rounds else []  # rules times rounds
        return exports.report(self.counts(), self.rounds, self.estimate(), said)

    def save(self, path: str) -> None:
        """Everything that ``load`` needs, one table for each collection and one JSON text."""
        for name in TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        if self.pending is not None:
            self.pending.write.mode("overwrite").parquet(f"{path}/pending")
        state = {k: getattr(self, k) for k in ("phase", "n", "n_seeds", "rounds", "trail", "rejected", "events", "stopped_by")}
        state["manifest"] = self.manifest.data
        state["counts"] = list(getattr(self, "_counts", (0, 0, 0, 0)))
        self.spark.createDataFrame([(canonical(state),)], "state string").write.mode("overwrite").json(f"{path}/state")

    @classmethod
    def load(cls, path: str, works: DataFrame, edges: DataFrame, settings: RunSettings = RunSettings(), **more: object) -> Run:  # noqa: B008
        run = cls(works, edges, settings, **more)
        state = json.loads(run.spark.read.json(f"{path}/state").collect()[0].state)
        run.manifest.data = state.pop("manifest")
        for k, v in state.items():
            setattr(run, "_counts" if k == "counts" else k, v)
        for name in TABLES:
            setattr(run, name, durable(run.spark.read.parquet(f"{path}/{name}")))
        if not run.aliases.isEmpty():
            run.works = durable(resolve.upsert(works, run.registry, run.aliases))
            run.edges = durable(resolve.apply_aliases(resolve.apply_aliases(run.edges, run.aliases, "src"), run.aliases, "dst").distinct())
        if run.phase == AWAITING:
            run.pending = durable(run.spark.read.parquet(f"{path}/pending"))
        return run
