"""The pattern library: matching, observation, stabilisation and promotion of pattern centroids over sessions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from graphloom.config import Config
from graphloom.functions.vectors import TINY, norm
from graphloom.operators.components import connected_components
from graphloom.operators.similarity import linking_forest, similarity_join
from graphloom.schemas import OBSERVATIONS, STRUCTURAL
from graphloom.scratch import Scratch
from graphloom.session import held

#: New rows that are compared with a group's observations at once, and observations that are put out at once; products that are held at once.
FOLD_ROWS, FOLD_CELLS = 256, 4_000_000
DISTRIBUTIONS = "obs_id string, session_no int, degrees array<double>"


@dataclass(frozen=True)
class Library:
    """structural and observations as in schemas; distributions(obs_id, session_no, degrees): what each session's graph was like."""

    structural: DataFrame
    observations: DataFrame
    distributions: DataFrame


def empty_library(spark: SparkSession) -> Library:
    return Library(spark.createDataFrame([], STRUCTURAL), spark.createDataFrame([], OBSERVATIONS), spark.createDataFrame([], DISTRIBUTIONS))


def match(vectors: DataFrame, structural: DataFrame, threshold: float = 0.75, below: float | None = None) -> DataFrame:
    """(node_id, pattern_id, similarity): patterns like each of vectors(node_id, embedding); with `below`, strictly between the two (the band of anomalies)."""
    return similarity_join(vectors.select("node_id", F.col("embedding").alias("v")), structural.select(F.col("node_id").alias("pattern_id"), F.col("pattern_embedding").alias("v")), threshold, "node_id", "pattern_id", below)


def boost(nodes: DataFrame, matches: DataFrame, config: Config = Config()) -> DataFrame:
    """Nodes with a match become more active by a share of its similarity, up to 1."""
    top = matches.groupBy("node_id").agg(F.max("similarity").alias("_top"))
    raised = F.when(F.col("_top").isNotNull(), F.least(F.lit(1.0), F.col("activation") + config.activation_boost * F.col("_top"))).otherwise(F.col("activation"))
    return nodes.join(top, "node_id", "left").withColumn("activation", raised).select(*nodes.columns)


def unmatched(nodes: DataFrame, matches: DataFrame) -> DataFrame:
    return nodes.where(F.col("embedding").isNotNull()).join(matches.select("node_id").distinct(), "node_id", "left_anti").select(*nodes.columns)


def refine_all(structural: DataFrame, contents: DataFrame, config: Config = Config()) -> DataFrame:
    """The patterns after contents(node_id, embedding, ord) that lie in the band around them: each moves its centroid a little, in order.

    Which contents lie in the band is decided by the centroids at the start.
    """
    band = match(contents, structural, config.reactivation_low, config.reactivation_high)
    hits = band.join(contents.select("node_id", "embedding", "ord"), "node_id").join(structural.select(F.col("node_id").alias("pattern_id"), "pattern_embedding"), "pattern_id")
    alpha = config.refinement_alpha

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        centre = np.array(rows["pattern_embedding"].iloc[0], dtype=float)
        for x in rows["embedding"]:
            centre = centre * (1.0 - alpha) + np.array(x, dtype=float) * alpha
            length = np.linalg.norm(centre)
            centre = centre / length if length > 1e-10 else centre
        return pd.DataFrame({"pattern_id": [rows["pattern_id"].iloc[0]], "_v": [centre.tolist()], "_n": [len(rows)]})

    moved = hits.select("pattern_id", "embedding", "ord", "pattern_embedding").groupBy("pattern_id").applyInPandas(fold, "pattern_id string, _v array<double>, _n int")
    out = structural.join(moved, structural["node_id"] == moved["pattern_id"], "left")
    out = out.withColumn("pattern_embedding", F.coalesce("_v", "pattern_embedding")).withColumn("reactivation_count", F.col("reactivation_count") + F.coalesce("_n", F.lit(0))).withColumn("attention_mode", F.when(F.col("_n").isNotNull(), "infrastructure").otherwise(F.col("attention_mode")))
    return out.select(*structural.columns)


def observe(observations: DataFrame, nodes: DataFrame, entity_id: str = "unknown", config: Config = Config(), mode: str = "first") -> DataFrame:
    """The observations after nodes(label, embedding, ord): each joins the first one (mode 'best': the nearest) similar enough, else begins its own.

    The outcome depends on the order, so this is a fold; but only over nodes and observations that can meet. Whatever joins an observation
    is similar, to the square of the threshold at least, to one of those that make up its centroid (for the centroid of vectors that each
    joined at a cosine of t has t times their mean length at least). So a forest of the nodes' links at the squared threshold is found first,
    never all links, and each connected group is folded by itself, in order, as its rows stream past: what is held is the group's observations.
    A new observation's id is a digest of its label and vector.
    """
    threshold = config.observation_merge_threshold
    old = observations.withColumn("_new", F.lit(False)).withColumn("label", F.lit(None).cast("string")).withColumn("_key", F.concat(F.lit("o"), "node_id"))
    new = nodes.where(F.col("embedding").isNotNull() & (norm(F.col("embedding")) >= TINY)).select(F.lit(None).cast("string").alias("node_id"), F.col("embedding").alias("pattern_embedding"), F.lit(0).alias("confirmation_count"), F.lit(0.0).alias("diversity_score"), F.lit(0.0).alias("stabilisation_score"), F.lit(0).alias("sessions_active"), F.array().cast("array<string>").alias("example_labels"), F.expr("CAST(map() AS MAP<STRING, INT>)").alias("entity_firing_counts"), F.lit(True).alias("_new"), "label", F.col("ord").cast("long").alias("ord"))
    new = new.withColumn("_key", F.concat(F.lit("n"), F.col("ord").cast("string"), F.lit("|"), F.coalesce("label", F.lit(""))))
    rows = held(old.withColumn("ord", F.lit(None).cast("long")).select(*new.columns).unionByName(new))
    vector = rows.select(F.col("_key").alias("a"), F.col("pattern_embedding").alias("v"))
    fresh = rows.where("_new").select(F.col("_key").alias("b"), F.col("pattern_embedding").alias("v"))
    scratch = Scratch(observations.sparkSession, "observe")
    groups = scratch.table(connected_components(linking_forest(vector, fresh, threshold * threshold - 1e-9), scratch))
    grouped = rows.join(groups, rows["_key"] == groups["id"], "left").withColumn("_group", F.coalesce("component", "_key")).select("_group", *(c for c in new.columns if c != "_key"))
    schema = to_arrow_schema(StructType.fromDDL(OBSERVATIONS))

    def observed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        group, there = None, _Fold(threshold, mode, entity_id)
        for batch in batches:
            names = batch.column("_group").to_pylist()
            starts = [i for i, name in enumerate(names) if not i or name != names[i - 1]]
            for at, stop in zip(starts, [*starts[1:], len(names)], strict=True):
                if names[at] != group:
                    yield from there.rows()
                    group, there = names[at], _Fold(threshold, mode, entity_id)
                there.take(batch.slice(at, stop - at))
        yield from there.rows()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = observed(batches)
        while some := list(islice(rows, FOLD_ROWS)):
            yield pa.RecordBatch.from_pylist(some, schema)

    ordered = grouped.repartition("_group").sortWithinPartitions("_group", "_new", F.asc_nulls_last("ord"), F.asc_nulls_last("node_id"), "label")
    return ordered.mapInArrow(fold, OBSERVATIONS)


class _Fold:
    """The observations of one group, whose vectors have one length, and how they take rows in, in the order of these."""

    def __init__(self, threshold: float, mode: str, entity_id: str):
        self.threshold, self.mode, self.entity_id = threshold, mode, entity_id
        self.facts: list[dict] = []
        self.centres, self.lengths = np.zeros((0, 0)), np.zeros(0)

    def take(self, batch: pa.RecordBatch) -> None:
        n_old = batch.num_rows - pc.sum(batch.column("_new")).as_py()  # older observations come first
        for r in batch.slice(0, n_old).to_pylist():
            self._add(r | {"entity_firing_counts": dict(r["entity_firing_counts"])}, np.array(r["pattern_embedding"], dtype=float))
        at = n_old
        while at < batch.num_rows:
            some = batch.slice(at, max(1, min(FOLD_ROWS, FOLD_CELLS // (len(self.facts) + 1))))
            at += some.num_rows
            flat = some.column("pattern_embedding").flatten().to_numpy(zero_copy_only=False).astype(float)
            self._take_block(flat.reshape(some.num_rows, -1), some.column("label").to_pylist())

    def _take_block(self, block: np.ndarray, labels: list) -> None:
        """All products with the observations before the block are made at once; only those with observations that the block has changed are made again."""
        sizes = np.linalg.norm(block, axis=1)
        before = len(self.facts)
        self._make_room(before + len(block), block.shape[1])
        near = np.full((len(block), before + len(block)), -np.inf)
        near[:, :before] = self._cosines(block, sizes, slice(0, before))
        changed = np.zeros(before + len(block), dtype=bool)
        for i, (x, label) in enumerate(zip(block, labels, strict=True)):
            again = np.flatnonzero(changed)
            near[i, again] = self._cosines(block[i : i + 1], sizes[i : i + 1], again)[0]
            own = near[i, : len(self.facts)]
            at = int(np.argmax(own if self.mode == "best" else own >= self.threshold)) if len(own) else -1
            if at < 0 or not own[at] >= self.threshold:
                at = self._add({"node_id": hashlib.sha256(f"{label}|{x.tolist()}".encode()).hexdigest()[:32], "confirmation_count": 0, "diversity_score": 0.0, "stabilisation_score": 0.0, "sessions_active": 0, "example_labels": [], "entity_firing_counts": {}}, x)
            o = self.facts[at]
            n = o["confirmation_count"]
            self._move(at, (self.centres[at] * n + x) / (n + 1))
            o["confirmation_count"] = n + 1
            o["example_labels"] = [*o["example_labels"], label][-5:]
            o["entity_firing_counts"][self.entity_id] = o["entity_firing_counts"].get(self.entity_id, 0) + 1
            changed[at] = True

    def _cosines(self, block: np.ndarray, sizes: np.ndarray, of: slice | np.ndarray) -> np.ndarray:
        return block @ self.centres[of].T / np.maximum(1e-10, sizes[:, None] * self.lengths[of])

    def _make_room(self, n: int, width: int) -> None:
        if n > len(self.centres):
            more = max(n, 2 * len(self.centres)) - len(self.centres)
            self.centres = np.vstack([self.centres.reshape(-1, width), np.zeros((more, width))])
            self.lengths = np.append(self.lengths, np.zeros(more))

    def _add(self, facts: dict, centre: np.ndarray) -> int:
        self._make_room(len(self.facts) + 1, len(centre))
        self.facts.append(facts)
        self._move(len(self.facts) - 1, centre)
        return len(self.facts) - 1

    def _move(self, at: int, centre: np.ndarray) -> None:
        self.centres[at], self.lengths[at] = centre, np.linalg.norm(centre)

    def rows(self) -> Iterator[dict]:
        for o, v in zip(self.facts, self.centres, strict=False):
            yield o | {"pattern_embedding": v.tolist(), "entity_firing_counts": list(o["entity_firing_counts"].items())}


def wasserstein_pairs(distributions: DataFrame) -> DataFrame:
    """(obs_id, a, b, distance): the first Wasserstein distance of each two sessions' degree sequences, as equally weighted samples.

    An observation has as many sessions as it may stay unconfirmed at most. The distance is the area between the two distribution functions.
    """
    each = distributions.select("obs_id", "session_no", "degrees", F.size("degrees").alias("n")).where("n > 0")
    pairs = each.alias("x").join(each.alias("y"), (F.col("x.obs_id") == F.col("y.obs_id")) & (F.col("x.session_no") < F.col("y.session_no")))
    pairs = pairs.select("x.obs_id", F.col("x.session_no").alias("a"), F.col("y.session_no").alias("b"), F.col("x.degrees").alias("da"), F.col("y.degrees").alias("db"))
    values = pairs.select("obs_id", "a", "b", F.array_sort(F.array_distinct(F.concat("da", "db"))).alias("at"), "da", "db")
    share = lambda d, t: F.size(F.filter(d, lambda v: v <= t)) / F.size(d)
    steps = F.transform(F.sequence(F.lit(1), F.size("at") - 1), lambda i: F.abs(share(F.col("da"), F.element_at("at", i)) - share(F.col("db"), F.element_at("at", i))) * (F.element_at("at", i + 1) - F.element_at("at", i)))
    area = F.when(F.size("at") > 1, F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)
    return values.select("obs_id", "a", "b", area.alias("distance"))


def specificity(counts: Column) -> Column:
    """The largest share of one entity in a map of counts; 0 for an empty one."""
    total = F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(total > 0, F.array_max(F.map_values(counts)) / total).otherwise(0.0)


def merge_counts(a: Column, b: Column) -> Column:
    """Two maps of counts added up."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def evaluate(observations: DataFrame, distributions: DataFrame, config: Config = Config()) -> DataFrame:
    """The observations with diversity_score and stabilisation_score as they are now, and whether each is ready to be promoted.

    Scores change only where there are enough confirmations and two sessions at least.
    """
    spread = wasserstein_pairs(distributions).groupBy("obs_id").agg(F.avg("distance").alias("_d"))
    sessions = distributions.groupBy("obs_id").agg(F.count(F.lit(1)).alias("_s"))
    rows = observations.join(spread, observations["node_id"] == spread["obs_id"], "left").drop("obs_id").join(sessions, observations["node_id"] == sessions["obs_id"], "left").drop("obs_id")
    scored = (F.col("confirmation_count") >= config.min_confirmations) & (F.coalesce("_s", F.lit(0)) >= 2)
    score = F.least(F.lit(1.0), F.col("confirmation_count") / 10.0) * F.coalesce("_d", F.lit(0.0))
    rows = rows.withColumn("diversity_score", F.when(scored, F.coalesce("_d", F.lit(0.0))).otherwise(F.col("diversity_score"))).withColumn("stabilisation_score", F.when(scored, score).otherwise(F.col("stabilisation_score")))
    ready = scored & (F.col("stabilisation_score") >= config.stabilisation_threshold) & (specificity(F.col("entity_firing_counts")) < config.entity_specificity_threshold)
    return rows.select(*observations.columns, ready.alias("ready"))


def post_session(library: Library, degrees: DataFrame, config: Config = Config()) -> tuple[Library, DataFrame]:
    """The library after a session whose graph has these degrees (one row), and one row of counts.

    Every observation has been active once more and gets the session's degrees; the ready ones become structural patterns, without
    labels and entities; of the rest those active too long go.
    """
    active = library.observations.withColumn("sessions_active", F.col("sessions_active") + 1)
    now = active.select(F.col("node_id").alias("obs_id"), F.col("sessions_active").alias("session_no")).join(F.broadcast(degrees.select("degrees").limit(1)), F.lit(True))
    distributions = library.distributions.unionByName(now.select("obs_id", F.col("session_no").cast("int").alias("session_no"), "degrees"))
    judged = evaluate(active, distributions, config)
    stale = ~F.col("ready") & (F.col("sessions_active") >= config.max_observation_sessions)
    promoted = judged.where("ready").select("node_id", "pattern_embedding", F.col("sessions_active").alias("session_count"), "diversity_score", F.lit(True).alias("is_generalised"), F.lit("infrastructure").alias("attention_mode"), F.lit(0).alias("reactivation_count"))
    kept = judged.where(~F.col("ready") & ~stale).drop("ready")
    counts = judged.agg(F.count(F.lit(1)).alias("observation_nodes_evaluated"), F.count_if("ready").alias("nodes_promoted"), F.count_if(~F.col("ready") & ~stale).alias("nodes_still_in_observation"), F.count_if(stale).alias("stale_nodes_pruned"))
    remaining = distributions.join(kept.select(F.col("node_id").alias("obs_id")), "obs_id", "left_semi").select(*distributions.columns)
    return Library(library.structural.unionByName(promoted.select(*library.structural.columns)), kept, remaining), counts


def infrastructure_cost(structural: DataFrame) -> DataFrame:
    infra = F.count_if(F.col("attention_mode") == "infrastructure")
    total = F.count(F.lit(1))
    return structural.agg(total.alias("total"), infra.alias("infrastructure"), (total - infra).alias("active"), (infra / F.greatest(total, F.lit(1))).alias("fraction"), F.count_if("is_generalised").alias("generalised"))


def library_summary(library: Library) -> DataFrame:
    """infrastructure_cost with the number of observations that sessions have said something of."""
    candidates = library.distributions.agg(F.count_distinct("obs_id").alias("candidates"))
    return infrastructure_cost(library.structural).join(candidates, F.lit(True))  # one row each


def record_distribution(library: Library, obs_id: str, degrees: list[float]) -> Library:
    """The library with one more session's degrees for an observation, after those it has."""
    last = library.distributions.where(F.col("obs_id") == obs_id).agg(F.coalesce(F.max("session_no"), F.lit(0)) + 1).first()[0]
    row = library.distributions.sparkSession.createDataFrame([(obs_id, last, [float(x) for x in degrees])], DISTRIBUTIONS)
    return Library(library.structural, library.observations, library.distributions.unionByName(row))


def session_distributions(library: Library, obs_id: str) -> DataFrame:
    """(session_no, degrees) of an observation, in order."""
    return library.distributions.where(F.col("obs_id") == obs_id).select("session_no", "degrees").orderBy("session_no")


def entity_counts(library: Library, obs_id: str) -> DataFrame:
    """(entity, n): how often each entity fired an observation."""
    return library.observations.where(F.col("node_id") == obs_id).select(F.explode("entity_firing_counts").alias("entity", "n"))


def firing_patterns(structural: DataFrame, matches: DataFrame) -> DataFrame:
    """The patterns that some node matches."""
    return structural.join(matches.select(F.col("pattern_id").alias("node_id")).distinct(), "node_id", "left_semi").select(*structural.columns)


def confirmation_report(observations: DataFrame) -> DataFrame:
    """(confirmation_count, n): the histogram of confirmations."""
    return observations.groupBy("confirmation_count").agg(F.count(F.lit(1)).alias("n"))


def diversity_report(observations: DataFrame, least: int = 5) -> DataFrame:
    s = "diversity_score"
    return observations.agg(F.min(s).alias("least"), F.max(s).alias("most"), F.avg(s).alias("mean"), F.count_if(F.col(s) > 0).alias("above_zero"), F.count_if(F.col("confirmation_count") >= least).alias("often_confirmed"))


def most_confirmed(observations: DataFrame, k: int = 5) -> DataFrame:
    return observations.orderBy(F.desc("confirmation_count"), "node_id").limit(k)


def get(rows: DataFrame, node_id: str) -> DataFrame:
    return rows.where(F.col("node_id") == node_id)


def without(rows: DataFrame, node_id: str) -> DataFrame:
    return rows.where(F.col("node_id") != node_id)
