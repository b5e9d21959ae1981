"""Near-duplicate groups of whole texts: fast similarity sketches, banding, exact verification.

1.  One pass over the texts makes each document's set of word shingles, a fast similarity sketch of it and the keys
    of the sketch's bands. Documents of equal sets form a class at once (named by 128 bits of the set); only a
    class's smallest id goes on, so copies cost one aggregation.
2.  Documents that share a band are candidates. Each is compared with the least document of its bucket: a number of
    pairs linear in the bucket. Links are confirmed on the full sets.
3.  Buckets whose documents now lie in one component need no more. In the others every two documents of different components
    are compared, as 0/1 matrices over their full sets, in blocks of bounded size; a comparison returns links alone. The documents of a
    bucket's commonest component are never compared with each other, so a bucket of one large component and few others stays linear.
4.  Connected components by large-star and small-star steps, in tables on the shared folder.

The bands are chosen so that a pair at the threshold is missed with a probability below one in a million if coordinates
agree independently of each other; tests measure sets smaller and larger than the sketch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import connected_components
from graphloom.operators.skew import join_facts
from graphloom.llm.batches import slices
from graphloom.scratch import Scratch
from graphloom.llm.shingles import band_keys, fast_similarity_sketch, set_key, shingle_hashes

#: A pair at the threshold may fail to share a band with at most this probability.
MISS = 1e-6
#: About how many documents and shingles a block holds at most.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 500_000


def bands_for(percent: int, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the longest bands that a sketch of about 128 coordinates allows at this chance of a miss."""
    best = (1, 1)
    for rows in range(1, 33):
        bands = math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))
        if bands * rows <= 136:
            best = (bands, rows)
    return best


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text).

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of shingles of `width`
    words. component_id is the smallest doc_id that links can reach. kept: doc_id = component_id.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows of a null doc_id are returned
    with a null component and are not kept; repeated rows are returned as often as they come. Ids name documents: an id that
    comes with different texts has the links of them all. Other columns are ignored. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    bands, rows = bands_for(percent)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    sketches = scratch.table(_sketch(texts, width, bands, rows))
    whole = sketches.where("doc_id IS NOT NULL AND n > 0")
    classes = scratch.table(whole.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")))
    name = F.struct("k1", "k2")
    several = whole.groupBy("doc_id").agg(F.min(name).alias("lo"), F.max(name).alias("hi")).where("lo != hi").select("doc_id")
    wanted = classes.select(F.col("rep").alias("doc_id")).unionByName(several)
    reps = whole.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "k1", "k2"])
    buckets = scratch.table(reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key")).distinct())
    stars = scratch.table(buckets.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("ids")).where("least < most").drop("most"))
    shared = scratch.table(join_facts(buckets, stars, "key", "ids", buckets.count()).select("key", "id", "least"))
    scratch.drop(buckets)
    sets = scratch.table(_sets(texts, shared.select("id").distinct(), width))
    first = scratch.table(_confirm(shared.where("id != least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct(), sets, percent))
    found = scratch.table(connected_components(first, scratch))
    more = scratch.table(_rest_links(_crowded(shared, found, scratch), sets, percent, scratch))
    if not more.isEmpty():
        held = found
        found = scratch.table(connected_components(held.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more), scratch))
        scratch.drop(held)
    members = classes.join(found, F.col("rep") == F.col("id"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    members = scratch.table(members)
    for frame in (sketches, members):
        scratch.keep(frame)
    scratch.close()
    out = sketches.drop("bands").join(members, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _sketch(texts: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, first, second, keys = [], [], [], []
            for text in batch.column(1):
                hashes = shingle_hashes(text.as_py(), width)
                sizes.append(len(hashes))
                a, b = set_key(hashes)
                first.append(a)
                second.append(b)
                keys.append(band_keys(fast_similarity_sketch(hashes, bands * rows), rows) if len(hashes) else np.empty(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "k1", "k2", "bands"])

    return texts.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, bands array<long>")


def _sets(texts: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, k, n, hashes) for each of the ids; k tells an id's different sets apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes = [shingle_hashes(text.as_py(), width) for text in batch.column(1)]
            keys, sizes = pa.array([set_key(h)[0] for h in hashes], pa.int64()), pa.array([len(h) for h in hashes], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), keys, sizes, pa.array([h.view(np.int64) for h in hashes], pa.list_(pa.int64()))], ["id", "k", "n", "hashes"])

    wanted = texts.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    return wanted.mapInArrow(run, "id long, k long, n long, hashes array<long>").where("n > 0").dropDuplicates(["id", "k"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. The sizes decide first, before any set is moved."""

    def side(x: str, *columns: str) -> DataFrame:
        return sets.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))

    near = pairs.join(side("a", "k", "n"), "a").join(side("b", "k", "n"), "b")
    near = near.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    full = near.join(side("a", "k", "hashes"), ["a", "k_a"]).join(side("b", "k", "hashes"), ["b", "k_b"])
    both = F.size(F.array_intersect("hashes_a", "hashes_b")).cast("long")
    return full.where(both * 100 >= (F.col("n_a") + F.col("n_b") - both) * percent).select("a", "b")


def _crowded(shared: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, id, component, major) of the buckets that hold more than one component; major: of the bucket's commonest one."""
    placed = shared.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("components"), F.sum("n").alias("ids")).where("components > 1")
    return scratch.table(join_facts(placed, mixed.select("key", F.col("top.component").alias("top"), "ids"), "key", "ids", shared.count()).select("key", "id", "component", (F.col("component") == F.col("top")).alias("major")))


def _rest_links(crowded: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The links between documents of one bucket that lie in different components, by comparing blocks with blocks.

    A bucket's documents are dealt to blocks of bounded size, those of its commonest component to blocks of their own. Each document is sent
    to the pairs of blocks that need it: every two, but for two blocks of the commonest component. Buckets of one block
    share a task's table with others. A pair of blocks returns links alone, never all pairs.
    """
    rows = scratch.table(crowded.join(sets.select("id", "k", "n"), "id"))
    blocks = lambda which: F.greatest(F.ceil(F.count(F.when(which, 1)) / F.lit(BLOCK_DOCS)), F.ceil(F.sum(F.when(which, F.col("n")).otherwise(0)) / F.lit(BLOCK_SHINGLES))).cast("int")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("ids"), blocks(F.lit(True)).alias("all"), blocks(~F.col("major")).alias("minor"), blocks(F.col("major")).alias("most"))
    total = rows.count()
    together = max(1, total // BLOCK_DOCS)
    one = F.col("all") <= 1
    rows = join_facts(rows, sizes, "key", "ids", total).select("id", "k", "key", F.when(one, F.pmod(F.xxhash64("key"), F.lit(together))).otherwise(F.col("key")).alias("grp"), one.alias("one"), F.when(one, F.lit(False)).otherwise(F.col("major")).alias("major"), F.when(one, 1).otherwise(F.col("minor")).alias("minor"), F.when(one, 0).otherwise(F.col("most")).alias("most"), "component")
    deal = lambda n: F.pmod(F.xxhash64("id", "k"), n)
    rows = rows.withColumn("block", F.when(F.col("major"), F.col("minor") + deal(F.greatest("most", F.lit(1)))).otherwise(deal("minor")).cast("int"))
    others = F.sequence(F.lit(0), F.when(F.col("major"), F.col("minor") - 1).otherwise(F.col("minor") + F.col("most") - 1))
    sent = rows.select("one", "grp", "key", "id", "k", "component", "block", F.explode(others).alias("other"))
    sent = sent.select("one", "grp", "key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "component", "id", "k")
    sent = sent.join(sets.select("id", "k", "hashes"), ["id", "k"])

    def compare(table: pa.Table) -> pa.Table:
        keys, block, ids, components = (table.column(c).to_numpy() for c in ("key", "block", "id", "component"))
        lists = table.column("hashes").combine_chunks()
        values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        order = np.argsort(keys, kind="stable")
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for rows in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
            left, right = rows[block[rows] == x], rows[block[rows] == y]
            if len(left) and len(right):
                i, j = _linked([values[offsets[r] : offsets[r + 1]] for r in left], [values[offsets[r] : offsets[r + 1]] for r in right], components[left], components[right], percent)
                found.append((ids[left[i]], ids[right[j]]))
        one, two = (np.concatenate(z) for z in zip(*found, strict=True))
        return pa.table({"a": pa.array(np.minimum(one, two), pa.int64()), "b": pa.array(np.maximum(one, two), pa.int64())})

    return sent.groupBy("one", "grp", "x", "y").applyInArrow(compare, "a long, b long").where("a < b").distinct()


def _linked(left: list[np.ndarray], right: list[np.ndarray], left_component: np.ndarray, right_component: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the sets of different components that are similar enough: overlaps are products of 0/1 matrices, made in slabs of columns."""
    sizes = np.array([len(h) for h in left]), np.array([len(h) for h in right])
    apart = left_component[:, None] != right_component[None, :]
    apart &= np.minimum(sizes[0][:, None], sizes[1][None, :]) * 100 >= np.maximum(sizes[0][:, None], sizes[1][None, :]) * percent
    if not apart.any():
        return np.nonzero(apart)
    # a column for each hash that both sides hold
    mine, own = np.unique(np.concatenate(left), return_inverse=True)
    yours, other = np.unique(np.concatenate(right), return_inverse=True)
    common = np.intersect1d(mine, yours, assume_unique=True)
    entries = []
    for names, code, n in ((mine, own, sizes[0]), (yours, other, sizes[1])):
        place = np.full(len(names), -1)
        place[np.searchsorted(names, common)] = np.arange(len(common))
        column, row = place[code], np.repeat(np.arange(len(n)), n)
        row, column = row[column >= 0], column[column >= 0]
        by_column = np.argsort(column, kind="stable")
        entries.append((row[by_column], column[by_column]))
    overlap = np.zeros(apart.shape, dtype=np.float32)
    for at in range(0, len(common), 4096):
        slabs = []
        for (row, column), n in zip(entries, apart.shape, strict=True):
            lo, hi = np.searchsorted(column, (at, at + 4096))
            slab = np.zeros((n, min(4096, len(common) - at)), dtype=np.float32)
            slab[row[lo:hi], column[lo:hi] - at] = 1
            slabs.append(slab)
        overlap += slabs[0] @ slabs[1].T
    overlap = overlap.astype(np.int64)
    return np.nonzero(apart & (overlap * 100 >= (sizes[0][:, None] + sizes[1][None, :] - overlap) * percent))
