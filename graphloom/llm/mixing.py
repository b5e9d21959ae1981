"""Mixing sources to target weights: certain whole copies, then Pareto order sampling.

A source's target, in words, is its share of the mix by weight; no source gives more than `most` times its size, and
what it cannot give goes to the others by weight. A document's expected copies are target / source size, times its
preference if there is one: the whole part is certain, the rest is its inclusion odds. Documents are ranked by
random odds over inclusion odds (Pareto order sampling) and taken in that order until none fits into what the source's target
leaves. Only DataFrame operations; the random numbers are digests of doc_id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.scratch import Scratch

#: Words are runs of characters other than ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Buckets of the Pareto order for each source: running totals inside a bucket, and over the buckets' sums.
BUCKETS = 4096


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the key's digest."""
    digits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long")
    return (digits + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """sizes with target, from its columns source and source_size. Weights go round over the sources by code point, null last.

    Sources in the order of the level at which they are full: the first one that the common level does not fill sets
    that level for all that follow. One row for each source is all that meets in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1)
    weighed = sizes.withColumn("weight", pick.cast("double")).withColumn("top", F.lit(float(most)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("top").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    total = F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy())
    level = (total - before) / after
    levels = weighed.withColumn("level", F.when(level * F.col("weight") <= F.col("top"), level))
    common = F.first("level", ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.select(*sizes.columns, F.coalesce(F.least(F.col("top"), common * F.col("weight")), F.col("top")).alias("target")).drop("source")


def mix_plan(docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, most: int = 2, preference: str | None = None) -> DataFrame:
    """(doc_id, text_hash, source_key, nth, size, source_size, target, copies, taken) for each row of docs(doc_id, text, source).

    size: words of the text (null: 0). taken = copies * size, and copies are `most` at most. A null source is a source
    of its own. `preference` names a column of positive numbers that make a document's odds of being taken larger or
    smaller than its source's (null and absent: 1). Repeated rows count each; equal rows are interchangeable and told
    apart by nth. Of documents that tie in the order the smaller doc_id comes first. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    liking = F.lit(1.0) if preference is None else F.coalesce(F.greatest(F.col(preference).cast("double"), F.lit(0.0)), F.lit(1.0))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    light = docs.select(F.col("doc_id").alias("id"), "source", _source_key().alias("key"), size.alias("size"), liking.alias("liking"), F.xxhash64("text").alias("text_hash"))
    light = scratch.table(light)
    sizes = light.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("liking")).alias("liked"))
    targets = source_targets(sizes, list(weights), share, most)
    expected = F.least(F.lit(float(most)), F.when(F.col("liked") > 0, F.col("target") * F.col("liking") / F.col("liked")).otherwise(0.0))
    rows = light.drop("source").join(scratch.table(targets), "key").withColumn("expected", expected)
    whole = F.floor("expected").cast("int")
    odds = F.col("expected") - whole
    u = uniform(F.col("id"))
    rank = F.when(odds > 0, (u / (1 - u)) / (odds / (1 - odds)))
    rows = rows.select("id", "text_hash", "key", "size", "source_size", "target", whole.alias("copies"), rank.alias("rank"))
    # buckets follow the order and are about even: at the source's own odds the scaled rank is u / (1 - u)
    level = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    usual = F.least(F.greatest(level - F.floor(level), F.lit(1e-9)), F.lit(1 - 1e-9))
    scaled = F.col("rank") * usual / (1 - usual)
    rows = rows.withColumn("bucket", F.least(F.lit(BUCKETS - 1), F.floor(scaled / (1 + scaled) * BUCKETS)).cast("int"))
    rows = _fill(scratch.table(rows), scratch)
    nth = F.row_number().over(Window.partitionBy("id", "text_hash", "key").orderBy(F.desc("copies")))
    out = rows.select(F.col("id").alias("doc_id"), "text_hash", F.col("key").alias("source_key"), nth.alias("nth"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    out = scratch.table(out)
    scratch.keep(out)
    scratch.close()
    return out


def mix_sources(docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, most: int = 2, preference: str | None = None) -> DataFrame:
    """The mix itself: each row of docs as often as the plan takes it, with the columns of docs.

    Rows that are equal in doc_id, text and source are numbered, and the plan says of how many of them it takes a first, second, ... copy. So rows
    and plan meet by one key, a digest, with one row of the plan for each; texts are dealt out once.
    """
    name = lambda key: F.md5(F.to_json(F.struct(F.col("doc_id"), F.col("text_hash"), F.col(key).alias("key"))))
    plan = mix_plan(docs, weights, share, most, preference).groupBy(name("source_key").alias("at")).agg(F.array(*(F.count_if(F.col("copies") >= j) for j in range(1, most + 1))).alias("firsts"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, F.col("doc_id"), F.xxhash64("text").alias("text_hash"), _source_key().alias("key")).select("row", name("key").alias("at"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("at").orderBy(F.lit(0))))
    copies = F.size(F.filter("firsts", lambda n: n >= F.col("nth")))
    found = rows.join(plan.where("firsts[0] > 0"), "at").select("row", copies.alias("copies")).where("copies > 0")
    return found.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


def _source_key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))


def _fill(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows after every source has taken, in order, documents that fit into what it lacks, until none does.

    A pass takes the first ones in order as long as their sizes fit together; those larger than what is left then are out, the others meet again.
    The first that fits is always taken, so passes end; a pass is over what the one before it left open.
    """
    room = rows.groupBy("key").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("room"))
    columns = ["id", "text_hash", "key", "size", "source_size", "target", "copies"]
    out, open_ = rows.where("rank IS NULL").select(*columns), rows.where("rank IS NOT NULL")
    while True:
        room = scratch.table(room)  # a row for each source, of known size: no row of documents is dealt by its source
        asked = open_.join(room, "key")
        fits = F.col("size") <= F.col("room")
        sums = scratch.table(asked.where(fits).groupBy("key", "bucket").agg(F.sum("size").alias("in_bucket")))  # a source's task gets a row for each bucket and no more
        if sums.isEmpty():
            return out.unionByName(open_.select(*columns))
        before = F.sum("in_bucket").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        sums = sums.select("key", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
        inside = F.sum("size").over(Window.partitionBy("key", "bucket").orderBy("rank", "id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0))
        ranked = asked.where(fits).withColumn("inside", inside).join(sums, ["key", "bucket"])
        ranked = scratch.table(ranked.select(*columns, "rank", "bucket", (F.col("before") + F.col("inside") <= F.col("room")).alias("taken")))
        out = out.unionByName(asked.where(~fits).select(*columns)).unionByName(ranked.where("taken").withColumn("copies", F.col("copies") + 1).select(*columns))
        spent = ranked.where("taken").groupBy("key").agg(F.sum("size").alias("spent"))
        room = room.join(spent, "key", "left").select("key", (F.col("room") - F.coalesce("spent", F.lit(0))).alias("room"))
        open_ = ranked.where("NOT taken").drop("taken")
