"""Mix sources to target weights along a golden-ratio schedule.

Each source's documents are laid end to end in a hashed order and cut into blocks of equal word counts. Slot t of the
mix has the point frac(t * golden ratio); the source whose share of the cumulative weights holds that point fills the
slot with its next block, and starts over at the end of its documents. Quotas in words end a source's slots, so each
source gives its target to the word; the few slots that a source lacks at the end are appended.

Edge cases: a null text has size 0; a null source is a source of its own and comes last; repeated rows count as often
as they occur; a source without words takes nothing; a null doc_id is mixed like any other; extra columns, of any
names, stay as they are in mixed() and are ignored in mix(); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm import common

GOLDEN = 0.6180339887498949
BLOCK_WORDS = 8192
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, repeats: int = MOST_REPEATS) -> dict[str | None, float]:
    """Share all words by weight; no target over repeats times its source's size, the excess reshared by weight."""
    names = sorted((s for s, _ in sizes), key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight, size = {s: weights[i % len(weights)] for i, s in enumerate(names)}, dict(sizes)
    out, open_, left = {}, set(names), float(sum(size.values()))
    while open_:
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / whole > repeats * size[s]}
        if not over:
            return out | {s: left * weight[s] / whole for s in open_}
        out |= {s: float(repeats * size[s]) for s in over}
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list, value, name: str) -> DataFrame:
    """Sum of value over the earlier rows of a group, in the order of bucket, then order: a sum within each bucket,
    plus the buckets before it, so no group meets in one task."""
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum")).select(*[F.col(c).alias(f"_{c}") for c in [*group, bucket]], "_sum")
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(*[f"_{c}" for c in group]).orderBy(f"_{bucket}").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*group, bucket]]
    return df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(sums, on).withColumn(name, F.col("_inside") + F.col("_before")).drop("_inside", "_before", *[f"_{c}" for c in [*group, bucket]])


def laid_out(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and at: the words of the source's documents before this one, in hashed order."""
    spark = docs.sparkSession
    bits = max(1, (common.order_buckets(spark) - 1).bit_length())  # a bucket is a prefix of the hash: the order is the same for any number
    d = common.texts(docs, F.col("source").cast("string").alias("source")).select("doc_id", "source", F.regexp_count("text", F.lit(common.WORD)).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("mixed"))
    d = common.materialize(d.withColumn("bucket", F.shiftrightunsigned("mixed", 64 - bits).cast("int")), "sizes")
    return running_sum(d, ["source"], "bucket", ["mixed", "doc_id", "size"], F.col("size"), "at").drop("bucket")


def schedule(spark, sizes: list[tuple[str | None, int]], target: dict[str | None, float], block: int = BLOCK_WORDS) -> DataFrame:
    """The mix's slots: slot, source, pass_no, block, words (all but a last slot take the block whole)."""
    plan, total = [], sum(target.values())
    edge = 0.0
    for s, size in sizes:
        want, per = round(target[s]), -(-size // block)
        whole = size and want // size  # passes over the source
        rest = want - whole * size
        slots = whole * per + -(-rest // block)
        share = target[s] / total if total else 0.0
        plan.append((s, size, want, per, slots, edge, edge + share))
        edge += share
    n = sum(p[4] for p in plan)
    sources = spark.createDataFrame(plan, "source string, size long, want long, per long, slots long, lo double, hi double")  # a row for each source
    t = spark.range(n).select(F.col("id").alias("slot"), (F.col("id") * GOLDEN).alias("x")).select("slot", (F.col("x") - F.floor("x")).alias("x"))
    cuts = [p for p in plan if p[4]]
    last = cuts[-1][6] if cuts else 0.0
    pick = F.size(F.filter(F.lit([p[6] for p in cuts[:-1]]).cast("array<double>"), lambda e: e <= F.col("x") * last))
    names = spark.createDataFrame([(i, p[0], p[4]) for i, p in enumerate(cuts)], "k int, source string, slots long")
    dealt = t.select("slot", pick.alias("k"), F.expr("cast(slot div 4096 as int)").alias("chunk"))
    ranked = running_sum(dealt, ["k"], "chunk", ["slot"], F.lit(1), "rank").select("slot", "k", "rank")
    ranked = ranked.join(F.broadcast(names), "k").where(F.col("rank") < F.col("slots")).select("slot", "source", "rank")
    have = ranked.groupBy("source").count()
    short = sources.where("slots > 0").join(have.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").where(F.coalesce("count", F.lit(0)) < F.col("slots"))
    added = short.select("source", F.explode(F.sequence(F.coalesce("count", F.lit(0)), F.col("slots") - 1)).alias("rank")).select((F.lit(n) + F.col("rank")).alias("slot"), "source", "rank")
    s = F.broadcast(sources.withColumnRenamed("source", "s"))
    out = ranked.unionByName(added).join(s, F.col("source").eqNullSafe(F.col("s")))
    out = out.select("slot", "source", F.expr("rank div per").alias("pass_no"), F.expr("rank % per").alias("block"), "size", "want")
    start = F.col("block") * block
    length = F.least(F.lit(block).cast("long"), F.col("size") - start)
    return out.select("slot", "source", "pass_no", "block", F.least(length, F.col("want") - F.col("pass_no") * F.col("size") - start).alias("words"))


def mix(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and mixed (a hash of doc_id and text) of every document."""
    spark = docs.sparkSession
    placed = laid_out(docs)
    sizes = [(r["source"], r["n"]) for r in placed.groupBy("source").agg(F.sum("size").alias("n")).collect()]  # a row for each source
    sizes.sort(key=lambda p: (p[0] is None, [ord(c) for c in p[0] or ""]))
    target = targets(sizes)
    uses = schedule(spark, sizes, target, block).groupBy("source", "block", "words").agg(F.count("*").alias("times"))
    uses = uses.select(F.col("source").alias("s"), F.col("block").alias("b"), "words", "times")
    span = placed.where("size > 0").select(
        "doc_id", "source", "size", "at",
        F.posexplode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))).alias("piece", "block"),
    )
    lo = F.greatest(F.col("at") - F.col("block") * block, F.lit(0))
    hi = F.least(F.col("at") + F.col("size") - F.col("block") * block, F.lit(block))
    pieces = span.select("doc_id", "source", "at", "size", "block", lo.alias("lo"), hi.alias("hi"))
    got = pieces.join(uses, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    got = got.groupBy("doc_id", "source", "at", "size").agg(F.sum(F.col("times") * F.greatest(F.least("hi", "words") - F.col("lo"), F.lit(0))).alias("taken"))
    got = got.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("at").alias("a"), F.col("size").alias("z"), "taken")
    facts = spark.createDataFrame([(s, n, target[s]) for s, n in sizes], "s2 string, source_size long, target double")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("at") == F.col("a")) & (F.col("size") == F.col("z"))
    out = placed.join(got, same, "left").join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("s2")))
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "mixed")


def mixed(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The documents, all columns as they are, each as often as the mix takes its words, to the nearest whole number
    (repeated rows share what is taken of them)."""
    key, doc, hashed, times, copy = common.fresh(docs, "key", "doc", "hashed", "times", "copy")
    uses = mix(docs, block).where("taken > 0").groupBy(F.col("doc_id").alias(doc), F.col("mixed").alias(hashed)).agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias(times))
    own = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = docs.withColumn(key, own).join(uses.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(hashed)))
    return out.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])
