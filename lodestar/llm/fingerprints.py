"""Winnowing fingerprints, with DataFrame functions alone.

Words (lower-cased; pieces of at most 16 characters of longer ones) get 31-bit hashes; each run of K words the
polynomial hash that rolls over them, (h1*B^(K-1) + ... + hK) mod P. Each WIDTH hashes in a row give up their least,
the rightmost of equal ones; what is chosen, with its position, is the fingerprint. So two texts that share
K + WIDTH - 1 words in a row share a chosen hash, and no shared run of under K words can match.

Likeness is the Dice coefficient of the two sets of chosen hashes.

Edge cases: a null or empty text, and one without words, has an empty fingerprint, and two such are alike to 1, to
any other 0; a text of under K words has one hash over all of them, one of under K + WIDTH - 1 words one window; equal
texts have equal fingerprints; rows with one doc_id are ordered by text, a null doc_id comes last in descending order;
a table of one row is its own next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm import common

K, WIDTH = 5, 8
P, B = (1 << 31) - 1, 1_000_003
POSITIONS = 1 << 32


def chosen(text: Column) -> Column:
    """array<bigint>: the chosen hashes, hash * 2^32 + 2^32 - 1 - position, in order of position."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"([^\x20\x09-\x0D]{1,16})"), F.lit(1)), lambda w: F.pmod(F.xxhash64(w), F.lit(P)))
    return F.transform(F.array(words), _winnow)[0]


def _winnow(h: Column) -> Column:
    n = F.size(h)
    bound = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  binds a value that the body names several times

    def rolled(at: Column) -> Column:
        out = h[at]
        for i in range(1, K):
            out = (out * B + h[at + i]) % P
        return out

    short = F.array(F.aggregate(h, F.lit(0).cast("bigint"), lambda a, x: (a * B + x) % P))
    grams = F.when(n >= K, F.transform(F.sequence(F.lit(0), n - K), rolled)).otherwise(short)
    packed = bound(grams, lambda g: F.transform(g, lambda x, i: x * POSITIONS + (POSITIONS - 1) - i))

    def least(a: Column, span: int, left: int) -> Column:
        """The least of each run, by doubling; left more positions are to be reached."""
        if not left:
            return a
        step = min(span, left)
        return bound(a, lambda b: least(F.transform(F.slice(b, 1, F.greatest(F.size(b) - step, F.lit(1))), lambda x, i: F.least(x, F.get(b, i + step))), span + step, left - step))

    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(least(packed, 1, WIDTH - 1)))


def hashes(fp: Column) -> Column:
    return F.array_distinct(F.transform(fp, lambda v: F.shiftrightunsigned(v, 32)))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two arrays without repeats."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def shown(fp: Column) -> Column:
    """hash:position of each choice, in hexadecimal, joined by spaces."""
    one = lambda v: F.concat(F.lower(F.hex(F.shiftrightunsigned(v, 32))), F.lit(":"), F.lower(F.hex(F.lit(POSITIONS - 1) - v.bitwiseAND(F.lit(POSITIONS - 1)))))
    return F.concat_ws(" ", F.transform(fp, one))


def in_order(docs: DataFrame) -> tuple[DataFrame, object, bool]:
    """doc_id, text and spare, with the window in which lead() is the next document in descending doc_id (after the
    last: the first).

    Documents go to ranges of doc_id; the top of each range stands once more, as a spare row, after the range above
    it, and the top of all after the lowest, so every document finds its next one in its own range.
    """
    own = common.texts(docs)
    bounds = common.order_bounds(own, "doc_id", common.order_buckets(docs.sparkSession))
    d = own.withColumn("bucket", common.bucket_of(F.col("doc_id"), bounds))
    places = F.array(F.struct("bucket", F.lit(False).alias("spare")))
    if bounds:
        top = F.get(F.lit(bounds).cast("array<bigint>"), F.col("bucket")) == F.col("doc_id")
        above = F.struct(((F.col("bucket") + 1) % len(bounds)).cast("int").alias("bucket"), F.lit(True).alias("spare"))
        places = F.when(top, F.array_append(places, above)).otherwise(places)
    d = d.select("doc_id", "text", F.inline(places))
    return d, Window.partitionBy("bucket").orderBy("spare", F.desc_nulls_last("doc_id"), "text"), bool(bounds)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document.

    The edited text has its last half (floor) replaced by as much of the next document's beginning.
    """
    d, order, known = in_order(docs)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def following(name: str) -> Column:
        ahead = F.lead(name).over(order)
        return ahead if known else F.coalesce(ahead, F.first(name).over(whole))  # without any doc_id there is no spare row

    d = d.withColumn("after", following("text"))
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("substring(after, 1, cast(floor(length(text) / 2) as int))"))
    made = d.select("doc_id", "bucket", "spare", "text", n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), chosen(F.col("text")).alias("fp"), chosen(edited).alias("edited_fp"))
    made = made.withColumn("own", hashes(F.col("fp"))).withColumn("edited", hashes(F.col("edited_fp")))
    made = made.withColumn("following", following("own")).where("not spare")
    return made.select("doc_id", "n_chars", "edited_sha256", shown(F.col("fp")).alias("fingerprint"), shown(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"))
