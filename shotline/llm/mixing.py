"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its target share of all characters times all characters divided by its own.  Target
shares are proportional to given weights, or by default to the square root of a source's characters.  Each document
gets a uniform number from the hash of a seed and its doc_id; the inverse of the Poisson distribution with the rate
as mean turns it into a number of copies, so that a source meets its target on average and every run agrees.  Copies
are dealt out in the order of a hash of seed, doc_id and copy.

A null source is a source of its own; a source without characters keeps its documents once on average (rate 1), and
so does a source whose given weight is missing only if all are (else its weight is 0).  Null texts have no
characters.  Repeated doc_ids get the same number of copies each; a null doc_id hashes as the word null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 17
#: Sources up to which their rates are broadcast.
FEW = 10_000


def uniform(key: str, seed: int) -> Column:
    """A number in [0, 1) with 52 bits from the hash of seed and key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", text: str = "text") -> DataFrame:
    """(source, rate) of each source."""
    size = docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).cast("double").alias("chars"))
    if weights:
        want = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.coalesce("source", F.lit(""))), F.lit(0.0))
    else:
        want = F.sqrt("chars")
    sized = size.withColumn("want", want)
    total = sized.agg(F.sum("chars").alias("all_chars"), F.sum("want").alias("all_want"))
    rate = F.when(F.col("chars") > 0, F.col("want") / F.col("all_want") * F.col("all_chars") / F.col("chars")).otherwise(1.0)
    return sized.crossJoin(F.broadcast(total)).select("source", F.coalesce(rate, F.lit(1.0)).alias("rate"))  # total is one row


def with_cdf(found: DataFrame) -> DataFrame:
    """(__source, __cdf): the cumulated Poisson probabilities of 0, 1, 2, ... copies, up to where they are 1 in double precision.

    A row a number of copies, summed by windows: work and size grow with the rate, as the copies themselves do.
    """
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 25).cast("int")
    ks = found.filter("rate > 0").select("source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    logs = ks.withColumn("log", F.col("k") * F.log("rate") - F.col("rate") - F.sum(F.log(F.greatest(F.col("k"), F.lit(1)).cast("double"))).over(upto))
    total = logs.withColumn("total", F.sum(F.exp("log")).over(upto))
    lists = total.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "total"))), lambda x: x["total"]).alias("__cdf"))
    none = found.filter("rate <= 0").select("source", F.array(F.lit(1.0)).alias("__cdf"))
    return lists.unionByName(none).withColumnRenamed("source", "__source")


#: Columns that copies adds; an input column of such a name, in whatever case, gives way.
OWN = ("copy", "n_copies", "shuffle_key")


def copies(docs: DataFrame, weights: dict[str, float] | None = None, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """keep (all columns by default), copy int (from 1), n_copies int, shuffle_key string; in the order of shuffle_key.

    Columns of docs that are named like these three are left out; all other names may be used.
    """
    table = with_cdf(rates(docs, weights, source, text))
    few = table.select("__source").limit(FEW + 1).count() <= FEW
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in OWN]
    drawn = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(key).cast("string").alias("__key"), F.col(source).cast("string").alias("__own"), uniform(key, seed).alias("__u"))
    joined = drawn.join(F.broadcast(table) if few else table, F.col("__own").eqNullSafe(F.col("__source")))
    n = F.size(F.filter("__cdf", lambda c: c <= F.col("__u")))
    many = joined.withColumn("__n", n).filter("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce("__key", F.lit("null")), F.col("__copy").cast("string"))
    out = many.select(*[F.col(f"`{c}`") for c in keep], F.col("__copy").alias("copy"), F.col("__n").alias("n_copies"), F.md5(name).alias("shuffle_key"))
    return out.orderBy("shuffle_key")
