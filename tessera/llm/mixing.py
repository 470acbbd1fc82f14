"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of all characters over its own characters. Every document
draws a Poisson count with that mean by inverting the distribution at a uniform number hashed from its id, is
exploded by the count, and the copies are dealt to partitions and sorted by a hash key: a global shuffle.
The counts need one small aggregation; only the copies are shuffled, by a key without skew. The draws of a document
with a large mean, which is one of a minute source, are dealt to many tasks before any copy is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let

SEED = 17
#: A mean above this is drawn as a sum of independent parts, which is Poisson again; it bounds the table of
#: the distribution, not the count.
PART = 64
#: Parts of a document that one row draws. Documents of more are dealt to as many rows as they need.
TOGETHER = 64
#: Copies that a source's documents may have in the mean; a target that asks for more is an error.
MOST = 1e9


def _uniform(*parts: Column) -> Column:
    """52 bits of the MD5 of the parts, as a double in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, text: str = "text", source: str = "source") -> DataFrame:
    """(source, mean, parts, cdf) of each source; cdf is the Poisson distribution function of mean / parts.

    ``weights`` are target shares of the characters by source, scaled to a sum of 1 over the sources there;
    sources that it doesn't name have 0, and None means equal shares. A source without characters has 0.
    A mean above MOST is an error when the rates are read.
    """
    size = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum(F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0)).cast("bigint")).alias("chars"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source") == name, float(w)).otherwise(weight)
    # one row a source, read twice
    sized = Scratch(docs.sparkSession, "sources").keep(size.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(0.0)))
    chars, weighed = sized.agg(F.sum("chars"), F.sum("weight")).first()
    mean = F.when(F.col("weight") > 0, F.col("weight") / F.lit(weighed or 1.0) * F.lit(chars or 0) / F.col("chars")).otherwise(0.0)
    most = F.raise_error(F.concat(F.lit("too few characters for the target of source "), F.coalesce(F.col("source").cast("string"), F.lit("null")))).cast("double")
    parts = F.greatest(F.ceil(F.col("mean") / PART), F.lit(1)).cast("bigint")
    meant = sized.withColumn("mean", F.when(mean > MOST, most).otherwise(mean)).withColumn("parts", parts).withColumn("m", F.col("mean") / F.col("parts"))
    steps = F.sequence(F.lit(1), (F.col("m") + 12 * F.sqrt("m") + 24).cast("int"))
    start = F.struct(F.exp(-F.col("m")).alias("p"), F.array(F.exp(-F.col("m"))).alias("cdf"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * F.col("m") / k
        return F.struct(p.alias("p"), F.array_append(state["cdf"], F.element_at(state["cdf"], -1) + p).alias("cdf"))

    return meant.select("source", "mean", "parts", F.aggregate(steps, start, step, lambda s: s["cdf"]).alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with every row repeated by its draws, and the columns copy (string; the part and the number within its
    draw, as "1.1") and mix_key (string; both replaced if there). Rows are in random order by mix_key within partitions
    dealt at random.

    The draw depends on the seed and the row's name alone: its doc_id, or for a null id the MD5 of its text. Repeated
    rows draw alike, and their copies are still dealt apart, by the row's place in ``docs`` (a table or another
    plan that gives the same rows in the same order when it is run again). A null source is a source of its own, which
    ``weights`` can't name. Means of 0 give no copy, as do sources of null and empty texts only; very long texts are
    repeated whole; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    known = Scratch(spark, "rates").keep(rates(docs, weights, text, source))
    names = {c: f"_tessera_{c}" for c in ("source", "parts", "cdf")}
    known_as = known.select(*[F.col(c).alias(a) for c, a in names.items()])
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    ident = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.concat(F.lit("text:"), F.md5(body.cast("binary"))))
    rows = docs.withColumns({"_tessera_row": F.monotonically_increasing_id(), "_tessera_ident": ident})
    joined = rows.join(known_as, rows[source].eqNullSafe(known_as["_tessera_source"]))
    several = F.col("_tessera_parts") > TOGETHER

    def drawn(some: DataFrame) -> DataFrame:
        parts = some.withColumn("_tessera_part", F.explode(F.sequence(F.col("_tessera_group") * TOGETHER + 1, F.least((F.col("_tessera_group") + 1) * TOGETHER, "_tessera_parts"))))
        n = let(_uniform(F.lit(str(seed)), F.col("_tessera_part").cast("string"), F.col("_tessera_ident")), lambda u: F.size(F.filter("_tessera_cdf", lambda c: c <= u)))
        kept = parts.withColumn("_tessera_n", n).where("_tessera_n > 0")
        return kept.withColumn("_tessera_copy", F.explode(F.sequence(F.lit(1), "_tessera_n")))

    few = drawn(joined.where(~several).withColumn("_tessera_group", F.lit(0).cast("bigint")))
    if known.where(F.col("parts") > TOGETHER).limit(1).count():  # only then are the documents read for them too
        groups = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_tessera_parts") - 1) / TOGETHER))
        dealt = joined.where(several).withColumn("_tessera_group", F.explode(groups)).repartition("_tessera_row", "_tessera_group")
        few = few.unionByName(drawn(dealt))
    copy = F.concat_ws(".", "_tessera_part", "_tessera_copy")
    keyed = few.withColumn("copy", copy).withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"order{seed}"), "_tessera_ident", "copy")))
    placed = keyed.repartition("mix_key", "_tessera_row").sortWithinPartitions("mix_key")
    return placed.drop(*[c for c in placed.columns if c.startswith("_tessera_")])


def sql(table: str = "documents", seed: int = SEED) -> str:
    """``mix`` with equal weights for DuckDB."""
    return f"""
    with size as (select source, sum(coalesce(length(text), 0)) as chars from {table} group by source),
    share as (select count(*) filter (chars > 0) as n, sum(chars) as total from size),
    mean as (select source, case when chars > 0 then 1.0 / n * total / chars else 0.0 end as mean from size, share),
    part as (select source, greatest(cast(ceil(mean / {PART}) as bigint), 1) as parts, mean / greatest(ceil(mean / {PART}), 1) as m from mean),
    pmf as (
      select source, parts, k, case when m = 0 then case when k = 0 then 1.0 else 0.0 end
             else exp(-m + k * ln(m) - (select coalesce(sum(ln(j)), 0) from range(1, k + 1) r(j))) end as p
      from (select source, parts, m, unnest(range(0, cast(floor(m + 12 * sqrt(m) + 24) as integer) + 1)) as k from part)),
    cdf as (select source, parts, list(c order by k) as cdf from (
      select source, parts, k, sum(p) over (partition by source order by k) as c from pmf) group by source, parts),
    named as (select *, coalesce(cast(doc_id as varchar), 'text:' || md5(coalesce(text, ''))) as ident from {table}),
    draw as (
      select * exclude (part), part, cast(('0x' || substr(md5('{seed}:' || part || ':' || ident), 1, 13)) as bigint) / {float(1 << 52)} as u
      from (select d.*, cdf, unnest(range(1, parts + 1)) as part from named d join cdf on d.source is not distinct from cdf.source)),
    drawn as (select *, len(list_filter(cdf, lambda c: c <= u)) as n from draw),
    copies as (select * exclude (part, cdf, u, n), part || '.' || unnest(range(1, cast(n as bigint) + 1)) as copy from drawn)
    select * exclude (ident), md5('order{seed}:' || ident || ':' || copy) as mix_key from copies"""
