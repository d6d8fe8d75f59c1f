"""Mixing sources to target weights by Poisson replication.

A source of n documents and target weight w gets the mean repetition rate r = N * w / n, where N is
the number of documents wanted. A hash of the seed and the document gives a uniform number u, and
the number of copies is the inverse at u of the Poisson distribution of mean r: the count of k with
P(X <= k) <= u. Each document is exploded by its count, and the copies are shuffled globally: each
has a hashed key, copies are dealt to partitions by ranges of it and ordered by it.

Which documents repeat depends on the seed and the id only, so a lost task gives the same
copies again. Source counts are one small aggregate; rates are broadcast up to BROADCAST_ROWS
sources and joined by a shuffle beyond.

Rows with a null id draw by a hash of their text instead.

Defined results: a null source is a source of its own; sources missing from the weights get weight
0 if weights are given; sizes alone (temperature) otherwise; rows of one id (or of no id and one text) are
copies of each other and draw the same number; an empty table gives an empty result; extra columns are carried
along.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED, TEMPERATURE, BROADCAST_ROWS = 20_260, 0.7, 100_000
#: Hex digits of md5 that make a number; 13 of them are exact in a double.
DIGITS = 13
#: A Poisson of a larger mean is the sum of two of half of it, so that exp(-rate) stays far from 0.
MOST_RATE = 64.0


def hashed(*parts: Column) -> Column:
    """A number in [0, 16 ** DIGITS) from these values, the same everywhere."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, DIGITS), 16, 10).cast("bigint")


def poisson(u: Column, rate: Column) -> Column:
    """The number of k >= 0 with P(X <= k) <= u, for X of this mean (at most MOST_RATE)."""
    reach = int(MOST_RATE + 12 * MOST_RATE**0.5 + 30)
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("n"))
    step = lambda a, k: F.when(
        a["cdf"] <= u,
        F.struct((a["p"] * rate / k).alias("p"), (a["cdf"] + a["p"] * rate / k).alias("cdf"), (a["n"] + 1).alias("n")),
    ).otherwise(a)
    # the terms that can matter for this rate only
    last = F.least(F.lit(reach), F.ceil(rate + 12 * F.sqrt(rate) + 30)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["n"])


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, wanted: int | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """source, rate: by the weights, or by the sources' sizes to the power of temperature; wanted: documents in the mixture, as many as there are if None."""
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighted = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        known = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "s string, w double")
        weighted = n.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))  # the caller's own table
    total = weighted.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    if not total["w"]:
        return weighted.select("source", F.lit(0.0).alias("rate"))
    aim = float(total["n"] if wanted is None else wanted)
    return weighted.select("source", (F.lit(aim) * (F.col("w") / F.lit(float(total["w"]))) / F.col("n")).alias("rate"))


def copies(docs: DataFrame, of: DataFrame, seed: int = SEED) -> DataFrame:
    """docs (drawn_by, source and others) with rate, u, n_copies; of: source, rate."""
    held = F.broadcast if of.count() <= BROADCAST_ROWS else lambda df: df
    rated = docs.join(held(of.select(F.col("source").alias("_source"), "rate")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    u = hashed(F.lit(seed), F.col("drawn_by")) / F.lit(float(16**DIGITS))
    out = rated.withColumn("u", u)
    whole = F.floor(F.col("rate") / MOST_RATE).cast("int")
    rest = poisson(F.col("u"), F.col("rate") - whole * F.lit(MOST_RATE))
    # the parts of a large rate draw numbers of their own
    more = F.aggregate(
        F.when(whole > 0, F.sequence(F.lit(1), whole)).otherwise(F.array().cast("array<int>")),
        F.lit(0),
        lambda a, k: a + poisson(hashed(F.lit(seed), F.col("drawn_by"), k) / F.lit(float(16**DIGITS)), F.lit(MOST_RATE)),
    )
    return out.withColumn("n_copies", rest + more)


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, wanted: int | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """All columns of docs, copy (from 0) and shuffle_key, in the order of shuffle_key; docs: doc_id, source and others."""
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))) if "text" in docs.columns else F.lit("")
    by = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), text))
    inner = docs.select(by.alias("drawn_by"), F.col("source").cast("string").alias("source"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    drawn = copies(inner, rates(inner.select("source"), weights, wanted, temperature), seed)
    each = drawn.filter("n_copies > 0").select("drawn_by", "row", F.posexplode(F.array_repeat(F.lit(0), F.col("n_copies"))).alias("copy", "_"))
    keyed = each.select("row", "copy", hashed(F.lit(seed + 1), F.col("drawn_by"), F.col("copy")).alias("shuffle_key"))
    names = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    # partition k holds the k-th of equal ranges of the key, so the partitions in turn are the global order
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.least(F.floor(F.col("shuffle_key") / F.lit(16**DIGITS / n)), F.lit(n - 1)).cast("int")
    dealt = keyed.repartitionById(n, part).sortWithinPartitions("shuffle_key", "copy")
    return dealt.select(*[F.col(f"row.`{c}`") for c in names], F.col("copy").cast("bigint").alias("copy"), "shuffle_key")


ORACLE = f"""
with recursive n as (select source, count(*) as n, pow(cast(count(*) as double), {TEMPERATURE}) as w from documents group by source),
rates as (select source, cast((select sum(n) from n) as double) * (w / (select sum(w) from n)) / n as rate from n),
d as (select doc_id, source, rate, cast(cast('0x' || substr(md5('{SEED}|' || doc_id), 1, {DIGITS}) as bigint) as double) / {float(16**DIGITS)!r} as u from documents join rates using (source)),
steps(doc_id, u, rate, k, p, cdf) as (
  select doc_id, u, rate, 0, exp(-rate), exp(-rate) from d
  union all select doc_id, u, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) from steps where cdf <= u),
c as (select doc_id, max(k) as n_copies from steps group by doc_id)
select d.doc_id, d.source, cast(j as bigint) as copy, cast('0x' || substr(md5('{SEED + 1}|' || d.doc_id || '|' || j), 1, {DIGITS}) as bigint) as shuffle_key,
  x.n_chars, sha256(x.text) as text_sha256
from d join c using (doc_id) join documents x using (doc_id), unnest(range(c.n_copies)) as t(j)
"""
