"""Near-duplicate groups by bottom-k sketches of word shingles.

1. One hash function maps every shingle of a document to 63 bits; the KEPT smallest make its
   sketch. Documents of the same words are one class from here on, so copies are never paired.
2. Each class enters the inverted lists of some of its first LISTED retained values, the rarest in
   the corpus first. Two sets over the threshold share so many retained values (``least_shared``;
   missed with a chance under 1e-10) that such prefixes must have one in common, while a passage
   that many documents hold is listed only by those that consist of little else.
3. Of the overlaps that the lists generate, each class's with the most central class that it shares a
   list with comes first: the union of the two sketches estimates their likeness, pairs far below the
   threshold go, the others are decided by the whole sets (of 63-bit hashes of all shingles). That
   joins the large groups of copies at a cost of one pair a class.
4. What is left are lists whose members aren't in one component yet. All pairs within them could be as
   many as the square of a group, so for these members alone the exact complement takes over: lists
   of their whole sets, rarest shingles first, as far as a link to a larger or a smaller set can need
   (prefixes). Each class's overlap with the most central one of these lists is decided first, as
   above; then come the pairs of two components whose sizes and places in the lists leave
   enough shingles to share (for every pair over the threshold they do, so none is lost; loose
   variants of one text, over the threshold with none of each other, make next to none). In lists of
   many members only those outside the list's largest component meet the rest, and only in the
   ranges of sizes that their places allow. Pairs are estimated and decided as above.
5. Components by least label with pointer jumping.

Links, components and sketches stay in distributed tables; lineage is cut in the shared folder. Joins
on values that many classes hold read both sides from such tables, with no aggregate or partitioning
of their own below them, so that the adaptive planner can split a hot value among tasks; counts are
summed before they are shuffled.

Classes are numbered in the order of their smallest doc_id, null ids last, so ids never coincide.

Defined results: null, empty or blank text has no shingles, n_shingles 0 and is linked with
nothing; a text of fewer words than a shingle is one shingle; rows of one doc_id and one text are
one document repeated and each gets its row; rows of one doc_id with different texts are separate
texts with that id; rows with a null doc_id are linked like others, and name a component only if all
its ids are null; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loxodrome.llm.arrow_rows import slices
from loxodrome.llm.common import ROW_KEY, Scratch, row_key

KEPT, LISTED = 64, 32
#: Lists of more members are paired by ranges of sizes, each this much wider than the one below.
HOT_LIST, SIZE_STEP = 64, 1.02
#: A pair whose estimate from KEPT values lies below this is over the threshold with a chance under 1e-10.
LEAST_ESTIMATE = 0.4
#: So many ids or pairs of ids (16 bytes each) are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: k1, k2: hashes of the row; key: a 128-bit hash of the words, which copies share.
SKETCH_SCHEMA = "doc_id bigint, k1 bigint, k2 bigint, key binary, n bigint, sketch array<bigint>"
SET_SCHEMA = "id bigint, shingles array<bigint>"

def spaced_words(text: bytes) -> list[bytes]:
    """Words between ASCII whitespace of UTF-8 text with A-Z in lower case."""
    return text.lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """The distinct 63-bit hashes of the runs of so many words, ascending; of all words if there are fewer."""
    import xxhash

    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    acc = h[:n].copy()
    for j in range(1, size):
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(32)
        acc += h[j : j + n]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        acc ^= acc >> np.uint64(shift)
        acc *= np.uint64(factor)
    acc ^= acc >> np.uint64(31)
    return np.unique(acc >> np.uint64(1)).astype(np.int64)


def _listed(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values), pa.int64()))


def _sketches(size: int):
    """From doc_id, k1, k2, text to SKETCH_SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at, some in slices(batch.column(3).cast(pa.large_binary())):
                keys, counts, values = [], [], []
                for text in some.to_pylist():
                    words = spaced_words(text or b"")
                    found = shingle_hashes(words, size)
                    keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                    counts.append(len(found))
                    values.append(found[:KEPT].copy())
                own = [batch.column(c).slice(at, len(some)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), _listed(values)], ["doc_id", "k1", "k2", "key", "n", "sketch"])

    return run


def _sets(size: int):
    """From id, text to SET_SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in slices(batch.column(1).cast(pa.large_binary())):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), _listed([shingle_hashes(spaced_words(t or b""), size) for t in some.to_pylist()])], ["id", "shingles"])

    return run


def least_shared(percent: int, n: int = LISTED, chance: float = 1e-10) -> int:
    """How many of the n smallest values of a union two sets of this likeness share, but for the chance."""
    t, below = percent / 100, 0.0
    for c in range(n + 1):
        below += comb(n, c) * t**c * (1 - t) ** (n - c)
        if below > chance:
            return max(1, c)
    return n


def _prefix(n: Column, percent: int) -> Column:
    """How many of its retained values, rarest first, a set of n shingles lists."""
    r = F.least(n, F.lit(LISTED))
    # sets so small that all they could be linked with is retained whole: the bound holds for certain
    exact = n - F.ceil(n * percent / F.lit(100.0)) + 1
    return F.when(n * 100 <= LISTED * percent, exact).otherwise(F.least(r, F.lit(LISTED - least_shared(percent) + 1))).cast("int")


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class Linker:
    """The comparisons within one corpus. docs: doc_id, text; names: id, key, n, k1, k2 of each class; members: id, n, sketch."""

    def __init__(self, scratch: Scratch, docs: DataFrame, names: DataFrame, members: DataFrame, repeated: bool, size: int, percent: int):
        self.scratch, self.docs, self.names, self.members, self.repeated, self.size, self.percent = scratch, docs, names, members, repeated, size, percent

    def sets_of(self, ids: DataFrame) -> DataFrame:
        """id, shingles: the whole sets of these classes, read again from one row of each."""
        wanted = self.scratch.table(self.names.join(ids, "id", "left_semi").select("id", *ROW_KEY), few=True)
        rows = self.docs.select(*row_key(F.col("doc_id"), F.col("text")), "text").join(_sized(wanted, wanted.count()), ROW_KEY).select("id", "text")
        sets = rows.mapInArrow(_sets(self.size), SET_SCHEMA)
        return self.scratch.table(sets.dropDuplicates(["id"]) if self.repeated else sets)

    def likely(self, pairs: DataFrame) -> DataFrame:
        """a, b, n_a, n_b of the pairs a, b that the union of their sketches doesn't rule out."""
        pairs = self.scratch.table(pairs)
        held = _sized(pairs, pairs.count())
        side = lambda s: self.members.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"s_{s}"))
        both = side("a").join(held, "a").join(side("b").join(held.select("b").distinct(), "b", "left_semi"), "b")
        union = F.slice(F.sort_array(F.array_union("s_a", "s_b")), 1, KEPT)
        shared = F.array_intersect("s_a", "s_b")
        guess = F.size(F.array_intersect(union, shared)) / F.size(union)
        fits = both.filter((100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b")) & (guess >= LEAST_ESTIMATE))
        return self.scratch.table(fits.select("a", "b", "n_a", "n_b"), few=True)

    def exact(self, likely: DataFrame, sets: DataFrame) -> DataFrame:
        """a, b, linked: the pairs decided by whole sets."""
        held = _sized(likely, likely.count())
        whole = lambda s: sets.select(F.col("id").alias(s), F.col("shingles").alias(f"w_{s}"))
        both = whole("a").join(held, "a").join(whole("b").join(held.select("b").distinct(), "b", "left_semi"), "b")
        both = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("w_a", "w_b")).cast("long").alias("inter"))
        over = F.col("n_a") + F.col("n_b") - F.col("inter")
        return self.scratch.table(both.select("a", "b", (100 * F.col("inter") >= self.percent * over).alias("linked")), few=True)

    def common(self, each: DataFrame, value: str) -> DataFrame:
        """id, common (df and value, rarest first, of the values that several hold), logs; each: id and one value a row."""
        shared = self.scratch.table(each.groupBy(value).agg(F.count(F.lit(1)).cast("int").alias("df")).filter("df > 1"))
        return each.join(shared, value).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", value))).alias("common"), F.sum(F.log2("df")).alias("logs"))

    def retained_lists(self) -> DataFrame:
        """value, id, central: the inverted lists of retained values."""
        values = self.members.select("id", F.explode(F.slice("sketch", 1, LISTED)).alias("value"))
        by_class = self.common(values, "value").join(self.names.select("id", "n"), "id")
        kept = F.least("n", F.lit(LISTED))
        rare = kept - F.size("common")  # these come first in the prefix, and nobody else lists them
        taken = by_class.withColumn("take", F.greatest(_prefix(F.col("n"), self.percent) - rare, F.lit(0)).cast("int")).filter("take > 0")
        return self.scratch.table(taken.select("id", (F.col("logs") / kept).alias("central"), F.explode(F.slice("common", F.lit(1), F.col("take"))).alias("c")).select("c.value", "id", "central"))

    def whole_lists(self, sets: DataFrame) -> DataFrame:
        """value (a shingle), id, n, place, central: what each of these classes lists of its whole set, rarest first."""
        by_class = self.common(sets.select("id", F.explode("shingles").alias("value")), "value").join(self.names.select("id", "n"), "id")
        alone = F.col("n") - F.size("common")  # first in the order, and in no list
        reach = F.col("n") - F.ceil(F.col("n") * self.percent / F.lit(100.0)) + 1
        take = F.greatest(reach - alone, F.lit(0)).cast("int")
        taken = by_class.select("id", "n", (F.col("logs") / F.col("n")).alias("central"), alone.alias("alone"), F.posexplode(F.slice("common", F.lit(1), take)).alias("at", "c"))
        return self.scratch.table(taken.select("c.value", "id", "n", (F.col("alone") + F.col("at")).alias("place"), "central"))

    def central(self, lists: DataFrame) -> DataFrame:
        """a, b: each class with the most central one that it shares a list (value, id, central) with."""
        tops = self.scratch.table(lists.groupBy("value").agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("central", "id")).alias("top")).filter("m > 1").select("value", "top"))
        best = lists.join(tops, "value").groupBy("id").agg(F.max("top").alias("top")).filter(F.col("id") != F.col("top.id"))
        return best.select(F.least("id", "top.id").alias("a"), F.greatest("id", "top.id").alias("b")).distinct()

    def edges(self) -> DataFrame:
        """a, b: links that hold every component together."""
        table = self.scratch.table
        lists = self.retained_lists()
        likely = self.likely(self.central(lists))
        first = self.exact(likely, self.sets_of(likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct()))
        links = first.filter("linked").select("a", "b")
        roots = components(self.scratch, links)
        # lists with members of more than one component
        at = lists.select("value", "id").join(roots, "id", "left").select("value", "id", F.coalesce("root", "id").alias("root"))
        mixed = table(at.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("value"))
        left = table(lists.join(mixed, "value", "left_semi").select("id").distinct(), few=True)
        if left.isEmpty():
            return links
        sets = self.sets_of(left)
        lists = self.whole_lists(sets)
        tried = first.select("a", "b")
        for pairs in (lambda: self.central(lists), lambda: self.apart(lists, components(self.scratch, links)).distinct()):
            found = self.exact(self.likely(pairs().join(tried, ["a", "b"], "left_anti")), sets)
            links, tried = links.union(found.filter("linked").select("a", "b")), tried.union(found.select("a", "b"))
        return links

    def apart(self, lists: DataFrame, roots: DataFrame) -> DataFrame:
        """a, b: pairs within lists that are in two components and can share enough."""
        p = self.percent
        at = lists.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        # lists with members of more than one component, their sizes and the largest component
        by_root = at.groupBy("value", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("value").agg(F.sum("c").alias("m"), F.count(F.lit(1)).alias("roots"), F.max(F.struct("c", "root")).alias("big")).filter("roots > 1")
        by_root = self.scratch.table(by_root.select("value", "m", F.col("big.root").alias("major")))
        at = self.scratch.table(at.join(by_root, "value").select("value", "id", "n", "place", "root", "m", (F.col("root") == F.col("major")).alias("major")))
        # the smaller set of a pair (or smaller key) needs the shorter prefix
        ceil_div = lambda x, y: F.call_function("div", x + (y - 1), F.lit(y).cast("bigint"))
        own = at.filter(F.col("place") <= F.col("n") - ceil_div(2 * p * F.col("n"), 100 + p))
        own = own.select("value", F.col("id").alias("ka"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("root").alias("ra"), F.col("major").alias("ma"), "m")
        probe = at.select("value", F.col("id").alias("kb"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("root").alias("rb"), F.col("major").alias("mb"), F.col("m").alias("m_"))
        fits = (
            (F.col("ra") != F.col("rb"))
            & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("ka") < F.col("kb"))))
            & (100 * F.col("na") >= p * F.col("nb"))
            & ((100 + p) * F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= p * (F.col("na") + F.col("nb")))
        )
        pair = [F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")]
        few = own.filter(F.col("m") <= HOT_LIST).join(probe.filter(F.col("m_") <= HOT_LIST), "value").filter(fits).select(*pair)
        # the smaller sets that the place of an entry leaves possible
        step = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(SIZE_STEP))).cast("int")
        most = F.least(F.col("nb"), F.floor((F.col("nb") - F.col("pb")) * (100 + p) / F.lit(float(p)) - F.col("nb") + F.lit(1e-6)))
        least = F.ceil(F.col("nb") * p / F.lit(100.0) - F.lit(1e-6))
        hot_own = own.filter(F.col("m") > HOT_LIST).withColumn("range", step(F.col("na")))
        hot_probe = probe.filter((F.col("m_") > HOT_LIST) & (most >= least)).withColumn("range", F.explode(F.sequence(step(least), step(most))))
        on = ["value", "range"]
        odd = hot_own.filter(~F.col("ma")).join(hot_probe, on).filter(fits).select(*pair)
        even = hot_own.filter("ma").join(hot_probe.filter(~F.col("mb")), on).filter(fits).select(*pair)
        return few.union(odd).union(even)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """id, root of every node that has an edge (a, b): the smallest id it can reach."""
    both = scratch.table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = scratch.table(both.select(F.col("a").alias("id")).distinct().select("id", F.col("id").alias("root")))
    while not label.isEmpty():
        beside = both.join(label.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("least"))
        lower = scratch.table(label.join(beside, "id").select("id", "root", F.least("root", "least").alias("next")))
        jump = lower.select(F.col("id").alias("via"), F.col("next").alias("jumped"))
        new = scratch.table(lower.join(jump, F.col("next") == F.col("via")).select("id", F.least("next", "jumped").alias("root"), (F.least("next", "jumped") != F.col("root")).alias("moved")))
        scratch.drop(lower)
        scratch.drop(label)
        label = new.select("id", "root")
        label._loxodrome_path = new._loxodrome_path
        if new.filter("moved").isEmpty():
            break
    scratch.drop(both)
    return label


def grouped(scratch: Scratch, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, k1, k2, key, n, component_id, first (the row's class is its component's first, and the row has that class's id) for every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sketched = scratch.table(docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), "text").mapInArrow(_sketches(size), SKETCH_SCHEMA))
    repeated = not sketched.groupBy(*ROW_KEY).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty()
    some = sketched.filter(F.col("key").isNotNull())
    names = some.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), *[F.first(k).alias(k) for k in ROW_KEY])
    # numbers grow with the partition and the place in it, and so with the order; the table holds them fast
    names = scratch.table(names.orderBy(F.col("doc_id").asc_nulls_last(), "key").withColumn("id", F.monotonically_increasing_id()))
    members = scratch.table(some.select("key", "n", "sketch").groupBy("key").agg(F.first("sketch").alias("sketch")).join(names.select("key", "id", "n"), "key").select("id", "n", "sketch"))
    roots = components(scratch, Linker(scratch, docs, names, members, repeated, size, percent).edges())
    heads = roots.join(names.select(F.col("id").alias("root"), F.col("doc_id").alias("component_id")), "root").select("id", "root", "component_id")
    own = names.join(heads, "id", "left").select("key", F.col("doc_id").alias("class_doc"), F.coalesce("component_id", "doc_id").alias("component_id"), (F.coalesce("root", "id") == F.col("id")).alias("first"))
    out = some.select("doc_id", *ROW_KEY, "n", "key").join(own, "key").select("doc_id", *ROW_KEY, "key", "n", "component_id", (F.col("first") & F.col("doc_id").eqNullSafe(F.col("class_doc"))).alias("first"))
    return out.union(sketched.filter(F.col("key").isNull()).select("doc_id", *ROW_KEY, "key", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("first")))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    found = grouped(Scratch(docs.sparkSession, "dedup"), docs, size, percent)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = """
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
sh as (select distinct doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') as s
  from (select doc_id, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
inter as (select a.doc_id as a, b.doc_id as b, count(*) as i from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select a, b from inter join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
pairs as (select a, b from links union all select b, a from links),
reach(doc_id, r) as (select doc_id, doc_id from documents union select reach.doc_id, pairs.b from reach join pairs on reach.r = pairs.a),
comp as (select doc_id, min(r) as component_id from reach group by doc_id)
select w.doc_id, coalesce(n.n, 0) as n_shingles, component_id, w.doc_id = component_id as kept
from w join comp using (doc_id) left join n using (doc_id)
"""


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs (doc_id, text and others) that are kept: of each component one; of rows without words, which are linked with nothing, each one, but rows of one id and text once."""
    scratch = Scratch(docs.sparkSession, "dedup")
    found = scratch.table(grouped(scratch, docs, size, percent).select(*ROW_KEY, "key", "first"))
    gone = found.filter("not first").select(*ROW_KEY)
    # rows with the id and the words of a component's first class whose texts differ in blanks or case: the smallest hash stays
    alike = found.filter("first and key is not null").groupBy("key").agg(F.min(F.struct(*ROW_KEY)).alias("one"), F.max(F.struct(*ROW_KEY)).alias("other")).filter("one != other")
    alike = scratch.table(alike.select("key", "one"))
    if not alike.isEmpty():
        gone = gone.union(found.filter("first").join(alike, "key").filter(F.struct(*ROW_KEY) != F.col("one")).select(*ROW_KEY))
    gone = scratch.table(gone.distinct(), few=True)
    again = scratch.table(found.groupBy(*ROW_KEY).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(*ROW_KEY))
    held = lambda ids: _sized(ids, ids.count())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key(F.col("doc_id"), F.col("text").cast("string")))
    stay = rows.join(held(gone), ROW_KEY, "left_anti")
    if not again.isEmpty():
        stay = stay.join(held(again), ROW_KEY, "left_anti").select("row", *ROW_KEY).union(stay.join(held(again), ROW_KEY, "left_semi").dropDuplicates(ROW_KEY).select("row", *ROW_KEY))
    return stay.select("row.*")
