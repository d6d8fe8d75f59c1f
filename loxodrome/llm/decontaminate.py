"""Benchmark decontamination by winnowing.

Both sides are cut into k-grams of words; of every run of consecutive k-grams as long as a window
the one with the smallest hash is kept. With k = 5 and runs of 6, any 10 shared words hold one run
of 6 shared k-grams, whose smallest is kept on both sides at the same place: every shared span of
at least 10 words yields a common fingerprint. Fingerprints travel as numbers only; those that
training and test texts share are looked up by a join, and in the texts that hold some, a hit is
extended to all windows of 10 words about it, which are compared as words with those of the items.
An item of fewer than 10 words is one window by itself; its first words, as many as the shortest
item has, are a gram that is looked up at every place.

Rows are told apart by hashes of id and text, never by the id alone. Defined results: null, empty or
wordless texts have no words and no hits; wordless items have no window; each document row gets its
own row, with a null or repeated doc_id too; repeated item rows count once; a null item_id is
ignored; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loxodrome.llm.common import ROW_KEY, Scratch, row_key, words

WINDOW, K = 10, 5
RUN = WINDOW - K + 1
#: A fingerprint is one long: the hash above, the place of the gram below, so that the smallest is the leftmost of equals.
PLACE_BITS = 29
#: Items with at most so many bytes of text are broadcast (their windows take about twelve times that); larger ones are joined by shuffles.
BROADCAST_BYTES = 2_000_000
#: So many rows of hits are broadcast at most.
BROADCAST_ROWS = 1_000_000

def grams(w: Column, size: int) -> Column:
    """Packed hash and place of each gram of so many words; null if there is none."""
    low = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size))
    return F.transform(low, lambda i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(*[F.get(w, i + j if j else i) for j in range(size)]), PLACE_BITS + 1), PLACE_BITS).bitwiseOR(i.cast("long")))


def smaller(a: Column, b: Column, apart: int) -> Column:
    """The smaller of a at each place and b so many places on; as long as b reaches."""
    n = F.size(b) - apart
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(apart + 1), n), lambda x, y: F.least(x, y))


def winnow(w: Column) -> Column:
    """Packed fingerprints of words w: the smallest of each run of RUN grams, once."""
    assert RUN == 6
    # the smallest of 2, of 4 and of 6 grams
    chosen = _let(grams(w, K), lambda g: _let(smaller(g, g, 1), lambda two: smaller(smaller(two, two, 2), two, 4)))
    return F.when(F.size(w) >= WINDOW, F.array_distinct(chosen)).otherwise(F.array().cast("array<bigint>"))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fingerprints(w: Column, short: int | None) -> Column:
    """array<bigint>: winnowed fingerprints; with short, the complement of the packed gram of so many words at each place too."""
    if short is None:
        return winnow(w)
    return F.concat(winnow(w), F.transform(F.coalesce(grams(w, short), F.array().cast("array<bigint>")), lambda p: F.bitwise_not(p)))


def looked_up(packed: Column) -> Column:
    """Of a packed fingerprint what is joined: its hash, negative for short grams."""
    return F.shiftright(packed, PLACE_BITS)


def place_of(packed: Column) -> Column:
    return F.when(packed < 0, F.bitwise_not(packed)).otherwise(packed).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, size and the words of each distinct window, joined by blanks."""
    w = benchmark.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(WINDOW))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    return w.select("item_id", size.alias("size"), F.explode(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("w", i, size), " ")))).alias("window")).distinct()


def hits(scratch: Scratch, docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, k1, k2, n_words, rows of each distinct document; k1, k2, place, size, item_id of each occurrence of an item's window in one. docs: doc_id, text."""
    items = item_windows(benchmark)
    bytes_ = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    sizes = sorted(r[0] for r in items.select("size").distinct().collect()) if bytes_ else []  # WINDOW values at most
    short = sizes[0] if sizes and sizes[0] < WINDOW else None
    held = F.broadcast if bytes_ <= BROADCAST_BYTES else lambda df: df

    item_words = benchmark.select(words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    wanted = item_words.select(F.size("w").alias("n"), F.explode(fingerprints(F.col("w"), short)).alias("f"))
    # of an item's short grams only the first of a short item is looked up
    wanted = wanted.filter((F.col("f") >= 0) | ((F.col("n") < WINDOW) & (place_of(F.col("f")) == 0))).select(looked_up(F.col("f")).alias("hash"), F.lit(True).alias("known")).distinct()

    if bytes_ > BROADCAST_BYTES:  # tables of their own, so that the texts' side of a join can be split where a gram is common
        items, wanted = scratch.table(items), scratch.table(wanted)

    cut = docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), words(F.col("text")).alias("w"))
    own = F.lit(None).cast("bigint")  # stands for the row itself
    rows = cut.select("doc_id", *ROW_KEY, F.size("w").alias("n_words"), F.explode(F.concat(F.array(own), fingerprints(F.col("w"), short))).alias("f"))
    found = rows.withColumn("hash", looked_up(F.col("f"))).join(held(wanted), "hash", "left").filter(F.col("f").isNull() | F.col("known"))
    found = scratch.table(found.select("doc_id", *ROW_KEY, "n_words", "f"), few=True)
    each = found.filter("f is null").groupBy("doc_id", *ROW_KEY).agg(F.max("n_words").cast("bigint").alias("n_words"), F.count(F.lit(1)).alias("rows"))

    at, n = place_of(F.col("f")), F.col("n_words")
    around = F.when(F.col("f") >= 0, F.transform(F.sequence(F.greatest(at - (RUN - 1), F.lit(0)), F.least(at, n - WINDOW)), lambda i: F.struct(i.alias("place"), F.lit(WINDOW).alias("size"))))
    below = [s for s in sizes if s < WINDOW]
    if below:
        around = around.otherwise(F.transform(F.filter(F.array(*[F.lit(s) for s in below]), lambda s: at + s <= n), lambda s: F.struct(at.alias("place"), s.alias("size"))))
    spots = found.filter("f is not null").select(*ROW_KEY, F.explode(around).alias("at")).select(*ROW_KEY, "at.place", "at.size").groupBy(*ROW_KEY).agg(F.collect_set(F.struct("place", "size")).alias("spots"))
    spots = scratch.table(spots)
    near = F.broadcast if spots.count() <= BROADCAST_ROWS and bytes_ <= BROADCAST_BYTES else lambda df: df
    keyed = docs.select(*row_key(F.col("doc_id"), F.col("text")), "text")
    texts = keyed.join(near(spots.select(*ROW_KEY)), ROW_KEY, "left_semi").dropDuplicates(ROW_KEY).join(spots, ROW_KEY)
    windows = texts.select(*ROW_KEY, words(F.col("text")).alias("w"), "spots").select(*ROW_KEY, "w", F.explode("spots").alias("at"))
    windows = windows.select(*ROW_KEY, "at.place", "at.size", F.array_join(F.slice("w", F.col("at.place") + 1, F.col("at.size")), " ").alias("window"))
    return each, windows.join(held(items), ["size", "window"]).select(*ROW_KEY, "place", "size", "item_id")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, k1, k2, rows, n_words, n_hit (words inside any occurrence), items (sorted ids) of each distinct row of docs."""
    each, found = hits(Scratch(docs.sparkSession, "hits"), docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark.select("item_id", "text"))
    spans = F.array_sort(F.collect_set(F.struct("place", "size")))
    by_doc = found.groupBy(*ROW_KEY).agg(spans.alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["hit"] + F.greatest(s["place"] + s["size"] - F.greatest(a["end"], s["place"]), F.lit(0))).alias("hit"),
            F.greatest(a["end"], s["place"] + s["size"]).alias("end"),
        ),
        lambda a: a["hit"].cast("long"),
    )
    return each.join(by_doc.select(*ROW_KEY, covered.alias("n_hit"), "items"), ROW_KEY, "left").select("doc_id", *ROW_KEY, "rows", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit (words inside any occurrence), items (sorted ids), n_items, contaminated."""
    found = decontaminated(docs, benchmark).withColumn("again", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
    return found.select("doc_id", "n_words", "n_hit", "items", F.size("items").cast("long").alias("n_items"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = """
with dw as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w from documents),
iw as (select item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w from benchmark),
iwin as (select distinct item_id, least(len(w), 10) as size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from iw where len(w) > 0)),
sizes as (select distinct size from iwin),
dwin as (select doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') as win
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from dw, sizes where len(w) >= size)),
hits as (select doc_id, i, size, item_id from dwin join iwin using (size, win)),
spots as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + size)) as p from hits) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, cast(item_id as varchar) as item_id from hits) group by doc_id)
select dw.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join spots using (doc_id) left join its using (doc_id)
"""


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and others) that hold no window of any item."""
    gone = Scratch(docs.sparkSession, "clean").table(decontaminated(docs, benchmark).filter("n_hit > 0").select(*ROW_KEY), few=True)
    held = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key(F.col("doc_id"), F.col("text").cast("string")))
    return rows.join(held, ROW_KEY, "left_anti").select("row.*")
