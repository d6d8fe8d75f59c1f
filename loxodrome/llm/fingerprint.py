"""Document fingerprints: threshold-scaled sketches of word shingles.

A shingle is five consecutive words (all of them if there are fewer), hashed to 64 bits. The sketch
retains every hash in the lowest 1/SCALE of the range, so its size follows the document's and any
two sketches can be compared or merged: the sketch of two documents together is the union of
theirs, and the share of one sketch found in another estimates containment even where one document
is a thousand times the other.

A sketch has two levels: ``low``, the retained hashes, and for texts of at most FEW distinct shingles
also ``rest``, all their other hashes (null for longer texts). Two sketches that both have all their
hashes are compared exactly; all others by ``low`` alone, on both sides, so that a hash above the
threshold is never looked for where it can't be.

Defined results: null text counts as empty; a text without words has an empty sketch; two empty
sketches have likeness 1, an empty and another one 0. Likeness by ``low`` is 0 where both have nothing
there in common, and containment by ``low`` is null where the smaller text retains nothing, as it then
says nothing; an empty text is contained in every one. Equal texts have equal fingerprints. Repeated
rows and equal ids are ordered by id and text. Rows with a null doc_id come last in descending
order. An empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loxodrome.llm.common import SPACED_PATTERN, ascii_lower

SHINGLE, SCALE, FEW = 5, 4, 256
#: Signed hashes below this are the lowest 1/SCALE of all.
THRESHOLD = -(1 << 63) + (1 << 64) // SCALE
#: Documents that are ordered in one task, and the most such ranges (their bounds, eight bytes each, pass the driver; beyond that ranges grow and sort on disk).
RANGE_ROWS, MOST_RANGES = 2_000, 16_384


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sketch(text: Column, size: int = SHINGLE) -> Column:
    """struct<low array<bigint>, rest array<bigint>>: the hashes of the text's shingles, each level ascending."""
    w = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(SPACED_PATTERN), 0)
    return _let(_let(w, lambda x: _hashes(x, size)), _levels)


def _hashes(w: Column, size: int) -> Column:
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + j if j else i) for j in range(size)]))
    return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < size, F.array(F.xxhash64(w))).otherwise(grams)


def _levels(h: Column) -> Column:
    low = F.sort_array(F.array_distinct(F.filter(h, lambda x: x < THRESHOLD)))
    # repeats are told only where there may be few enough distinct ones
    high = _let(F.array_distinct(F.filter(h, lambda x: x >= THRESHOLD)), lambda d: F.struct(d.alias("rest")))
    return _let(F.struct(low.alias("low"), high["rest"].alias("rest")), lambda s: F.struct(s["low"].alias("low"), F.when(F.size(s["low"]) + F.size(s["rest"]) <= FEW, F.sort_array(s["rest"])).alias("rest")))


def merge(a: Column, b: Column) -> Column:
    """The sketch of both documents together."""
    low, rest = F.sort_array(F.array_union(a["low"], b["low"])), F.sort_array(F.array_union(a["rest"], b["rest"]))
    return F.struct(low.alias("low"), F.when(F.size(low) + F.size(rest) <= FEW, rest).alias("rest"))


def _sides(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Whether all hashes of both are known, and what is compared."""
    whole = a["rest"].isNotNull() & b["rest"].isNotNull()
    of = lambda s: F.when(whole, F.concat(s["low"], s["rest"])).otherwise(s["low"])
    return whole, of(a), of(b)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two documents by their sketches; exact where both are short."""
    whole, x, y = _sides(a, b)
    over = F.size(F.array_union(x, y))
    return F.when(over == 0, F.when(whole, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(over, F.lit(1)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds too; null where a retains nothing to look for."""
    whole, x, y = _sides(a, b)
    empty = a["rest"].isNotNull() & (F.size(a["low"]) + F.size(a["rest"]) == 0)
    return F.when(empty, F.lit(1.0)).when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.lit(1)))


def text_of(s: Column) -> Column:
    """The fingerprint as text: its retained hashes, 16 hex digits each, and after a dot the others of a short text."""
    hexes = lambda a: F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")
    return F.concat(hexes(s["low"]), F.coalesce(F.concat(F.lit("."), hexes(s["rest"])), F.lit("")))


def _range_of(cuts: list[int]) -> Column:
    """How many of the ascending cuts are at most doc_id, by bisection."""
    arr = F.array(*[F.lit(c).cast("bigint") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    middle = lambda a: F.floor((a["lo"] + a["hi"]) / 2).cast("int")
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(len(cuts).bit_length())),
        F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")),
        lambda a, _: F.when(
            a["lo"] < a["hi"],
            F.when(F.get(arr, middle(a)) <= F.col("doc_id"), F.struct((middle(a) + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), middle(a).alias("hi"))),
        ).otherwise(a),
        lambda a: a["lo"],
    )


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sketch, next_text, next_sketch: each document with the one that follows in descending doc_id; the first follows the last.

    Ranges of ids are ordered in parallel; the first document of a range is also dealt to the range
    before. Texts travel once, and are sketched where they arrive.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = docs.agg(F.count("doc_id")).first()[0]
    n = max(1, min(MOST_RANGES, known // RANGE_ROWS))
    # ascending cuts; range 0 holds the smallest ids, and null ids come after them
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    placed = docs.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_range_of(sorted(set(cuts or [])))))
    # a row for each range (MOST_RANGES and one at most): its largest id, and the range above it, or the lowest one for the highest
    tops = placed.groupBy("range").agg(F.max("doc_id").alias("top")).collect()
    order = sorted((r["range"] for r in tops), reverse=True)
    above = {r: order[i - 1] for i, r in enumerate(order)}
    bounds = docs.sparkSession.createDataFrame([(r["range"], r["top"], above[r["range"]]) for r in tops], "range int, top bigint, also int")
    # rows with a range's first id follow that of the range above it, and those with the very first id end the last range
    own = F.array(F.struct(F.col("range"), F.lit(0).alias("halo")))
    both = F.array(F.struct(F.col("range"), F.lit(0).alias("halo")), F.struct(F.col("also").alias("range"), F.lit(1).alias("halo")))
    copies = F.when(F.col("top").eqNullSafe(F.col("doc_id")), both).otherwise(own)
    dealt = placed.join(F.broadcast(bounds), "range").select("doc_id", "text", F.explode(copies).alias("to")).select("doc_id", "text", "to.*")
    dealt = dealt.repartition("range").withColumn("sketch", sketch(F.col("text")))
    w = Window.partitionBy("range").orderBy("halo", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.withColumn("next_text", F.lead("text").over(w)).withColumn("next_sketch", F.lead("sketch").over(w)).filter("halo = 0").drop("halo", "range")


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Each document beside an edited text, whose last third is taken from the start of the next document, and beside that next document."""
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    both = with_next(docs).select("doc_id", "sketch", "next_sketch", n.cast("bigint").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)).alias("edited"))
    return both.withColumn("edited_sketch", sketch(F.col("edited")))
