"""Fixity audit of WARC replicas by Merkle trees.

Records are laid out in files in a fixed order; a leaf is the SHA-256 of a record's digest, offset,
length and number of copies. FAN consecutive leaves of a file make a node whose hash is that of its
range of offsets and its children's hashes, and so on up to one root for each file. Two replicas are
compared root by root; below roots that differ only the children of differing nodes are compared,
level by level, down to the leaves that differ.

A lost or changed record moves those after it, so the records of differing leaves are realigned
whatever their file and place: first whole copies with whole copies of the same page_id, URL and
digest (``ok``, also where they moved), then what is left of one page_id and URL, copy by copy
(``corrupt``). Copies beyond that are ``missing`` or ``extra``; a record of which some copies are
whole and others not has a row for either part.

A file holds the pages of FILE_PAGES consecutive ids; where a range has more than MOST_RECORDS
records (one id may repeat) in either replica, it is split into several files by a hash, in both replicas
into the same number, so that a lost or added record leaves the others in their files. Equal records of
one id and URL are one leaf with a count, so repeats can't swell a file.

Defined results: null URL or HTML counts as empty; a null page_id is in a file of its own range;
an empty table has no files; a record or file that one replica lacks is ``missing`` there and
``extra`` if it is only in the second; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loxodrome.llm.common import Scratch

FAN, FILE_PAGES, MOST_RECORDS = 16, 1_000, 10_000


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The page as a WARC response record."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame) -> DataFrame:
    """range, page_id, url, length, digest, copies: the distinct records of pages (page_id, url, html)."""
    one = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), record(F.col("page_id"), F.col("url"), F.col("html")).alias("r"))
    one = one.select("page_id", "url", F.octet_length("r").cast("bigint").alias("length"), F.sha2("r", 256).alias("digest"))
    return one.groupBy("page_id", "url", "length", "digest").agg(F.count(F.lit(1)).alias("copies")).withColumn("range", F.coalesce(F.floor(F.col("page_id") / FILE_PAGES).cast("bigint"), F.lit(-1).cast("bigint")))


def splits(*replicas: DataFrame) -> DataFrame:
    """range, parts: how many files the ranges have that hold too many records in any of these replicas."""
    sizes = [r.groupBy("range").agg(F.count(F.lit(1)).alias("n")) for r in replicas]
    both = sizes[0]
    for more in sizes[1:]:
        both = both.union(more)
    return both.groupBy("range").agg(F.ceil(F.max("n") / MOST_RECORDS).cast("int").alias("parts")).filter("parts > 1")


def leaves(each: DataFrame, parts: DataFrame) -> DataFrame:
    """file, place, page_id, url, offset, length, copies, digest: records as they lie in files; parts: as of splits()."""
    split = each.join(parts, "range", "left").withColumn("part", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("page_id", "url", "digest"), F.col("parts")).cast("int")))
    name = F.concat(F.lit("pages-"), F.col("range").cast("string"), F.when(F.col("part") > 0, F.concat(F.lit("-"), F.col("part").cast("string"))).otherwise(F.lit("")), F.lit(".warc"))
    w = Window.partitionBy("file").orderBy("page_id", "url", "digest")
    before = F.sum(F.col("length") * F.col("copies")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return split.withColumn("file", name).select("file", (F.row_number().over(w) - 1).alias("place"), "page_id", "url", F.coalesce(before, F.lit(0)).cast("bigint").alias("offset"), "length", "copies", "digest")


def parents(nodes: DataFrame) -> DataFrame:
    """file, place, offset, end, digest: the level above these nodes."""
    children = F.array_sort(F.collect_list(F.struct("place", "digest")))
    whole = nodes.groupBy("file", F.floor(F.col("place") / FAN).cast("bigint").alias("place")).agg(F.min("offset").alias("offset"), F.max("end").alias("end"), F.transform(children, lambda c: c["digest"]).alias("below"))
    return whole.select("file", "place", "offset", "end", F.sha2(F.concat_ws(":", "offset", "end", "below"), 256).alias("digest"))


def tree(scratch: Scratch, leaf: DataFrame) -> list[DataFrame]:
    """The levels from the leaves to the files' roots."""
    hashed = F.sha2(F.concat_ws(":", "digest", "offset", "length", "copies"), 256)
    level = scratch.table(leaf.select("file", F.col("place").cast("bigint").alias("place"), "offset", (F.col("offset") + F.col("length") * F.col("copies")).alias("end"), hashed.alias("digest")))
    out = [level]
    while (level.agg(F.max("place")).first()[0] or 0) > 0:
        level = scratch.table(parents(level))
        out.append(level)
    return out


def mismatches(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """file, place, digest_a, digest_b of the leaves that differ, found from the roots down."""
    top = max(len(a), len(b))
    differing = None
    for k in reversed(range(top)):
        # a lower tree's root stands for itself above
        x, y = a[min(k, len(a) - 1)], b[min(k, len(b) - 1)]
        if differing is not None:
            below = differing.select("file", F.col("place").alias("up")).distinct()
            x, y = [d.withColumn("up", F.floor(F.col("place") / FAN).cast("bigint")).join(below, ["file", "up"], "left_semi") for d in (x, y)]
        x, y = x.select("file", "place", F.col("digest").alias("digest_a")), y.select("file", "place", F.col("digest").alias("digest_b"))
        differing = x.join(y, ["file", "place"], "full").filter(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
    return differing


def realigned(own: DataFrame, other: DataFrame) -> DataFrame:
    """file, page_id, offset, length, copies, digest, status of these records of both replicas, matched by what they hold and not by their places."""
    sides = own.withColumn("own", F.lit(True)).unionByName(other.withColumn("own", F.lit(False)))
    on = lambda c, own: F.max(F.when(F.col("own") == own, F.col(c)))
    each = sides.groupBy("page_id", "url", "length", "digest").agg(
        *[on(c, o).alias(f"{c}_{s}") for c in ("file", "offset") for s, o in (("a", True), ("b", False))], *[F.coalesce(on("copies", o), F.lit(0)).alias(s) for s, o in (("a", True), ("b", False))]
    )
    each = each.withColumn("both", F.least("a", "b")).withColumn("left_a", F.col("a") - F.col("both")).withColumn("left_b", F.col("b") - F.col("both")).withColumn("file", F.coalesce("file_a", "file_b"))
    # sums before a record in two steps, so that no task holds more of one page_id and URL than a file does
    files = each.groupBy("page_id", "url", "file").agg(F.sum("left_a").alias("file_left_a"), F.sum("left_b").alias("file_left_b"))
    key = Window.partitionBy("page_id", "url")
    sums = [c for s in ("a", "b") for c in (F.sum(f"file_left_{s}").over(key).alias(f"all_{s}"), F.coalesce(F.sum(f"file_left_{s}").over(key.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"files_{s}"))]
    files = files.select(F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("file").alias("f"), *sums)
    within = Window.partitionBy("page_id", "url", "file").orderBy("digest", "length").rowsBetween(Window.unboundedPreceding, -1)
    first = {s: F.col(f"files_{s}") + F.coalesce(F.sum(f"left_{s}").over(within), F.lit(0)) for s in ("a", "b")}
    met = lambda s, t: F.greatest(F.lit(0), F.least(F.col(f"left_{s}"), F.col(f"all_{t}") - F.col(f"first_{s}")))
    each = each.join(files, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("url") == F.col("u")) & (F.col("file") == F.col("f")))
    each = each.withColumns({f"first_{s}": c for s, c in first.items()}).withColumn("corrupt", met("a", "b")).withColumn("extra", F.col("left_b") - met("b", "a"))
    part = lambda s, at, copies, status: F.struct(F.col(f"file_{s}").alias("file"), (F.col(f"offset_{s}") + F.col("length") * at).alias("offset"), copies.cast("bigint").alias("copies"), F.lit(status).alias("status"))
    both, corrupt, extra = F.col("both"), F.col("corrupt"), F.col("extra")
    parts = F.array(part("a", F.lit(0), both, "ok"), part("a", both, corrupt, "corrupt"), part("a", both + corrupt, F.col("left_a") - corrupt, "missing"), part("b", F.col("b") - extra, extra, "extra"))
    return each.select("page_id", "length", "digest", F.explode(F.filter(parts, lambda p: p["copies"] > 0)).alias("p")).select("p.file", "page_id", "p.offset", "length", "p.copies", "digest", "p.status")


def audit(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """file, page_id, offset, length, copies, digest, status: each record of pages against the replica; records that only the replica has are ``extra``."""
    scratch = Scratch(pages.sparkSession, "warc")
    each = [scratch.table(records(d)) for d in (pages, replica)]
    parts = scratch.table(splits(*each))
    own, other = [scratch.table(leaves(d, parts)) for d in each]
    bad = scratch.table(mismatches(tree(scratch, own), tree(scratch, other)).select("file", "place"))
    whole = own.join(bad, ["file", "place"], "left_anti").select("file", "page_id", "offset", "length", "copies", "digest", F.lit("ok").alias("status"))
    return whole.union(realigned(*[d.join(bad, ["file", "place"], "left_semi") for d in (own, other)]))


def decayed(pages: DataFrame, one_in: int = 97) -> DataFrame:
    """pages as a replica in which of about so many pages one has lost the first byte of its HTML to another, one is missing, one is there twice and one has lost its last character."""
    number = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 8), 16, 10).cast("bigint") % one_in
    n = F.char_length("html")
    html = F.when((number == 0) & (n > 0), F.concat(F.lit("\u007f"), F.substring("html", F.lit(2), n))).when((number == 3) & (n > 0), F.substring("html", F.lit(1), n - 1)).otherwise(F.col("html"))
    times = F.when(number == 1, 0).when(number == 2, 2).otherwise(1)
    return pages.select("page_id", "url", html.alias("html"), F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


ORACLE = f"""
with p as (select page_id, url, html, cast('0x' || substr(md5(cast(page_id as varchar)), 1, 8) as bigint) % 97 as k from pages),
q as (select page_id, url, case when k = 0 and length(html) > 0 then chr(127) || substr(html, 2) when k = 3 and length(html) > 0 then left(html, length(html) - 1) else html end as html
  from p, unnest(range(case k when 1 then 0 when 2 then 2 else 1 end))),
s as (select 'a' as side, page_id, url, html from pages union all select 'b', page_id, url, html from q),
r as (select side, page_id, coalesce(url, '') as url, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(cast(page_id as varchar), '') || '>' || chr(13) || chr(10)
   || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
   || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as rec from s),
g as (select side, page_id, url, cast(strlen(rec) as bigint) as length, sha256(rec) as digest, count(*) as copies,
   'pages-' || coalesce(cast(floor(page_id / {FILE_PAGES}) as bigint), -1) || '.warc' as file from r group by all),
o as (select *, cast(coalesce(sum(length * copies) over (partition by side, file order by page_id nulls first, url, digest rows between unbounded preceding and 1 preceding), 0) as bigint) as at_ from g),
e as (select coalesce(x.page_id, y.page_id) as page_id, coalesce(x.url, y.url) as url, coalesce(x.length, y.length) as length, coalesce(x.digest, y.digest) as digest, coalesce(x.file, y.file) as file,
   x.at_ as offset_a, y.at_ as offset_b, coalesce(x.copies, 0) as a, coalesce(y.copies, 0) as b, least(coalesce(x.copies, 0), coalesce(y.copies, 0)) as whole
  from (select * from o where side = 'a') x full join (select * from o where side = 'b') y on x.page_id is not distinct from y.page_id and x.url = y.url and x.length = y.length and x.digest = y.digest),
f as (select *, a - whole as left_a, b - whole as left_b, sum(a - whole) over k as all_a, sum(b - whole) over k as all_b,
   coalesce(sum(a - whole) over (u rows between unbounded preceding and 1 preceding), 0) as first_a, coalesce(sum(b - whole) over (u rows between unbounded preceding and 1 preceding), 0) as first_b
  from e window k as (partition by page_id, url), u as (partition by page_id, url order by file, digest, length)),
h as (select *, greatest(0, least(left_a, all_b - first_a)) as corrupt, left_b - greatest(0, least(left_b, all_a - first_b)) as extra from f),
out as (select file, page_id, offset_a as at_, length, whole as copies, digest, 'ok' as status from h
  union all select file, page_id, offset_a + length * whole, length, corrupt, digest, 'corrupt' from h
  union all select file, page_id, offset_a + length * (whole + corrupt), length, left_a - corrupt, digest, 'missing' from h
  union all select file, page_id, offset_b + length * (b - extra), length, extra, digest, 'extra' from h)
select file, page_id, cast(at_ as bigint) as "offset", length, cast(copies as bigint) as copies, digest, status from out where copies > 0
"""
