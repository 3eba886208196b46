"""Mixing sources to target weights with hash-threshold histograms.

Each source gets a target number of words. What exceeds whole copies of the source is taken by hash: documents below a
threshold go in, those above stay out. The threshold is found with nested histograms: words by source and 12 hash bits,
the bucket in which the budget runs out, then the next 12 bits of that bucket alone. Four levels settle all 48 bits, so no
row is sorted and nothing but sources x 4096 sums is ever held together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bits48, n_words, written

LEVELS, DIGIT = 4, 12


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, size) rows, one a source, to (source, source_size, target).

    Sources by code point, null last, weigh weights in turn. Together they get share of all words; a target stops at cap
    times its source and the excess goes to the others by weight. In order of size per weight the stopped ones come first,
    so one running sum finds the level at which the rest stand.
    """
    one, before = Window.partitionBy(), Window.orderBy("per_weight", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    lcm = math.lcm(*weights)
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.select("source", F.col("size").alias("source_size"), w.cast("double").alias("w")).withColumn("per_weight", F.col("source_size") * F.lit(lcm) / F.col("w"))
    rows = rows.select("*", F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double").alias("s0"), F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w0"), F.sum("source_size").over(one).cast("double").alias("s_all"), F.sum("w").over(one).alias("w_all"))
    rows = rows.withColumn("level", (F.lit(share) * F.col("s_all") - F.lit(cap) * F.col("s0")) / (F.col("w_all") - F.col("w0")))
    full = F.col("level") * F.col("w") > F.lit(cap) * F.col("source_size")
    # The first source in that order that isn't stopped sets the level of all that follow.
    first = F.min(F.when(~full, F.struct("per_weight", F.struct(F.col("source").isNull().alias("n"), "source").alias("k"), "level"))).over(one)
    rows = rows.withColumn("first", first)
    own = F.struct("per_weight", F.struct(F.col("source").isNull().alias("n"), "source").alias("k"))
    stopped = F.col("first").isNull() | (own < F.struct("first.per_weight", "first.k"))
    return rows.select("source", "source_size", F.when(stopped, F.lit(cap) * F.col("source_size")).otherwise(F.col("first.level") * F.col("w")).alias("target"))


def hash_thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each source of budgets (source, budget): the hash at which the sizes below it reach the budget, as
    (source, edge, left, tied): all below edge go in, those at edge share left words of their tied ones.
    rows: source, h, size. Sources whose budget isn't below their size have no row."""
    edge = budgets.select(F.col("source").alias("b_source"), F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left"))
    for level in range(LEVELS):
        shift = DIGIT * (LEVELS - 1 - level)
        digits = F.shiftright("h", shift)
        inside = rows.join(edge, rows["source"].eqNullSafe(edge["b_source"]) & (F.shiftright(rows["h"], shift + DIGIT) == edge["prefix"]))
        sums = inside.groupBy("b_source", "left", digits.alias("bucket")).agg(F.sum("size").alias("tied"))
        upto = F.sum("tied").over(Window.partitionBy("b_source").orderBy("bucket"))
        edge = sums.withColumn("upto", upto).filter((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("tied") <= F.col("left")) & (F.col("tied") > 0)).select("b_source", F.col("bucket").alias("prefix"), (F.col("left") - F.col("upto") + F.col("tied")).alias("left"), "tied")
        if level < LEVELS - 1:
            edge = edge.drop("tied")
    return edge.select(F.col("b_source").alias("source"), F.col("prefix").alias("edge"), "left", "tied")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, key: str = "doc_id", size: Column | None = None) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken) of a mix of docs (doc_id, source, text).

    taken counts the words that the mix takes of a document: its size once for each whole copy of its source in the target,
    plus its size if its hash is below the source's threshold. The document at the threshold gives only what is left of the
    budget, so that each source's sum is its target but for a fraction of a word; rows of equal hash there (repeated ids)
    share it by size. Null texts have size 0 and null sources are a source of their own, the last. An empty table gives an
    empty result; a source without words has target 0. Other columns are ignored.
    """
    size = n_words(F.col("text")) if size is None else size
    rows = written(docs.select(F.col(key).alias("doc_id"), "source", size.cast("long").alias("size"), bits48(F.col(key)).alias("h")), "mix")
    return taken(rows, shares(rows, weights, share, cap), rows.select("source").distinct().count()).select("doc_id", "source", "size", "source_size", "target", "taken")


#: Most sources whose shares are broadcast; more are joined.
SOURCES = 20_000


def shares(rows: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """What a source's rows (source, size, h) need to know, one row a source: t_source, source_size, target, copies, edge, left
    and tied."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size"))
    targets = source_targets(sizes, weights, share, cap)
    copies = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0))
    targets = targets.withColumn("copies", copies).withColumn("budget", F.floor("target") - F.col("copies") * F.col("source_size"))
    edges = hash_thresholds(rows, targets.filter("source_size > 0").select("source", "budget"))
    return targets.join(edges.withColumnRenamed("source", "e_source"), F.col("source").eqNullSafe(F.col("e_source")), "left").select(F.col("source").alias("t_source"), "source_size", "target", "copies", "edge", "left", "tied")


def taken(rows: DataFrame, by_source: DataFrame, sources: int) -> DataFrame:
    """rows (source, size, h, ...) with the columns of shares and taken."""
    by_source = written(by_source, "shares", sources)
    by_source = F.broadcast(by_source) if sources <= SOURCES else by_source
    part = F.when(F.col("h") < F.col("edge"), F.col("size")).when(F.col("h") == F.col("edge"), F.floor(F.col("left") * F.col("size") / F.col("tied"))).otherwise(0)
    return rows.join(by_source, rows["source"].eqNullSafe(F.col("t_source"))).withColumn("taken", (F.col("copies") * F.col("size") + part).cast("long"))


def repeated(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, key: str = "doc_id", whole: bool = False) -> DataFrame:
    """docs (doc_id, source, text, n_chars) as the mix of mix_sources takes them: a row for each whole copy, and for a document
    at its source's threshold its first words, as many as are taken, with n_chars to match. With whole
    that document goes in whole if at least half its words are taken, else not at all. All columns stay."""
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "source", n_words(F.col("text")).alias("size"), bits48(F.col(key)).alias("h"))
    found = written(sized.select("source", "size", "h"), "mix")
    out = taken(sized, shares(found, weights, share, cap), found.select("source").distinct().count()).filter("taken > 0")
    if whole:
        out = out.withColumn("taken", F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))) * F.col("size")).filter("taken > 0")
    copies, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), F.col("taken") % F.col("size")
    out = out.withColumn("__words", F.explode(F.concat(F.array_repeat(F.lit(-1).cast("long"), copies), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))))
    text = F.when(F.col("__words") < 0, F.col("__row.text")).otherwise(_first_words(F.col("__row.text"), F.col("__words")))
    own = {c: F.col(f"__row.`{c}`") for c in docs.columns}
    own["text"] = text
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("__words") < 0, own["n_chars"]).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return out.select(*[c.alias(k) for k, c in own.items()])


def _first_words(text: Column, n: Column) -> Column:
    """The first n words of a text with the white space between them."""
    # A word and the space after it are one match, so the matches are the text but for leading space.
    parts = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    return F.regexp_replace(F.array_join(F.slice(parts, F.lit(1), n.cast("int")), ""), r"[\x20\x09-\x0D]+$", "")


#: The same in DuckDB, with the parameters of the query.
MIX_SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
                  ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 12))::bigint as h from {documents}),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [3.0, 1.0, 2.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as w from s),
r as (select *, coalesce(sum(source_size) over b, 0)::double as s0, coalesce(sum(w) over b, 0)::double as w0, sum(source_size) over ()::double as s_all, sum(w) over () as w_all,
             row_number() over (order by source_size * 6 / w, source nulls last) as k from w
      window b as (order by source_size * 6 / w, source nulls last rows between unbounded preceding and 1 preceding)),
l as (select *, (1.5::double * s_all - 2.0::double * s0) / (w_all - w0) as level from r),
f as (select min(k) as k from l where not level * w > 2.0::double * source_size),
t as (select source, source_size, case when (select k from f) is null or l.k < (select k from f) then 2.0::double * source_size else (select level from l where k = (select k from f)) * w end as target from l),
c as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as copies from t),
b as (select *, floor(target)::bigint - copies * source_size as budget from c),
g as (select source, h, sum(size)::bigint as tied from d group by source, h),
u as (select *, sum(tied) over (partition by source order by h)::bigint as upto from g)
select d.doc_id, d.source, d.size, b.source_size, b.target,
       (b.copies * d.size + case when u.upto <= b.budget then d.size when u.upto - u.tied <= b.budget then (b.budget - u.upto + u.tied) * d.size // greatest(u.tied, 1) else 0 end)::bigint as taken
from d join b on d.source is not distinct from b.source join u on d.source is not distinct from u.source and d.h = u.h
"""
