"""Canonical exact digests: normalise, fold, hash wide, compare bytes inside equal buckets."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL, joined_by_key, workers, written


def canonical(text: str | None) -> str:
    """NFKC, case folded, each run of white space one space, none at the ends; folding can undo normal form, so both repeat."""
    text = text or ""
    if text.isascii():
        return " ".join(text.lower().split())
    once = unicodedata.normalize("NFKC", text).casefold()
    return " ".join(unicodedata.normalize("NFKC", once).casefold().split())


def digest(form: str) -> str:
    """128 bits of xxhash in hex, over the UTF-8 of a canonical form."""
    return xxhash.xxh3_128_hexdigest(form.encode("utf-8", "surrogatepass"))


def second(form: str) -> str:
    """Other 128 bits, by another seed; what tells apart different forms in one bucket."""
    return xxhash.xxh3_128_hexdigest(form.encode("utf-8", "surrogatepass"), seed=0x9E3779B9)


def add_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with columns digest and second. Null texts count as empty. Columns of those names are replaced, others stay."""
    workers(docs.sparkSession)

    @F.pandas_udf("digest string, second string")
    def made(texts: pd.Series) -> pd.DataFrame:
        forms = [canonical(t) for t in texts]
        return pd.DataFrame({"digest": [digest(f) for f in forms], "second": [second(f) for f in forms]})

    return docs.withColumn("__made", made(F.col(text))).withColumn("digest", F.col("__made.digest")).withColumn("second", F.col("__made.second")).drop("__made")


#: Hex digits of a digest that number the bits of a fixed map of 2 MB.
MAP_DIGITS = 6


def crowded_map(digests: DataFrame) -> np.ndarray:
    """A bit for each value of a digest's first MAP_DIGITS digits under which a digest has several rows. Its size is fixed; with
    very many digests it lets more through, which costs time but changes no result."""
    many = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    bit = F.conv(F.substring("digest", 1, MAP_DIGITS), 16, 10).cast("long")
    words = many.select(F.floor(bit / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(16**MAP_DIGITS // 64, np.int64)
    for r in words.toLocalIterator():
        out[r["word"]] = r["bits"]
    return out.view(np.uint64)


def collisions(docs: DataFrame, digests: DataFrame | None = None, text: str = "text") -> DataFrame:
    """The digests, one row each, under which docs has different canonical forms: those of a bucket are compared byte for
    byte, the least with the greatest, in partial sums first. Only forms whose digest may be crowded are moved. digests: a
    column digest of all rows, if it is known."""
    workers(docs.sparkSession)
    crowded = docs.sparkSession.sparkContext.broadcast(crowded_map(add_digests(docs.select(text), text) if digests is None else digests))

    @F.pandas_udf("digest string, form string")
    def made(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            found = digest(form := canonical(t))
            at = int(found[:MAP_DIGITS], 16)
            out.append((found, form if int(crowded.value[at >> 6]) >> (at & 63) & 1 else None))
        return pd.DataFrame(out, columns=["digest", "form"])

    forms = docs.select(made(F.col(text)).alias("m")).select("m.digest", "m.form").filter("form is not null")
    forms = forms.groupBy("digest").agg(F.min("form").alias("least"), F.max("form").alias("greatest"))
    return forms.filter(F.col("least") != F.col("greatest")).select("digest")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint, group_id, copies): documents of equal canonical form share a fingerprint; group_id is the
    least id among them and copies their number. The fingerprint is the digest, and where different forms share one, both
    digests. Null texts count as empty; an empty table gives an empty result; other columns are ignored."""
    rows = add_digests(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))).drop("text")
    rows = written(resolved(rows, collisions(docs, text=text), {"fingerprint": ("digest", "second")}).select("doc_id", "fingerprint"), "exact-rows")
    groups = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("copies")), "exact-groups")
    total = groups.agg(F.sum("copies")).first()[0] or 0
    out = joined_by_key(rows, groups.withColumn("n", F.col("copies")), "fingerprint", "n", total)
    return out.select("doc_id", "fingerprint", "group_id", "copies")


def resolved(rows: DataFrame, clash: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
    """rows with columns of fingerprints, each from a digest and a second one that counts where the digest is in clash. That
    table is next to always empty, and then nothing is joined."""
    clash = written(clash.select(F.col("digest").alias("__clash")), "clashes")
    size = clash.count()
    for name, (first, other) in names.items():
        if not size:
            rows = rows.withColumn(name, F.col(first))
            continue
        mark = F.broadcast(clash) if size <= SMALL else clash
        rows = rows.join(mark, rows[first] == mark["__clash"], "left").withColumn(name, F.when(F.col("__clash").isNotNull(), F.concat_ws("-", first, other)).otherwise(F.col(first))).drop("__clash")
    return rows


def edited(text: str, following: str) -> str:
    """text with its last half replaced by the first as many code points of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare(doc_id, text: str, following: str) -> tuple:
    form, other = canonical(text), edited(text, following)
    changed, ahead = canonical(other), canonical(following)
    return doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), digest(form), second(form), digest(changed), second(changed), float(form == changed), float(form == ahead)


FIELDS = ["doc_id", "n_chars", "edited_sha256", "digest", "second", "edited_digest", "edited_second", "near_edited", "near_next"]
#: part: the partition; at: 0 for a finished row, 1 for the partition's first text, 2 for its last, which waits for the next.
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, digest string, second string, edited_digest string, edited_second string, near_edited double, near_next double, part int, at int, text string"


def compare_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document against its edited text and the next document, by descending id, as FIELDS.

    One range shuffle puts the texts in order; each partition then compares its rows as they stream by and writes down its
    first and last text, two rows a partition, which meet afterwards. Rows of equal id go by the text's hash, then the text.
    Null ids come last, null texts count as empty; the last row is followed by the first, an only row by itself.
    """
    spark = workers(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h").asc(), F.col("text").asc()]
    rows = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            out = []
            for doc_id, body in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                doc_id = None if doc_id is pd.NA else int(doc_id)
                if held is None:
                    out.append((None,) * len(FIELDS) + (part, 1, body))
                else:
                    out.append(compare(*held, body) + (part, 0, None))
                held = doc_id, body
            yield frame(out)
        if held is not None:
            yield frame([(held[0],) + (None,) * (len(FIELDS) - 1) + (part, 2, held[1])])

    def frame(out: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(out, columns=[*FIELDS, "part", "at", "text"])
        return made.astype({"doc_id": "Int64", "n_chars": "Int64"})

    done = written(rows.select("doc_id", "text").mapInPandas(walk, SCHEMA), "neighbours")
    ends, starts = done.filter("at = 2").select("doc_id", "text", "part"), done.filter("at = 1")
    # The numbers of partitions alone are lined up in one task; their texts are joined to them.
    parts = starts.select(F.col("part").alias("s_part"))
    line = parts.select("s_part", F.coalesce(F.lag("s_part").over(Window.orderBy("s_part")), F.max("s_part").over(Window.partitionBy())).alias("part"))
    following = starts.select(F.col("part").alias("f_part"), F.col("text").alias("following"))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [None if x is pd.NA else int(x) for x in batch["doc_id"].astype("Int64")]
            yield frame([compare(i, t, f) + (0, 0, None) for i, t, f in zip(ids, batch["text"], batch["following"])])

    last = ends.join(line, "part").join(following, F.col("s_part") == F.col("f_part")).select("doc_id", "text", "following").mapInPandas(finish, SCHEMA)
    return done.filter("at = 0").unionByName(last).select(*FIELDS)


def crossed(rows: DataFrame) -> DataFrame:
    """The digests that an edited text shares with another text, edited or not, while their second digests differ. Edited forms
    are nowhere stored, so these 128 bits of another seed stand for their bytes."""
    both = rows.select("digest", "second").unionByName(rows.select(F.col("edited_digest").alias("digest"), F.col("edited_second").alias("second")))
    sums = both.groupBy("digest").agg(F.min("second").alias("least"), F.max("second").alias("greatest"))
    return sums.filter(F.col("least") != F.col("greatest")).select("digest")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) with fingerprints of their texts and edited texts, and how like those of the neighbours are:
    1 if the canonical forms have the same bytes, else 0. Cases: see compare_neighbours and exact_groups."""
    rows = compare_neighbours(docs)
    clash = collisions(docs, rows.select("digest")).unionByName(crossed(rows)).distinct()
    rows = resolved(rows, clash, {"fingerprint": ("digest", "second"), "edited_fingerprint": ("edited_digest", "edited_second")})
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
