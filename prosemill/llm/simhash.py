"""Near duplicates through a byte-position inverted index with count filtering.

A fingerprint is a row of positional bytes. If two fingerprints must share the bytes of at least m positions, then every
family of position sets of which one lies in any m positions gives keys that meet: SimHash values of 64 bits that differ in
at most 4 have at least 4 of 8 bytes in common, and among any 4 positions one of the 20 triples below is whole. The index is
dealt out by such keys, as lists of single bytes would each be a 256th of the table; under a key it has the posting lists of
each position and byte, from which shared bytes are tallied. Pairs with enough of them are verified.

Equal fingerprints are one entry. Within a key only a spanning forest of links is made, never all pairs, so a group of n
near copies gives n - 1 links a key. A key with very many entries is cut into blocks that are compared two by two in tasks
of their own, so no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, groupby, repeat
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import joined_by_key, workers, written
from .components import components

#: Entries of a key that a task compares at once.
BLOCK = 8192
SEED = 42


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased: bytes.split takes space and \\t to \\r as white space, and no other."""
    return (text or "").encode().lower().split()


def shingle_hashes(found: list[bytes], n: int) -> np.ndarray:
    """XXH64 of each run of n words, joined by spaces, repeats included; fewer words are one run, none give none."""
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = max(1, len(found) - n + 1)
    lasts = ends[n - 1 :] if len(found) >= n else ends[-1:]
    runs = [joined[s:e] for s, e in zip(starts[:k].tolist(), lasts.tolist())]
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, k)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[at : at + (1 << 14)], "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes), bitorder="little").tobytes(), "little")


@cache
def _multipliers(positions: int) -> np.ndarray:
    return np.random.default_rng(20_240_229).integers(0, 1 << 31, positions, np.uint32) * np.uint32(2) + np.uint32(1)


def minwise(hashes: np.ndarray, positions: int) -> bytes:
    """A byte for each position, of the shingle that is least in that position's order: two texts agree in a position as often
    as their shingle sets do, which is their Jaccard similarity."""
    if not len(hashes):
        return bytes(positions)
    by, least = _multipliers(positions), np.full(positions, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(least, (short[at : at + 512, None] * by[None, :]).min(0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


# --- index ---------------------------------------------------------------------------------------------------------


def covering_triples() -> list[tuple[int, ...]]:
    """Triples of 8 positions of which any 4 positions hold one (Turan's construction): positions in three classes on a
    circle; a triple inside a class, or two of a class and one of the next."""
    part = [0, 0, 0, 1, 1, 1, 2, 2]
    out = []
    for t in combinations(range(8), 3):
        n = [sum(part[p] == c for p in t) for c in range(3)]
        if 3 in n or any(n[c] == 2 and n[(c + 1) % 3] == 1 for c in range(3)):
            out.append(t)
    return out


#: Fingerprints from which keys of four bytes, more of them and each more selective, cost less than those of three.
WIDE = 1 << 26


def covering_sets(entries: int) -> list[tuple[int, ...]]:
    """Position sets of which any 4 of 8 positions hold one; which family it is changes what meets, not what is found."""
    return covering_triples() if entries < WIDE else list(combinations(range(8), 4))


def bands(positions: int, width: int, count: int) -> list[tuple[int, ...]]:
    """Disjoint runs of positions."""
    return [tuple(range(i * width, (i + 1) * width)) for i in range(min(count, positions // width))]


class Postings:
    """An inverted index of the signatures under one key: for each position and byte, the entries that have it there. What all
    entries have in common is counted once."""

    def __init__(self, signatures: np.ndarray):
        self.signatures = signatures
        varied = (signatures != signatures[0]).any(0)
        self.common, self.lists = int((~varied).sum()), []
        for p in np.flatnonzero(varied):
            column = signatures[:, p]
            order = np.argsort(column, kind="stable")
            self.lists.append((p, order, np.searchsorted(column[order], np.arange(257))))

    def tally(self, entry: int) -> np.ndarray:
        """How many positional bytes each entry shares with this one."""
        out, own = np.full(len(self.signatures), self.common, np.int32), self.signatures[entry]
        for p, order, starts in self.lists:
            out[order[starts[own[p]] : starts[own[p] + 1]]] += 1
        return out


def forest(signatures: np.ndarray, matches: int, bits: int | None) -> list[tuple[int, int]]:
    """Links of a spanning forest among signatures (rows of bytes) that share at least matches bytes and, with bits, differ in
    at most so many bits. Postings tally the shared bytes; pairs with enough of them are verified. Each entry is asked for
    once, and links only to entries that no other has reached."""
    n = len(signatures)
    if n == 2:
        both = (signatures[0] == signatures[1]).sum() >= matches
        return [(0, 1)] if both and (bits is None or np.unpackbits(signatures[0] ^ signatures[1]).sum() <= bits) else []
    index, out, waiting, left = Postings(signatures), [], np.ones(n, bool), n
    for first in range(n):
        if not waiting[first]:
            continue
        waiting[first], left, reached = False, left - 1, [first]
        while reached and left:
            now = reached.pop()
            near = np.flatnonzero(waiting & (index.tally(now) >= matches))
            if bits is not None and len(near):
                near = near[np.unpackbits(signatures[near] ^ signatures[now], axis=1).sum(1) <= bits]
            waiting[near], left = False, left - len(near)
            out.extend((now, int(i)) for i in near)
            reached.extend(near.tolist())
    return out


def _runs(batches: Iterator[pa.RecordBatch], size: int, most: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of equal key of rows (key, node, signature) sorted by key, as (whole, keys, nodes, signatures). A run of over most
    entries comes in parts, not whole; runs of one entry don't come."""
    keys, nodes, sigs = np.empty(0, np.int64), np.empty(0, object), np.empty((0, size), np.uint8)
    cut = None  # the key of a run that is passed on in parts
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False)))
        nodes = np.concatenate((nodes, np.asarray(batch.column(1).to_numpy(zero_copy_only=False), object)))
        sigs = np.concatenate((sigs, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, size)))
        last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if last:
            yield from _split(keys[:last], nodes[:last], sigs[:last], most, cut)
            keys, nodes, sigs = keys[last:], nodes[last:], sigs[last:]
        if len(keys) > most:
            cut = keys[0]
            yield False, keys, nodes, sigs
            keys, nodes, sigs = keys[:0], nodes[:0], sigs[:0]
    if len(keys):
        yield from _split(keys, nodes, sigs, most, cut)


def _split(keys, nodes, sigs, most, cut):
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    ends = np.append(starts[1:], len(keys))
    late = cut is not None and keys[0] == cut
    for i in np.flatnonzero((ends - starts > 1) | ((starts == 0) & late)):
        a, b = starts[i], ends[i]
        yield not (b - a > most or (a == 0 and late)), keys[a:b], nodes[a:b], sigs[a:b]


def links(entries: DataFrame, sets: list[tuple[int, ...]], matches: int, bits: int | None, positions: int, block: int = BLOCK) -> DataFrame:
    """entries (node, signature binary, distinct nodes) to links (a, b) that join whatever can be joined by pairs sharing at
    least matches positional bytes, differing in at most bits bits, and meeting in all positions of one of sets."""
    workers(entries.sparkSession)
    kind = entries.schema["node"].dataType.simpleString()
    found = F.array(*[F.xxhash64(F.lit(i), *[F.substring("signature", p + 1, 1) for p in s]) for i, s in enumerate(sets)])
    keyed = entries.select(F.explode(found).alias("key"), "node", "signature")

    def joined(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, late = [], [], [[], [], []]
        for complete, keys, nodes, sigs in _runs(batches, positions, most):
            if complete:
                for i, j in forest(sigs, matches, bits):
                    a.append(nodes[i])
                    b.append(nodes[j])
            else:
                for x, y in zip(late, (keys.tolist(), nodes.tolist(), [s.tobytes() for s in sigs])):
                    x.extend(y)
            if len(a) > 10_000 or len(late[0]) > 2 * block:
                yield rows(a, b, late)
                a, b, late = [], [], [[], [], []]
        yield rows(a, b, late)

    def rows(a: list, b: list, late: list) -> pa.RecordBatch:
        n, m, t = len(a), len(late[0]), pa.string() if kind == "string" else pa.int64()
        return pa.RecordBatch.from_arrays([pa.array(a + [None] * m, t), pa.array(b + [None] * m, t), pa.array([None] * n + late[0], pa.int64()), pa.array([None] * n + late[1], t), pa.array([None] * n + late[2], pa.binary())], names=["a", "b", "key", "node", "signature"])

    schema = f"a {kind}, b {kind}, key long, node {kind}, signature binary"
    dealt = keyed.repartition("key").sortWithinPartitions("key", "node")
    made = written(dealt.mapInArrow(lambda it: joined(block, it), schema), "links")
    out = made.filter("key is null").select("a", "b")
    late = made.filter("key is not null").select("key", "node", "signature")
    if late.isEmpty():
        return out.distinct()
    # Keys of over block entries: blocks by hash, each pair of blocks a key of its own.
    blocks = late.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(F.col("key").alias("k"), F.ceil(2 * F.col("n") / block).alias("blocks"))
    part = F.pmod(F.xxhash64("node"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    paired = late.join(blocks, F.col("key") == F.col("k")).withColumn("part", part).withColumn("other", other)
    paired = paired.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("key"), "node", "signature")
    rest = paired.repartition("key").sortWithinPartitions("key", "node").mapInArrow(lambda it: joined(1 << 62, it), schema)
    return out.unionByName(rest.select("a", "b")).distinct()


# --- SimHash -------------------------------------------------------------------------------------------------------


def fingerprints(docs: DataFrame, n: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of n-word shingles as a signed long; 0 without words."""
    workers(docs.sparkSession)

    @F.pandas_udf("long")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(shingle_hashes(words(t), n)) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(key).cast("long").alias("doc_id"), made(F.col(text)).alias("fp"))


def simhash_components(docs: DataFrame, n: int = 4, bits: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint, component_id): 16 hex digits, and the least id of all documents reachable over links, which
    join fingerprints that differ in at most bits (up to 4) bits; a document without words has fingerprint zero like any other.

    Null texts count as empty. A null id has its row; it counts in no minimum, and a component of null ids alone has a null
    component_id. Repeated rows stay. An empty table gives an empty result; other columns are ignored.
    """
    if not 0 <= bits <= 4:
        raise ValueError("bits: 0 to 4")
    rows = written(fingerprints(docs, n, key, text), "fingerprints")
    entries = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "entries")
    signature, size = F.unhex(F.lpad(F.hex("fp"), 16, "0")), entries.agg(F.count(F.lit(1)), F.sum("n")).first()
    found = components(links(entries.select(F.col("fp").alias("node"), signature.alias("signature")), covering_sets(size[0]), 8 - bits, bits, 8))
    joined = entries.join(found, F.col("fp") == F.col("node")).select("fp", "root", "least")
    roots = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    own = joined.select("fp", "root").join(roots, "root").select(F.col("fp").alias("c_fp"), "component_id")
    classes = entries.join(own, F.col("fp") == F.col("c_fp"), "left").select("fp", "n", F.when(F.col("c_fp").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    out = joined_by_key(rows, written(classes, "fingerprint-classes"), "fp", "n", size[1] or 0)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- similarity of shingle sets ------------------------------------------------------------------------------------

POSITIONS, BAND, BANDS, MARGIN = 128, 3, 10, 0.1
#: Texts, and hashes of their sets, of a group that a task has at once of each of two blocks.
TEXTS, HASHES = 2048, 1 << 20


def alike(signatures: np.ndarray, sets: list[np.ndarray], matches: int, similarity: float) -> list[tuple[int, int]]:
    """Links (first, other) of the components among texts of which each pair that shares at least matches bytes of its
    signatures and has a Jaccard similarity of at least similarity is joined. Every such pair is tested on its whole sets
    unless other pairs have joined it before."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    found, ids = np.unique(np.concatenate(sets), return_inverse=True)
    sets = np.split(ids, np.cumsum(sizes)[:-1])
    mark, out = np.zeros(len(found), np.int8), []
    waiting = np.arange(len(sets))
    while len(waiting):
        first, waiting = int(waiting[0]), waiting[1:]
        reached = [first]
        while reached and len(waiting):
            now = reached.pop()
            least, most = np.minimum(sizes[waiting], sizes[now]), np.maximum(sizes[waiting], sizes[now])
            near = np.flatnonzero(((signatures[waiting] == signatures[now]).sum(1) >= matches) & (least >= similarity * most))
            if not len(near):
                continue
            other = waiting[near]
            mark[sets[now]] = 1
            ends = np.cumsum(sizes[other])
            total = np.concatenate(([0], np.cumsum(mark[np.concatenate([sets[i] for i in other])], dtype=np.int64)))
            mark[sets[now]] = 0
            shared = total[ends] - total[ends - sizes[other]]
            sure = shared >= similarity * (sizes[other] + sizes[now] - shared)
            joined = other[sure].tolist()
            out.extend((first, i) for i in joined)
            reached.extend(joined)
            waiting = np.delete(waiting, near[sure])
    return out


def alike_links(texts: DataFrame, matches: int, similarity: float) -> DataFrame:
    """texts (node, root, signature binary, h binary: a set of hashes) to links (a, b) with the components that alike gives
    for each root. A root with many texts is cut into blocks by hash, and each pair of blocks has a task of its own."""
    sizes = texts.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("h") / 8).alias("hashes"))
    blocks = sizes.select(F.col("root").alias("b_root"), F.greatest(F.ceil(F.col("n") / TEXTS), F.ceil(F.col("hashes") / HASHES), F.lit(1)).cast("long").alias("blocks"))
    own = texts.join(blocks, F.col("root") == F.col("b_root")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # A pair of blocks has the pairs within each, so a block needs no task with itself unless it is the only one.
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: (o != F.col("part")) | (F.col("blocks") == 1))
    paired = own.withColumn("other", F.explode(others))
    keyed = paired.select(F.concat_ws(" ", "root", F.least("part", "other"), F.greatest("part", "other")).alias("key"), "node", "signature", "h")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        a, b = [], []
        for _, run in groupby(rows, itemgetter(0)):
            _, nodes, signatures, sets = zip(*run)
            if len(nodes) == 1:
                continue
            signatures = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(nodes), -1)
            for i, j in alike(signatures, [np.frombuffer(h, np.int64) for h in sets], matches, similarity):
                a.append(nodes[i])
                b.append(nodes[j])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])

    return keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(joined, "a string, b string")


def near_copies(docs: DataFrame, n: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (node, root, least, least_rows, copies): each distinct text's MD5, that of its group, the least id of its rows, how
    many rows have it and how many rows there are.

    Texts whose sets of n-word shingles have a Jaccard similarity of at least similarity are linked. Such sets differ in
    about 10 of 64 SimHash bits, so that no byte need be shared and the index above can't find them; it is run over another
    row of positional bytes, min-wise ones, of which similar texts share that part. Of 128 positions, 10 bands of 3 give the
    keys (at 0.8 one of 1300 pairs shares none), and pairs that share at least similarity - 0.1 of the positions are
    candidates. The index gives the components of the candidates; within each the whole shingle sets of every candidate pair
    decide, but of those that other pairs have joined before.
    """
    workers(docs.sparkSession)

    @F.pandas_udf("binary")
    def signed(texts: pd.Series) -> pd.Series:
        return pd.Series([minwise(shingle_hashes(words(t), n), POSITIONS) for t in texts])

    @F.pandas_udf("binary")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(words(t), n)).tobytes() for t in texts])

    text_of = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.md5(text_of.cast("binary")).alias("node"), text_of.alias("text"))
    rows = named.select("doc_id", "node", signed("text").alias("signature")).groupBy("node", "doc_id").agg(F.first("signature").alias("signature"), F.count(F.lit(1)).alias("rows"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rows"))
    classes = rows.groupBy("node").agg(least.alias("l"), F.first("signature").alias("signature"), F.sum("rows").alias("copies"))
    classes = written(classes.select("node", F.col("l.doc_id").alias("least"), F.col("l.rows").alias("least_rows"), "copies", "signature"), "classes")

    matches = round((similarity - MARGIN) * POSITIONS)
    near = components(written(links(classes.select("node", "signature"), bands(POSITIONS, BAND, BANDS), matches, None, POSITIONS), "near"))
    groups = written(near.withColumnRenamed("node", "e_node").join(classes.select("node", "least", "signature"), F.col("e_node") == F.col("node")).select("e_node", "root", "least", "signature"), "groups")
    # One row of each linked text: any with its least id.
    texts = named.join(groups, (F.col("node") == F.col("e_node")) & F.col("doc_id").eqNullSafe(F.col("least")))
    sets = written(texts.select("node", "root", "signature", hashed("text").alias("h")).dropDuplicates(["node"]), "sets")
    found = components(written(alike_links(sets, matches, similarity), "alike")).withColumnRenamed("node", "f_node")
    joined = classes.drop("signature").join(found, F.col("node") == F.col("f_node"), "left")
    return joined.select("node", F.coalesce("root", "node").alias("root"), "least", "least_rows", "copies")


def drop_near_copies(docs: DataFrame, n: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near copies: that of the least id (nulls last; of its rows of one text the least by
    the other columns). All columns stay. Texts without words are copies of each other. An empty table stays empty."""
    groups = near_copies(docs, n, similarity, key, text)
    order = F.struct(F.col("least").isNull().alias("none"), "least", "node", "least_rows")
    kept = written(groups.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.node").alias("__node"), F.col("k.least").alias("__least"), F.col("k.least_rows").alias("__rows")), "kept")
    own = docs.withColumn("__md5", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    out = own.join(kept, (F.col("__md5") == F.col("__node")) & own[key].cast("long").eqNullSafe(F.col("__least")))
    once = out.filter("__rows = 1").select(*docs.columns)
    if kept.filter("__rows > 1").isEmpty():
        return once
    by = Window.partitionBy("__md5").orderBy(*[F.col(f"`{f.name}`") for f in docs.schema if f.dataType.typeName() not in ("map", "variant")])
    return once.unionByName(out.filter("__rows > 1").withColumn("__at", F.row_number().over(by)).filter("__at = 1").select(*docs.columns))
