"""Groups of near copies by an exact set-similarity join of word shingles.

Two documents are near copies if the Jaccard similarity of their sets of
``SHINGLE``-word shingles is 4/5 or more; groups are the components of these
pairs. Words are split at ASCII white space and compared without ASCII case.

1. Documents of equal sets are one node, named by 64 bits of its hashes.
2. SimHash fingerprints of these shingles are linked at ``NEAR_BITS`` or fewer
   differing bits over Gray-order hierarchical indexes (:mod:`fingerprints`).
   These links are verified, and what they connect is one component from then on.
3. No radius of a fingerprint finds all pairs of similarity 4/5, which differ in
   ten bits of 64 on average, so the rest are found by prefixes. Shingles are
   counted in a table of fixed size (``BUCKETS``), which orders them by rarity,
   then by hash. Every node files the rarest of its set, its prefix: two similar
   sets share one, and texts that only share common passages mostly do not.
   Sizes, places and the number of shared hashes rule out most other pairs.
4. Large groups are settled in linear work: in a few ``ROUNDS`` every node is held
   against ``PICKS`` nodes of other components so far, of those that come first
   or a few places before it (``BACK``) in its files the ones met most often. Files
   that lie in one component by then are closed; in the others all pairs across
   components are held against each other.
5. Every pair is verified on the whole sets of 64-bit hashes, if the parities of
   both sets (:func:`sketch`), which bound the overlap from above, allow a match.

Edge cases: null and empty texts have the empty set and are one group; texts
shorter than a shingle are one shingle; rows with a null id take part but never
name a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from optiloom.functions.storage import Scratch, saved
from optiloom.llm.components import components
from optiloom.llm.fingerprints import links, majority, shingle_hashes
from optiloom.llm.words import as_bytes

SHINGLE = 5
#: Bits in which linked fingerprints differ at most; wider than op10's two.
NEAR_BITS = 3
#: Places before a node in a file whose nodes it is held against at first.
BACK = (1, 2, 4, 8, 16, 32)
ROUNDS = 3
#: Nodes that a node is held against in a round.
PICKS = 4
#: Texts to verify up to which their ids are broadcast; with more, all texts are hashed again.
FEW = 500_000
#: Counters of the rarity table: its size doesn't grow with the corpus.
BUCKETS = 1 << 18


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Distinct XXH64 values (seed 42) of the shingles, ascending."""
    return np.unique(shingle_hashes(text, size))


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the set's hashes by their low bits, two to four for each hash (256 at least), in a power of two of words.

    Two sets that differ in d elements differ in d parities at most, also when the
    halves of the longer sketch are folded into one.
    """
    n = 1 << max(2, (len(s) // 32).bit_length())
    odd = np.bincount((s & np.uint64(64 * n - 1)).astype(np.int64), minlength=64 * n).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<u8")


def prefix_length(n: int) -> int:
    """Of ``n`` sorted elements, as many that a set of similarity 4/5 must share one."""
    return n - (4 * n + 4) // 5 + 1 if n else 0


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(46)).astype(np.int64)


def rarity(docs: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """A level for each bucket of shingles that rises with the number of texts that hold them, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                np.add.at(counts, _bucket(shingles(text, size)), 1)
        some = np.flatnonzero(counts)
        for low in range(0, len(some), 1 << 16):
            at = some[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["b", "n"])

    rows = docs.select("text").mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()  # a row per bucket at most
    levels = np.zeros(BUCKETS, np.uint8)
    levels[rows.column("b").to_numpy()] = np.minimum(np.log2(rows.column("n").to_numpy()) * 4, 255)
    return levels


def _lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int32)), pa.array(flat.view(np.int64)))


def _named(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.tobytes(), 7)


def _marked(docs: DataFrame, size: int, levels: np.ndarray) -> DataFrame:
    """id, fp (name of the set), n, print (the SimHash fingerprint), sketch, and the hashes of the prefix, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                every = [shingle_hashes(x, size) for x in as_bytes(part.column(1))]
                prints = np.array([majority(x) for x in every], np.uint64).view(np.int64)
                sets = [np.unique(x) for x in every]
                fps = np.array([_named(s) for s in sets], np.uint64).view(np.int64)
                kept = [s[np.lexsort((s, levels[_bucket(s)]))][: prefix_length(len(s))] for s in sets]
                columns = [part.column(0), pa.array(fps), pa.array([len(s) for s in sets], pa.int32()), pa.array(prints), _lists([sketch(s) for s in sets]), _lists(kept)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "fp", "n", "print", "sketch", "hashes"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, fp long, n int, print long, sketch array<bigint>, hashes array<bigint>")


def _whole(docs: DataFrame, size: int) -> DataFrame:
    """fp and all hashes of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                sets = [shingles(x, size) for x in as_bytes(batch.column(0).slice(low, 256))]
                yield pa.RecordBatch.from_arrays([pa.array(np.array([_named(s) for s in sets], np.uint64).view(np.int64)), _lists(sets)], names=["fp", "hashes"])

    return docs.select("text").mapInArrow(run, "fp long, hashes array<bigint>")


def _may_match(a: str, b: str) -> Column:
    """Sizes and the elements from the shared one on allow the overlap 4/9 of the sum."""
    c = lambda side, name: F.col(f"{side}.{name}")
    most = F.least(c(a, "n") - c(a, "k"), c(b, "n") - c(b, "k")) + F.least(c(a, "k"), c(b, "k"))
    return (5 * F.least(c(a, "n"), c(b, "n")) >= 4 * F.greatest(c(a, "n"), c(b, "n"))) & (9 * most >= 4 * (c(a, "n") + c(b, "n")))


def _shared(rows: DataFrame) -> DataFrame:
    """u, un, v, vn, vroot, c: pairs of structs ``a`` and ``b``, and how often they occur."""
    return rows.groupBy(F.col("a.fp").alias("u"), F.col("a.n").alias("un"), F.col("b.fp").alias("v"), F.col("b.n").alias("vn"), F.col("b.root").alias("vroot")).agg(F.count(F.lit(1)).alias("c"))


def _pairs(rows: DataFrame) -> DataFrame:
    """u, v: pairs of structs ``a`` and ``b``, one row for each prefix hash they share, whose sets can reach the threshold given these.

    Up to the last hash of the prefix that reaches less far in the order all
    shared ones are counted, so the overlap is their number and at most the rest
    of that set.
    """
    rest = lambda n: n - (n - F.floor((4 * n + 4) / F.lit(5)) + 1)
    return _shared(rows).where(9 * (F.col("c") + F.greatest(rest(F.col("un")), rest(F.col("vn")))) >= 4 * (F.col("un") + F.col("vn"))).select("u", "v")


def _ends(pairs: DataFrame) -> DataFrame:
    """fp of every node of the saved pairs; few enough are broadcast."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
    return F.broadcast(ends) if pairs.count() <= FEW // 2 else ends


def _both(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs with the structs ``a`` and ``b`` of the other columns of ``nodes``."""
    rest = F.struct(*[c for c in nodes.columns if c != "fp"])
    return pairs.join(nodes.select(F.col("fp").alias("u"), rest.alias("a")), "u").join(nodes.select(F.col("fp").alias("v"), rest.alias("b")), "v")


def _differ(a: Column, b: Column) -> Column:
    """Parities in which two sketches differ, the longer one folded to the length of the other."""
    halves = lambda x: F.zip_with(F.slice(x, F.lit(1), F.floor(F.size(x) / 2).cast("int")), F.slice(x, F.floor(F.size(x) / 2).cast("int") + 1, F.size(x)), lambda p, q: p.bitwiseXOR(q))
    folded = lambda x, y: F.when(F.size(x) > F.size(y), halves(x)).otherwise(x)
    return F.aggregate(F.zip_with(folded(a, b), folded(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, x: n + x)


def _possible(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """The saved pairs whose sizes and sketches allow a difference of 1/9 of both sizes."""
    some = marked.select("fp", "n", "sketch").join(_ends(pairs), "fp", "left_semi").groupBy("fp").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    alike = 5 * F.least("a.n", "b.n") >= 4 * F.greatest("a.n", "b.n")
    near = F.when(alike, 9 * _differ(F.col("a.sketch"), F.col("b.sketch")) <= F.col("a.n") + F.col("b.n"))
    return _both(pairs, some).where(near).select("u", "v")


def _verified(pairs: DataFrame, docs: DataFrame, marked: DataFrame, size: int) -> DataFrame:
    """The saved pairs whose sets reach the threshold, saved."""
    work = Scratch(docs.sparkSession)
    pairs = work.save(_possible(pairs, marked))
    wanted = work.save(pairs.select(F.col("u").alias("fp")).unionByName(pairs.select(F.col("v").alias("fp"))).distinct())
    if wanted.count() <= FEW:
        ids = marked.join(wanted, "fp").groupBy("fp").agg(F.min("id").alias("__id"))
        docs = docs.join(F.broadcast(ids), docs["id"].eqNullSafe(ids["__id"]), "left_semi")
    sets = work.save(_whole(docs, size).join(wanted, "fp", "left_semi").groupBy("fp").agg(F.first("hashes").alias("s")))
    found = saved(_both(pairs, sets).where(9 * F.size(F.array_intersect("a.s", "b.s")) >= 4 * (F.size("a.s") + F.size("b.s"))).select("u", "v"))
    work.drop()
    return found


def by_fingerprint(marked: DataFrame, bits: int = NEAR_BITS) -> DataFrame:
    """u, v: pairs of nodes that connect all nodes whose fingerprints are linked at ``bits`` or fewer differing bits."""
    work = Scratch(marked.sparkSession)
    prints = work.save(marked.groupBy("print").agg(F.min("fp").alias("least")))
    same = marked.select("fp", "print").distinct().join(prints, "print").where(F.col("fp") != F.col("least")).select(F.col("fp").alias("u"), F.col("least").alias("v"))
    linked = work.save(links(prints.select(F.col("print").alias("fp")), bits))
    sides = [prints.select(F.col("print").alias(c), F.col("least").alias(f"{c}_")) for c in ("u", "v")]
    linked = linked.join(sides[0], "u").join(sides[1], "v").select(F.col("u_").alias("u"), F.col("v_").alias("v"))
    pairs = saved(same.unionByName(linked).distinct())
    work.drop()
    return pairs


def _placed(held: DataFrame, roots: DataFrame) -> DataFrame:
    """The files that lie in several components, with the component of every node."""
    rows = held.join(roots, F.col("fp") == F.col("node"), "left").select("token", "fp", "n", "k", F.coalesce("root", "fp").alias("root"))
    whole = Window.partitionBy("token")
    return rows.withColumn("__m", F.min("root").over(whole) != F.max("root").over(whole)).where("__m").drop("__m")


def _closest(placed: DataFrame) -> DataFrame:
    """u, v: for each node a few of the first and some previous nodes of its files, of other components each, met most often."""
    row, order = F.struct("fp", "n", "k", "root"), Window.partitionBy("token").orderBy("n", "fp")
    before = F.array_distinct(F.array(F.first(row).over(order), *[F.lag(row, k).over(order) for k in BACK]))
    met = placed.select(row.alias("a"), before.alias("bs")).select("a", F.explode("bs").alias("b"))
    some = _shared(met.where(F.col("b").isNotNull() & (F.col("a.root") != F.col("b.root")) & _may_match("a", "b")))
    one = some.groupBy("u", "vroot").agg(F.max(F.struct("c", "v")).alias("m"))
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("m")))
    return one.withColumn("__p", place).where(F.col("__p") <= PICKS).select("u", F.col("m.v").alias("v"))


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, component_id), the least id of its group, for every row."""
    work = Scratch(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    marked = saved(_marked(base, size, rarity(base, size)))
    near = _verified(by_fingerprint(marked), base, marked, size)
    roots = work.save(components(near))
    nodes = marked.groupBy("fp").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"))
    filed = nodes.select("fp", "n", F.posexplode("hashes").alias("k", "token"))
    held = work.save(filed.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("held > 1").drop("held"))

    for _ in range(ROUNDS):
        new = _verified(work.save(_closest(_placed(held, roots))), base, marked, size)
        if new.isEmpty():
            break
        near = near.unionByName(new)
        roots = work.save(components(near))
    mixed = _placed(held, roots)
    across = (F.col("a.token") == F.col("b.token")) & (F.col("a.root") < F.col("b.root")) & _may_match("a", "b")
    sides = mixed.alias("a").join(mixed.alias("b"), across).select(F.struct("a.fp", "a.n").alias("a"), F.struct("b.fp", "b.n", "b.root").alias("b"))
    rest = _verified(work.save(_pairs(sides)), base, marked, size)
    linked = saved(components(near.unionByName(rest)))
    work.drop()

    named = marked.select("id", "fp").join(linked, F.col("fp") == F.col("node"), "left").select("id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    return named.join(least, "root").select(F.col("id").alias("doc_id"), "component_id")
