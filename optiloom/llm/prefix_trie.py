"""Prefix trie of conversations by prefix-doubling names.

Turns get dense names (equal role and text: equal name). A block of 2**k turns
that starts at a multiple of its length is named by the pair of names of its
halves, so one join round per k names all blocks, and half as many rows are left
for the next. A prefix of d turns is the blocks of d's binary digits, the largest
first; their names are its name, and prefixes of one length with one name are one
node. The number of rounds is the logarithm of the longest conversation.

What a node needs from its subtree comes without walking levels. Call the
smallest member of a node its owner. Members only leave on the way down, so a
conversation owns all its nodes from some depth on, or none. A subtree's nodes are
then those that its members own at or below its top, each once: a member that owns
the top gives a suffix sum of its own nodes, any other member the sum of all nodes
it owns. Leaves and children are counted in the same way, so all of it is one
grouping of (conversation, depth) rows by node. Owner and depth identify a node.

Rows are spread by (conversation, place), never by conversation: positions and
suffix sums run over ranges, hot nodes are reduced before they are shuffled, and
only the ids that end in one node meet, as sorted strings of at most 4,096 ids which
a hash reads one after another. Texts stay where they are; their SHA-256 moves.

Edge cases: rows of a null conv_id are left out; a null turn comes first, equal
turns are in the order of the SHA-256 of role and text; null role or text is empty;
repeated rows are turns of their own; an empty table has no nodes; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from optiloom.functions.ordered import running
from optiloom.functions.storage import Scratch
from optiloom.llm.native import EMPTY_SHA256

#: Conversations share the head of the first of each so many ids.
BLOCK = 100
#: Heads have fewer turns than this.
HEADS = 6
#: Ids whose numbers agree but for so many low bits are hashed as one string.
CHUNK_BITS = 12
#: Prefix lengths made from one row at once.
SPREAD = 1024


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, key, chars): turns by place from 0, with the hash of role and text, and the text's code points."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where(F.col("conv_id").isNotNull())
    rows = rows.select("conv_id", "turn", F.unhex(F.sha2(content.cast("binary"), 256)).alias("key"), F.length(text).cast("long").alias("chars"))
    return running(rows, ("turn", "key"), F.lit(1), F.sum, "i", by=("conv_id",)).select("conv_id", (F.col("i") - 1).alias("i"), "key", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (c, i, the rest of ``turns``) of the rebuilt conversations, and (c, size) of each of these."""
    rest = [c for c in turns.columns if c not in ("conv_id", "i")]
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    convs = convs.select(F.col("conv_id").alias("c"), "n", (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"), head.alias("h"))
    bases = convs.select(F.col("c").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn("p", F.least("h", F.coalesce("n_base", F.lit(0).cast("long"))))
    convs = convs.withColumn("size", F.col("p") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    own = turns.withColumnRenamed("conv_id", "c").join(convs.select("c", "h", "p"), "c").where("i >= h")
    heads = turns.where(F.col("i") < HEADS - 1).withColumnRenamed("conv_id", "base").join(convs.select("c", "base", "p"), "base").where("i < p")  # at most BLOCK x HEADS rows a base
    placed = own.select("c", (F.col("i") - F.col("h") + F.col("p")).alias("i"), *rest).unionByName(heads.select("c", "i", *rest))
    return placed, convs.select("c", "size")


def named(keys: DataFrame, work: Scratch, out: str) -> DataFrame:
    """Distinct ``keys`` with numbers 0, 1, ... in column ``out``; written first, so that a number never changes."""
    found = work.save(keys.distinct().withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id()))
    parts = found.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__low"))  # a row a partition
    parts = parts.select("__part", "__low", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return found.join(F.broadcast(parts), "__part").select(*keys.columns, (F.col("__before") + F.col("__id") - F.col("__low")).alias(out))


def blocks(turns: DataFrame, longest: int, work: Scratch) -> list[DataFrame]:
    """Named blocks (c, i, name) of 2**k turns for each k; ``turns`` are those of one turn."""
    levels = [turns.select("c", "i", "name")]
    while 1 << len(levels) <= longest:
        half = F.col("i") % 2 == 0
        pairs = levels[-1].groupBy("c", F.shiftright("i", 1).alias("i")).agg(F.max(F.when(half, F.col("name"))).alias("left"), F.max(F.when(~half, F.col("name"))).alias("right"))
        pairs = pairs.where(F.col("right").isNotNull())
        names = named(pairs.select("left", "right"), work, "name")
        levels.append(work.save(pairs.join(names, ["left", "right"]).select("c", "i", "name")))
    return levels


def _each(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(low, high))


def prefixes(levels: list[DataFrame], turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """(c, d, size, chars, names) of every prefix: d turns of conversation c, the last of which has ``chars`` code points."""
    none = F.lit(None).cast("long")
    parts = turns.select("c", (F.col("i") + 1).alias("d"), "chars", F.lit(None).cast("int").alias("k"), none.alias("name"))
    for k, level in enumerate(levels):
        low = F.shiftleft(F.col("i") + 1, k)
        rows = level.where(F.col("i") % 2 == 0).select("c", "name", low.alias("low"))
        if 1 << k > SPREAD:  # not more than SPREAD lengths in one array
            rows = rows.select("c", "name", F.explode(F.sequence("low", F.col("low") + (1 << k) - 1, F.lit(SPREAD).cast("long"))).alias("low"))
        rows = rows.select("c", "name", _each(F.col("low"), F.col("low") + min(1 << k, SPREAD) - 1).alias("d"))
        parts = parts.unionByName(rows.select("c", "d", none.alias("chars"), F.lit(k).alias("k"), "name"))
    digits = F.sort_array(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "name"))), asc=False)
    found = parts.groupBy("c", "d").agg(F.max("chars").alias("chars"), F.transform(digits, lambda x: x["name"]).alias("names"))
    found = found.where(F.col("chars").isNotNull()).join(sizes, "c").select("c", "d", "size", "chars", "names")
    return found.unionByName(sizes.select("c", F.lit(0).cast("long").alias("d"), "size", F.lit(0).cast("long").alias("chars"), F.array().cast("array<long>").alias("names")))


def _hashed(ends: DataFrame) -> DataFrame:
    """(owner, d, ends_sha256) of (owner, d, c), by reading the sorted ids of each node once."""
    chunk = F.shiftright("c", CHUNK_BITS)
    chunks = ends.groupBy("owner", "d", chunk.alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("c")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, hashlib.sha256()
        for batch in batches:
            owners, depths, found = [], [], []
            for owner, d, ids in zip(*(batch.column(c).to_pylist() for c in ("owner", "d", "ids")), strict=True):
                if (owner, d) == at:
                    digest.update(b"," + ids.encode())
                    continue
                if at is not None:
                    owners.append(at[0]), depths.append(at[1]), found.append(digest.hexdigest())
                at, digest = (owner, d), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pydict({"owner": pa.array(owners, pa.int64()), "d": pa.array(depths, pa.int64()), "ends_sha256": pa.array(found, pa.string())})
        if at is not None:
            yield pa.RecordBatch.from_pydict({"owner": [at[0]], "d": [at[1]], "ends_sha256": [digest.hexdigest()]})

    return chunks.repartition("owner", "d").sortWithinPartitions("owner", "d", "chunk").mapInArrow(run, "owner long, d long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id (its owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    work, result = Scratch(spark), Scratch(spark)
    turns = turns_of(conversations)
    names = named(turns.select("key"), work, "name")
    placed, sizes = rebuilt(turns.join(names, "key").drop("key"))
    placed, sizes = work.save(placed), work.save(sizes)
    longest = sizes.agg(F.max("size")).first()[0] or 0
    members = work.save(prefixes(blocks(placed, longest, work), placed, sizes))

    node = ["d", "names"]
    ends = F.sum((F.col("d") == F.col("size")).cast("long"))
    nodes = members.groupBy(*node).agg(F.min("c").alias("owner"), F.count(F.lit(1)).alias("n_convs"), ends.alias("n_ends"), F.max("chars").alias("chars"))
    saved = (F.col("n_convs") - 1) * F.col("chars")
    nodes = work.save(nodes.select(*node, "owner", "n_convs", saved.alias("saves"), (F.col("n_ends") == F.col("n_convs")).alias("leaf")))
    owners = nodes.groupBy(F.col("owner").alias("c")).agg(F.min("d").alias("f"), F.sum("saves").alias("all_saves"), F.max("leaf").alias("leaf"))

    below = running(nodes.select("owner", "d", "saves"), ("d",), F.col("saves"), F.sum, "upto", by=("owner",))
    own = below.join(owners.select(F.col("c").alias("owner"), "all_saves"), "owner").select("owner", "d", (F.col("all_saves") - F.col("upto") + F.col("saves")).alias("own_saves"))
    seen = members.join(owners, "c", "left")
    child = (F.col("size") > F.col("d")) & (F.col("f") <= F.col("d") + 1)
    others = F.when(F.col("d") < F.col("f"), F.col("all_saves")).otherwise(0)
    sums = seen.groupBy(*node).agg(
        F.min("c").alias("owner"),
        F.sum(F.coalesce(child, F.lit(False)).cast("long")).alias("n_children"),
        F.sum(F.coalesce("leaf", F.lit(False)).cast("long")).alias("n_leaves"),
        F.sum(others).alias("other_saves"),
    )
    marked = seen.where((F.col("d") == F.col("size")) | (F.col("d") == F.col("f") - 1)).select(*node, "c", "size", "f")
    marked = work.save(marked.join(nodes.select(*node, "owner"), node).select("c", "d", "owner", "size", "f"))
    parents = marked.where(F.col("d") == F.col("f") - 1).select(F.col("c").alias("owner"), F.col("f").alias("d"), F.col("owner").alias("above"))
    hashes = _hashed(marked.where(F.col("d") == F.col("size")).select("owner", "d", "c"))

    columns = {"n_convs": "long", "n_children": "long", "n_leaves": "long", "own_saves": "long", "other_saves": "long", "above": "long", "ends_sha256": "string"}
    whole = None
    for part in (nodes, sums, own, parents, hashes):
        rows = part.select("owner", "d", *[(F.col(c) if c in part.columns else F.lit(None).cast(t)).alias(c) for c, t in columns.items()])
        whole = rows if whole is None else whole.unionByName(rows)
    whole = whole.groupBy("owner", "d").agg(*[F.max(c).alias(c) for c in columns])
    found = result.save(
        whole.select(
            F.col("owner").alias("conv_id"),
            F.col("d").alias("depth"),
            F.when(F.col("d") > 0, F.coalesce("above", "owner")).alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            (F.col("own_saves") + F.col("other_saves")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
        )
    )
    work.drop()
    return found
