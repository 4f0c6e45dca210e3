"""Near-duplicate lines by an exact set-similarity join, in DataFrame operations only.

A line goes when an earlier line (of smaller id, or higher up in the same text)
has a token set of Jaccard similarity ``THRESHOLD`` or more. Lines are judged on
the input, so a removed line still counts as an earlier line. Lines without a
word always stay.

1. Tokens are counted in a table of fixed size (``BUCKETS``), which orders them
   by rarity; ties are broken by hash.
2. Lines of equal token sets are reduced to the first of them, with partial
   minima before the shuffle, so that a very common line is no hot key.
3. Every first line files its rarest tokens, its prefix: two similar lines share
   a token of their prefixes. They are candidates if their sizes and the places
   of the first such token allow the overlap, and if a parity signature of all
   tokens (which bounds the overlap from above) does.
4. Groups of near copies are settled in linear work before any pairs are made:
   under the prefix tokens of least and of greatest hash each line is held
   against the first and a few previous lines of like size (``BACK``), and the
   closest of these (``PICKS``) are verified.
5. Lines that are not settled meet all lines that share a prefix token.
6. Candidates are verified on all their words, by 64-bit hashes.

What is kept are the first lines without an earlier match.

Edge cases: null texts have no lines with words and come back null; ids are
integers, a null id sorts before all others; rows that repeat an id are ordered
by a hash of their text and judged each on its own, but equal rows count as one
text; empty tables give empty results; very long lines are one row like others;
other columns pass through :func:`clean`, whose own column names start with
``__line_`` and may not occur in the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from optiloom.functions.storage import Scratch, saved
from optiloom.llm.native import is_blank, let, pieces_of, words

THRESHOLD = 0.8
#: Counters of the rarity table: its size doesn't grow with the corpus.
BUCKETS = 1 << 18
#: The closest of these lines, as many as are verified.
PICKS = 3
#: Which of the lines before it, by distance in the order of ids, a line is held against there, beside the first.
BACK = (1, 2, 4, 8, 16, 32)
#: Tokens from which on a line has a second signature.
LONG = 88
#: Candidate pairs up to which their ids are broadcast to the documents; more are joined by shuffling.
FEW = 500_000
_NO_ID = -(1 << 63)
_LOW56 = (1 << 56) - 1
_KEY = ["id", "at"]
#: Taken from the place of a settled line's token; a text of 2 GB has no place as large.
_SETTLED = 1 << 26


def rarity(docs: DataFrame, text: str) -> Column:
    """A constant array: for each bucket of tokens a level that rises with the number of its occurrences.

    The counts are made over all documents; what reaches the driver is one
    small number for each of ``BUCKETS`` buckets.
    """
    tokens = docs.select(F.explode(pieces_of(F.col(text))).alias("w")).where(F.col("w") != "")
    counts = tokens.groupBy(_bucket(F.col("w")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    levels = ["0"] * BUCKETS
    for r in counts.select("b", F.least(F.floor(F.log2(F.col("n").cast("double")) * 4), F.lit(126)).alias("l")).collect():
        levels[r.b] = str(r.l)
    return F.split(F.lit(",".join(levels)), ",").cast("array<bigint>")


def _bucket(w: Column) -> Column:
    return F.hash(w).bitwiseAND(F.lit(BUCKETS - 1))


def _keys(line: Column, levels: Column) -> Column:
    """Distinct tokens as longs, rarest first: seven bits of level over 56 bits of hash."""
    level = lambda w: F.shiftleft(F.coalesce(levels[_bucket(w)], F.lit(0).cast("long")), 56)  # noqa: E731  never null, so that the array is sorted as plain longs
    keyed = F.transform(words(line, line=True), lambda w: level(w).bitwiseOR(F.xxhash64(w).bitwiseAND(F.lit(_LOW56))))  # hashing twice costs less than a second array
    return F.sort_array(F.array_distinct(keyed))


def _parity(keys: Column, half: bool) -> Column:
    """64 parities of the tokens by hash, of all of them or of the half with a certain hash bit.

    Two sets with overlap o of sizes a and b differ in at most a + b - 2 o tokens,
    so in no more parities over both halves.
    """
    place = lambda k: k.bitwiseAND(F.lit(63)).cast("int")
    bit = (lambda k: F.shiftright(k, 20).bitwiseAND(F.lit(1).cast("long"))) if half else (lambda k: F.lit(1).cast("long"))
    return F.aggregate(keys, F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(F.call_function("shiftleft", bit(k), place(k))))


def _lines(docs: DataFrame) -> DataFrame:
    """id, at (hash of the text where ids repeat, over the line's number) and s of every line with a word."""
    parts = docs.select("id", "own", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    return parts.where(~is_blank(F.col("s"))).select("id", F.shiftleft(F.col("own").cast("long"), 32).bitwiseOR(F.col("line").cast("long")).alias("at"), "s")


def _sets(docs: DataFrame, levels: Column) -> DataFrame:
    """The first line of every token set: id, at, n (size), sig, sig2, and the prefix, rarest first.

    Sets below four tokens match equal ones only, so they file nothing; short sets need no second signature.
    """
    keyed = _lines(docs).select("id", "at", _keys(F.col("s"), levels).alias("keys"))
    n = F.size("keys")
    least = F.floor((4 * n + 4) / F.lit(5)).cast("int")  # ceil(0.8 n) in integers
    prefix = F.transform(F.slice("keys", 1, F.when(n < 4, 0).otherwise(n - least + 1)), lambda k: F.hash(k))
    line = F.struct("id", "at", n.alias("n"), _parity(F.col("keys"), False).alias("sig"), F.when(n > LONG, _parity(F.col("keys"), True)).alias("sig2"), prefix.alias("prefix"))
    return keyed.groupBy(F.xxhash64("keys").alias("d1"), F.hash("keys").alias("d2"), n.alias("n")).agg(F.min(line).alias("x")).select("x.*")


def _differ(a: str, b: str) -> Column:
    """Tokens in which the two sets differ at least."""
    c = lambda side, name: F.col(f"{side}.{name}")
    whole = c(a, "sig").bitwiseXOR(c(b, "sig"))
    half = F.coalesce(c(a, "sig2").bitwiseXOR(c(b, "sig2")), F.lit(0).cast("long"))
    return F.bit_count(half) + F.bit_count(whole.bitwiseXOR(half))


def _alike(a: str, b: str) -> Column:
    """Whether sizes and signatures allow an overlap of 4/9 of both sizes, so a difference of 1/9."""
    n = lambda side: F.col(f"{side}.n")
    return (5 * F.least(n(a), n(b)) >= 4 * F.greatest(n(a), n(b))) & (9 * _differ(a, b) <= n(a) + n(b))


def _later(a: str, b: str) -> Column:
    return (F.col(f"{a}.id") > F.col(f"{b}.id")) | ((F.col(f"{a}.id") == F.col(f"{b}.id")) & (F.col(f"{a}.at") > F.col(f"{b}.at")))


def _probes(prefix: Column) -> Column:
    """The prefix tokens of least and of greatest hash: near copies have one of them in common as a rule."""
    return F.array_distinct(F.array(F.array_min(prefix), F.array_max(prefix)))


def _closest(firsts: DataFrame) -> DataFrame:
    """id, at, id2, at2: for each line the closest few of the first and some previous lines under two of its prefix tokens."""
    filed = firsts.where(F.size("prefix") > 0).select(*_KEY, "n", "sig", "sig2", F.explode(_probes(F.col("prefix"))).alias("token"))
    row = F.struct(*_KEY, "n", "sig", "sig2")
    order = Window.partitionBy("token", F.floor(F.log(1.25, "n"))).orderBy(*_KEY)  # lines of like size, those of smaller id before
    met = filed.select(row.alias("a"), F.array(F.first(row).over(order.rowsBetween(Window.unboundedPreceding, 0)), *[F.lag(row, k).over(order) for k in BACK]).alias("bs"))
    some = met.select("a", F.explode("bs").alias("b")).where(F.col("b").isNotNull() & _later("a", "b") & _alike("a", "b"))
    near = some.select("a.id", "a.at", F.col("b.id").alias("id2"), F.col("b.at").alias("at2"), _differ("a", "b").alias("d")).distinct()
    place = F.row_number().over(Window.partitionBy(*_KEY).orderBy("d", "id2", "at2"))
    return near.withColumn("place", place).where(F.col("place") <= PICKS).select(*_KEY, "id2", "at2")


def _place(k: Column) -> Column:
    return k.bitwiseAND(F.lit(_SETTLED - 1))


def _seeking(filed: DataFrame) -> DataFrame:
    """The filings under which a line may meet larger ones: those with at most n / 9 tokens before.

    A plain filter would be moved before the exchange, which both sides then could not share.
    """
    return filed.withColumn("k", F.explode(F.when(9 * _place(F.col("k")) <= F.col("n"), F.array("k"))))


def _met(firsts: DataFrame, settled: DataFrame) -> DataFrame:
    """id, at, id2, at2: lines that are not settled with the earlier lines under any of their prefix tokens.

    At the first token that two similar lines share, ``a``, the smaller one (of equal sizes the earlier),
    has at most n / 9 tokens before it, and what is left of both has room for the overlap. Where both
    lines have the same token before, they have met under that one, where there is as much room or more.
    So near copies, whose prefixes share long runs of tokens, meet once for each run.
    Only filings with at most n / 9 tokens before seek others, which is settled after the exchange:
    both sides of the join read the same columns of all filings, so that these are shuffled once.
    """
    held = firsts.join(settled.withColumn("gone", F.lit(True)), _KEY, "left")
    filed = held.select(*_KEY, "sig", "sig2", "n", "gone", "prefix", F.posexplode("prefix").alias("k", "token"))
    filed = filed.withColumn("before", F.get("prefix", F.col("k") - 1)).drop("prefix")
    filed = filed.withColumn("k", F.when(F.col("gone"), F.col("k") - _SETTLED).otherwise(F.col("k"))).drop("gone").repartition("token")
    c = lambda side, name: F.col(f"{side}.{name}")
    left = lambda side: c(side, "n") - _place(c(side, "k"))
    swap = _later("a", "b")
    smaller = (c("a", "n") < c("b", "n")) | ((c("a", "n") == c("b", "n")) & _later("b", "a"))
    room = 9 * F.least(left("a"), left("b")) >= 4 * (c("a", "n") + c("b", "n"))
    met = F.coalesce(c("a", "before") == c("b", "before"), F.lit(False))
    pairs = _seeking(filed).alias("a").join(filed.alias("b"), (c("a", "token") == c("b", "token")) & smaller & room & _alike("a", "b") & ~met & (F.when(swap, c("a", "k")).otherwise(c("b", "k")) >= 0))
    late, early = ([F.when(swap, c(x, name)).otherwise(c(y, name)).alias(f"{name}{end}") for name in _KEY] for x, y, end in (("a", "b", ""), ("b", "a", "2")))
    return pairs.select(*late, *early)


def _candidates(firsts: DataFrame, settled: DataFrame) -> DataFrame:
    """The pairs of :func:`_met`, each once."""
    return _met(firsts, settled).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, work: Scratch) -> DataFrame:
    """(id, at) of saved pairs whose token sets reach the threshold; the documents are read once."""
    other = pairs.select(F.col("id2").alias("id"), F.col("at2").alias("at"))
    wanted = pairs.select(*_KEY).unionByName(other).groupBy("id").agg(F.collect_set("at").alias("wanted"))
    few = pairs.count() <= FEW
    held = docs.join(F.broadcast(wanted) if few else wanted, "id")
    lines = let(F.split("text", "\n"), lambda ls: F.transform("wanted", lambda at: F.struct(at.alias("at"), F.get(ls, _line_number(at)).alias("s"))))
    found = held.select("id", "own", F.explode(lines).alias("x")).select("id", "own", "x.*")  # the lines alone, not a copy of the text for each
    tokens = found.where(F.shiftright("at", 32) == F.col("own")).select(*_KEY, F.array_distinct(F.transform(words(F.col("s"), line=True), lambda w: F.xxhash64(w))).alias("t"))
    sets = work.save(tokens).groupBy(*_KEY).agg(F.first("t").alias("t"))
    both = pairs.join(sets.withColumnRenamed("t", "t1"), _KEY).join(sets.select(F.col("id").alias("id2"), F.col("at").alias("at2"), F.col("t").alias("t2")), ["id2", "at2"])
    return both.where(9 * F.size(F.array_intersect("t1", "t2")) >= 4 * (F.size("t1") + F.size("t2"))).select(*_KEY).distinct()


def _line_number(at: Column) -> Column:
    return at.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def _base(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, text, and own: 0, or where any id repeats a hash of the text that tells the rows of an id apart."""
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    repeats = base.groupBy("id").count().where("count > 1").limit(1).count() > 0
    return base.withColumn("own", F.hash("text") if repeats else F.lit(0))


def _kept(base: DataFrame) -> DataFrame:
    """(id, at) of the lines with words that stay, each once; saved."""
    work = Scratch(base.sparkSession)
    firsts = work.save(_sets(base, rarity(base, "text")))
    near = work.save(_verified(work.save(_closest(firsts)), base, work))
    late = work.save(_verified(work.save(_candidates(firsts, near)), base, work))
    kept = saved(firsts.select(*_KEY).join(near.unionByName(late), _KEY, "left_anti"))
    work.drop()
    return kept


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, line): numbers from 0 of the lines to remove, of each distinct row once; a null id is ``_NO_ID``."""
    base = _base(docs, id_col, text)
    gone = _lines(base).select(*_KEY).distinct().join(_kept(base), _KEY, "left_anti")
    return gone.select("id", _line_number(F.col("at")).alias("line"))


def _applied(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``docs`` with __line_n (lines), __line_gone (lines removed) and __line_left (the text that is left)."""
    base = _base(docs, id_col, text)
    kept = _kept(base)
    stay = kept.groupBy(F.col("id").alias("__line_id"), F.shiftright("at", 32).cast("int").alias("__line_own")).agg(F.sort_array(F.collect_list(_line_number(F.col("at")))).alias("__line_stay"))
    own = F.hash(F.coalesce(F.col(text), F.lit(""))) if kept.where(F.shiftright("at", 32) != 0).limit(1).count() else F.lit(0)
    keyed = docs.withColumns({"__line_key": F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), "__line_hash": own})
    joined = keyed.join(stay.hint("shuffle_hash"), (F.col("__line_key") == F.col("__line_id")) & (F.col("__line_hash") == F.col("__line_own")), "left")
    lines = F.split(F.col(text), "\n")
    stay = F.coalesce("__line_stay", F.array().cast("array<int>"))
    blank = lambda ls: F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: is_blank(F.get(ls, i)))
    left = let(lines, lambda ls: F.transform(F.array_sort(F.concat(stay, blank(ls))), lambda i: F.get(ls, i)))  # numbers of lines that stay, then the lines
    left = F.when(F.col(text).isNotNull(), left)
    n = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))
    out = joined.withColumn("__line_n", n).withColumn("__line_rest", left)
    return out.withColumns({"__line_gone": F.col("__line_n") - F.coalesce(F.size("__line_rest"), F.lit(0)), "__line_left": F.when(F.col(text).isNotNull(), F.concat_ws("\n", "__line_rest"))})


def clean(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` without the removed lines; same columns and rows."""
    if clash := [c for c in docs.columns if c.lower().startswith("__line_")]:
        raise ValueError(f"columns {clash} clash with this operator's own")
    out = _applied(docs, id_col, text).withColumn(text, F.col("__line_left"))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return out.select(*docs.columns)


def digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of the text that is left."""
    out = _applied(documents.select("doc_id", "text"), "doc_id", "text")
    return out.select("doc_id", F.col("__line_n").cast("long").alias("n_lines"), F.col("__line_gone").cast("long").alias("n_removed"), F.sha2(F.coalesce("__line_left", F.lit("")), 256).alias("text_sha256"))
