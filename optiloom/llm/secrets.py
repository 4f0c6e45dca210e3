"""Secret scanning with an incremental, content-addressed ledger.

Every version of every file is addressed by the SHA-256 of its text. A ledger
holds one row per (blob, rule version) that has been scanned, with the spans
found; a run scans only pairs the ledger lacks, each distinct blob once however
many paths hold it, and joins the spans back to all paths.

Blobs are represented by one (path, blob) pair chosen before any text moves, so
a blob with very many copies costs one hash row per copy and one scan.

Edge cases: a null text is the empty blob; null paths are kept (null-safe
joins); repeated rows come back once each; of spans that start together the one
of the earlier rule comes first; a text of very many spans takes time that grows
with their square; an empty table has no findings; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optiloom.functions.storage import saved
from optiloom.llm.native import EMPTY_SHA256, let

#: Kind, pattern, group whose length is tested, least length. The order breaks ties between equal starts.
RULES = (
    ("assign", "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]{16,}", 0, 16),  # runs are maximal, so a least length in the pattern drops exactly the failing matches
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 0, 36),
)
BASE_KINDS = ("assign", "access", "hex")
#: Rises with any change to RULES, so that ledgers of older rules are scanned anew.
RULES_VERSION = 1
SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def _spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of one kind in code points: match lengths and the lengths of the pieces between them give the offsets."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
    tested = sizes if group == 0 else F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x))

    def walk(all_: Column) -> Column:
        step = lambda acc, k: F.struct(
            (acc["at"] + F.get(all_["g"], k) + F.get(all_["s"], k)).alias("at"),
            F.when(
                F.get(all_["t"], k) >= least,
                F.concat(acc["out"], F.array(F.struct((acc["at"] + F.get(all_["g"], k)).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (acc["at"] + F.get(all_["g"], k) + F.get(all_["s"], k)).alias("end")))),
            ).otherwise(acc["out"]).alias("out"),
        )
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(all_["s"]) - 1), zero, step, lambda acc: acc["out"])

    found = let(F.struct(gaps.alias("g"), sizes.alias("s"), tested.alias("t")), walk)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def scan(blobs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``spans``: the spans of all rules in ``text`` by start, then rule order."""
    one = [_spans(F.col(text), i, *rule) for i, rule in enumerate(RULES)]
    return blobs.withColumn("spans", F.sort_array(F.concat(*one)))


def _addressed(versions: DataFrame, path: str, text: str) -> DataFrame:
    held = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return held.withColumn("blob", F.sha2("text", 256))


def _known(ledger: DataFrame) -> DataFrame:
    """blob and spans under the present rules, once for each blob however often the ledger holds it."""
    return ledger.where(F.col("rules_version") == RULES_VERSION).select("blob", "spans").dropDuplicates(["blob"])


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, path: str = "path", text: str = "text") -> DataFrame:
    """Rows to append to the ledger (blob, rules_version, spans): those of blobs that it lacks under the present rules."""
    held = _addressed(versions, path, text)
    unseen = held.groupBy("blob").agg(F.min(F.struct("path")).alias("first"))
    if ledger is not None:
        unseen = unseen.join(_known(ledger).select("blob"), "blob", "left_anti")
    chosen = unseen.select(F.col("blob").alias("__blob"), F.col("first.path").alias("__path"))
    texts = held.join(chosen, (F.col("blob") == F.col("__blob")) & F.col("path").eqNullSafe(F.col("__path")), "left_semi")
    scanned = scan(texts).select("blob", "spans")
    return scanned.groupBy("blob").agg(F.lit(RULES_VERSION).alias("rules_version"), F.first("spans").alias("spans"))


def findings(versions: DataFrame, ledger: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, blob and spans of every version, as the ledger has them."""
    spans = _known(ledger).where(F.size("spans") > 0)
    found = _addressed(versions, path, text).select("path", "blob").join(spans, "blob", "left")
    return found.select("path", "blob", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, path: str = "path", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, news): spans per version, and the ledger rows to append, which are written once to the shared folder.

    ``ledger`` has earlier news; pairs of blob and rules version in it are not scanned again.
    """
    news = saved(scan_unseen(versions, ledger, path, text))
    return findings(versions, news if ledger is None else news.unionByName(ledger), path, text), news


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(documents: DataFrame) -> DataFrame:
    """The per-document digest of :func:`scan_versions`."""
    found, _ = scan_versions(documents, None, "doc_id", "text")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("path").alias("doc_id"),
        *[count(k) for k in BASE_KINDS],
        F.when(F.size("spans") == 0, F.lit(EMPTY_SHA256)).otherwise(F.sha2(_joined(base), 256)).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
