"""The driver's tables seen as studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from optiloom.functions.ordered import with_position
from optiloom.functions.schema import StudySchema

PART = StudySchema(("p_size", "p_retailprice"), ("revenue", "discount"), ("maximize", "minimize"))
PART_TEXT = StudySchema(("p_size", "p_retailprice", "p_brand"), ("revenue", "discount"), ("maximize", "minimize"))
SUPPLIER = StudySchema(("s_nationkey",), ("balance", "discount", "quantity"), ("maximize", "minimize", "maximize"))
SUPPLIER2 = StudySchema(("s_nationkey",), ("balance", "discount"), ("maximize", "minimize"))
ORDERS = StudySchema((), ("o_totalprice",), ("minimize",))
#: Coordinates of an embedding.
WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Sums over lines per key; money is summed as decimals, so that the order of rows doesn't matter."""
    price = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    return table(spark, sf_dir, "lineitem").groupBy(key).agg(
        F.sum(price).cast("double").alias("revenue"), F.round(F.sum(F.col("l_discount").cast("decimal(18,4)")).cast("double") / F.count(F.lit(1)), 9).alias("discount"), F.sum("l_quantity").alias("quantity")
    )


def part_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("trial_id"), F.col("p_size").cast("double").alias("p_size"), "p_retailprice", "p_brand", "p_type")
    return part.join(_lines(spark, sf_dir, "l_partkey"), F.col("trial_id") == F.col("l_partkey")).drop("l_partkey")


def supplier_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("trial_id"), F.col("s_nationkey").cast("double").alias("s_nationkey"), F.col("s_acctbal").alias("balance"))
    return supplier.join(_lines(spark, sf_dir, "l_suppkey"), F.col("trial_id") == F.col("l_suppkey")).drop("l_suppkey")


def orders_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trial_id"), "o_totalprice")


def events_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One study per event type, trials in order of their ids."""
    props = F.from_json("props", "k int")["k"].cast("double")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("trial_id"), "event_type", F.col("value"), props.alias("k"))


def embedding_columns(spark: SparkSession, sf_dir: str, n: int = WIDTH) -> tuple[DataFrame, list[str]]:
    e = table(spark, sf_dir, "embeddings")
    names = [f"e{i}" for i in range(n)]
    return e.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(names)]), names


def journal_lines(study: DataFrame, schema: StudySchema, keep: str = "trial_id") -> DataFrame:
    """A journal (line_no, value) that records the study: creation, then per trial creation, params, attributes and values."""
    directions = [2 if d == "maximize" else 1 for d in schema.directions]
    head = study.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("line_no"), F.to_json(F.struct(F.lit(0).alias("op_code"), F.lit("study").alias("study_name"), F.array(*[F.lit(d) for d in directions]).alias("directions"))).alias("value")
    )
    w = F.col("__i")
    rows = with_position(study, keep, "__i")
    ops = [F.struct(F.lit(4).alias("op_code"), F.lit(0).alias("study_id"))]
    for p in schema.params:
        dist = F.to_json(F.struct(F.lit("FloatDistribution").alias("name"), F.struct(F.lit(0.0).alias("low"), F.lit(False).alias("log")).alias("attributes")))
        ops.append(F.struct(F.lit(5).alias("op_code"), w.alias("trial_id"), F.lit(p).alias("param_name"), F.col(p).alias("param_value_internal"), dist.alias("distribution")))
    ops.append(F.struct(F.lit(8).alias("op_code"), w.alias("trial_id"), F.struct(F.col(keep).alias("key"), F.lit("x").alias("tag")).alias("user_attr")))
    ops.append(F.struct(F.lit(9).alias("op_code"), w.alias("trial_id"), F.struct(F.array(F.col(schema.objectives[1]) - 0.05, F.lit(-1.0)).alias("constraints")).alias("system_attr")))
    state = F.when(w % 10 == 9, 3).otherwise(1)
    ops.append(F.struct(F.lit(6).alias("op_code"), w.alias("trial_id"), state.alias("state"), F.array(*schema.objectives).alias("values")))
    lines = F.array(*[F.to_json(o) for o in ops])
    body = rows.select(w.alias("__i"), F.posexplode(lines).alias("k", "value")).select((F.col("__i") * len(ops) + F.col("k") + 1).alias("line_no"), "value")
    return head.unionByName(body)


def mixed_journal_lines(study: DataFrame) -> DataFrame:
    """A journal (line_no, value) of the part study in its less plain forms: two studies, metric names, rejected and inline trials, writes before creation, integer, logarithmic and categorical params, distributions as strings, nulls among values."""
    op = lambda code, **fields: F.to_json(F.struct(F.lit(code).alias("op_code"), *[v.alias(k) for k, v in fields.items()]))
    named = lambda *pairs: F.struct(*[v.alias(k) for k, v in pairs])
    texts = lambda *values: F.array(*[F.lit(v) for v in values])
    i = F.col("__i")
    whole = F.to_json(named(("name", F.lit("IntDistribution")), ("low", F.lit(1)), ("step", F.lit(2))))
    log = named(("name", F.lit("FloatDistribution")), ("attributes", named(("log", F.lit(True)))))
    choice = F.to_json(named(("name", F.lit("CategoricalDistribution")), ("attributes", named(("choices", texts("a", "b", "c"))))))
    inline = op(
        4,
        study_id=F.lit(1),
        distributions=named(("c", named(("name", F.lit("CategoricalDistribution")), ("choices", texts("A", "B"))))),
        params=named(("c", F.when(i % 8 == 1, "B").otherwise("A")), ("w", F.lit(2.5))),
        state=F.lit(0),
    )
    trial = i.cast("long")
    lines = [
        op(8, trial_id=trial + 1, user_attr=named(("early", F.lit(1)))),
        F.when(i % 4 == 1, inline).otherwise(op(4, study_id=F.lit(1))),
        op(4, study_id=F.lit(9)),
        op(5, trial_id=trial, param_name=F.lit("n"), param_value_internal=F.col("p_size"), distribution=whole),
        op(5, trial_id=trial, param_name=F.lit("price"), param_value_internal=F.log("p_retailprice"), distribution=log),
        op(5, trial_id=trial, param_name=F.lit("brand"), param_value_internal=(i % 4).cast("double") + 0.2, distribution=choice),
        op(6, trial_id=trial, state=F.lit(1), values=F.array(F.col("discount"), F.lit(None).cast("double"), F.col("revenue"))),
    ]
    head = study.sparkSession.createDataFrame(
        [
            (0, '{"op_code": 0, "study_name": "empty", "directions": [1]}'),
            (1, '{"op_code": 3, "study_id": 1, "system_attr": {"study:metric_names": ["too", "early"]}}'),
            (2, '{"op_code": 0, "study_name": "mixed", "directions": [1, 2]}'),
            (3, '{"op_code": 3, "study_id": 1, "system_attr": {"study:metric_names": ["disc", "rev"]}}'),
            (4, "{broken"),
        ],
        "line_no long, value string",
    )
    rows = with_position(study, "trial_id", "__i").select("__i", F.posexplode(F.array(*lines)).alias("k", "value"))
    return head.unionByName(rows.select((F.col("__i") * len(lines) + F.col("k") + 5).alias("line_no"), "value"))
