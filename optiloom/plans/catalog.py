"""The engine's own registered queries (name to callable) over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optiloom.functions import schema as roles
from optiloom.functions.storage import Scratch, shared_folder
from optiloom.operators import cluster, export, filters, history, mcdm, pareto, pdp, sensitivity
from optiloom.plans import oracles
from optiloom.plans import studies as st
from optiloom.sources.journal import parse_journal
from optiloom.streaming.live import completed_trials

Q: dict = {}


def query(f):
    Q[f.__name__] = f
    return f


def _round(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query
def range_filter(spark, d):
    return filters.range_filter(st.part_study(spark, d), {"p_size": (10, 30), "p_retailprice": (950.0, 1500.0)}).select("trial_id", "p_size", "p_retailprice")


@query
def open_range_filter(spark, d):
    return filters.range_filter(st.part_study(spark, d), '{"quantity": {"min": 800}, "discount": {"max": 0.05}}').select("trial_id", "quantity", "discount")


@query
def unknown_column_filter(spark, d):
    return filters.range_filter(st.part_study(spark, d), {"p_brand": (0, 1)}).select("trial_id")


@query
def decimal_range_filter(spark, d):
    rows = st.part_study(spark, d).withColumn("price", F.col("p_retailprice").cast("decimal(12,2)"))
    return filters.range_filter(rows, '{"price": {"min": 950.5, "max": 1500}, "revenue": {"min": "any"}, "discount": 7}').select("trial_id", F.col("price").cast("double").alias("price"))


@query
def row_positions(spark, d):
    return filters.indexed(st.part_study(spark, d), st.PART).select("trial_id", "row_idx")


@query
def trials_batch(spark, d):
    rows = filters.indexed(st.part_study(spark, d), st.PART)
    return filters.trials_batch(rows, [5, 3, 10**9, 0, 7]).select("ordinal", "row_idx", "trial_id")


@query
def all_trials(spark, d):
    rows = filters.all_trials(st.part_study(spark, d), st.PART_TEXT)
    return rows.select("trial_id", F.element_at("params", F.lit("p_size")).alias("p_size"), F.element_at("params", F.lit("p_brand")).alias("p_brand"), F.get("values", F.lit(0)).alias("v0"))


@query
def point_positions(spark, d):
    return filters.point_positions(filters.indexed(st.supplier_study(spark, d), st.SUPPLIER), st.SUPPLIER).select("trial_id", "x", "y", "z")


@query
def single_positions(spark, d):
    rows = filters.point_positions(filters.indexed(st.orders_study(spark, d), st.ORDERS), st.ORDERS)
    return _round(rows, 9, "x")


@query
def axis_extents(spark, d):
    return filters.axis_extents(st.part_study(spark, d), ["p_size", "p_retailprice", "revenue"], pad=True)


@query
def slice_points(spark, d):
    return filters.selected_points(st.part_study(spark, d), ["p_size", "revenue"], F.col("p_size") > 25)


@query
def contour_points(spark, d):
    return filters.selected_points(st.part_study(spark, d), ["p_size", "p_retailprice", "revenue"], F.col("revenue") > 100000)


@query
def scatter_color(spark, d):
    return _round(filters.scatter_color(st.part_study(spark, d), st.PART), 6, "color")


@query
def detail_table(spark, d):
    return filters.detail_table(st.part_study(spark, d), roles.StudySchema(("p_size", "p_brand"), ("revenue",)))


@query
def colormap(spark, d):
    shade = filters.color_at(F.col("p_size") / 64, ["#000000", "#ffffff"])
    return st.part_study(spark, d).select("trial_id", shade.alias("shade"))


@query
def scatter_cells(spark, d):
    return spark.createDataFrame(filters.scatter_cells(st.PART), "x string, y string")


@query
def objective_pairs(spark, d):
    return spark.createDataFrame(filters.objective_pairs(st.SUPPLIER), "x string, y string")


@query
def report_stats(spark, d):
    return _round(export.report_stats(st.part_study(spark, d), ["p_size", "p_retailprice", "revenue", "quantity"]), 4, "min", "max", "mean", "std")


@query
def csv_rows(spark, d):
    return export.csv_lines(st.part_study(spark, d), ["trial_id", "p_size", "p_retailprice", "p_brand", "missing"], "trial_id")


@query
def best_so_far(spark, d):
    return history.best_so_far(st.orders_study(spark, d), "trial_id", "o_totalprice")


@query
def best_so_far_by_type(spark, d):
    return history.best_so_far(st.events_study(spark, d), "trial_id", "value", False, ("event_type",)).select("event_type", "trial_id", "best")


@query
def moving_avg5(spark, d):
    return _round(history.moving_average(st.events_study(spark, d), "trial_id", "value", ("event_type",)), 6, "moving_avg").select("event_type", "trial_id", "moving_avg")


@query
def improvement_rate(spark, d):
    return _round(history.improvement(st.events_study(spark, d), "trial_id", "value", ("event_type",)), 6, "improvement").select("event_type", "trial_id", "best", "improvement")


@query
def phase_counts(spark, d):
    return history.with_phase(st.orders_study(spark, d), "trial_id").groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


@query
def best_trials(spark, d):
    return history.record_trials(st.events_study(spark, d), "trial_id", "value", ("event_type",)).select("event_type", "trial_id", "value")


@query
def convergence(spark, d):
    return _round(history.convergence(st.events_study(spark, d), "trial_id", "value", ("event_type",)), 9, "rate")


@query
def edf(spark, d):
    return _round(history.edf(st.orders_study(spark, d), "o_totalprice", "trial_id"), 9, "y").select("trial_id", "o_totalprice", "y")


@query
def pareto_front(spark, d):
    return pareto.front(st.part_study(spark, d), st.PART).select("trial_id")


@query
def nd_ranks(spark, d):
    return pareto.ranks(st.supplier_study(spark, d), st.SUPPLIER).select("trial_id", "rank")


@query
def nd_ranks_2d(spark, d):
    return pareto.ranks(st.supplier_study(spark, d), st.SUPPLIER2).select("trial_id", "rank")


@query
def hv_2d(spark, d):
    return _round(pareto.hypervolume(st.part_study(spark, d), st.PART), 3, "hv")


@query
def hv_history(spark, d):
    return _round(pareto.hypervolume_history(st.supplier_study(spark, d), st.SUPPLIER2), 4, "hv")


@query
def hv_3d(spark, d):
    return _round(pareto.hypervolume(st.supplier_study(spark, d), st.SUPPLIER), 4, "hv")


@query
def hv_history_3d(spark, d):
    return _round(pareto.hypervolume_history(st.supplier_study(spark, d), st.SUPPLIER), 4, "hv")


@query
def chebyshev_rank(spark, d):
    found = _round(mcdm.chebyshev(st.part_study(spark, d), st.PART, [0.4, 0.6]), 6, "score")
    return mcdm.top(found, 50, "trial_id", ascending=True).select("trial_id", "score")


@query
def topsis_rank(spark, d):
    return _round(mcdm.topsis(st.part_study(spark, d), st.PART, [0.5, 0.5]), 8, "score").select("trial_id", "score")


@query
def topsis_top10(spark, d):
    found = _round(mcdm.topsis(st.supplier_study(spark, d), st.SUPPLIER, mcdm.normalized_weights(None, 3)), 8, "score")
    return mcdm.top(found, 10, "trial_id").select("trial_id", "score")


@query
def dominance_ratio(spark, d):
    rows = st.part_study(spark, d)
    return pareto.dominance_ratio(rows.where(F.col("p_size") <= 25), rows.where(F.col("p_size") > 25), st.PART)


@query
def spearman_matrix(spark, d):
    return _round(sensitivity.spearman_matrix(st.part_study(spark, d), st.PART_TEXT), 6, "rho")


@query
def ridge_two_param(spark, d):
    return _round(sensitivity.ridge_table(st.part_study(spark, d), st.PART), 4, "beta", "r2")


@query
def sensitivity_selected(spark, d):
    rows = st.part_study(spark, d)
    return _round(sensitivity.sensitivity(rows, st.PART, rows.where(F.col("p_size") > 20)), 4, "rho", "beta", "r2").select("param", "objective", "rho", "beta", "r2")


@query
def importance(spark, d):
    return _round(sensitivity.importance(sensitivity.spearman_matrix(st.part_study(spark, d), st.PART_TEXT), "rho"), 6, "importance")


@query
def heatmap_threshold(spark, d):
    return _round(sensitivity.thresholded(sensitivity.spearman_matrix(st.part_study(spark, d), st.PART_TEXT), "rho", 0.02), 6, "rho")


@query
def label_encode(spark, d):
    return sensitivity.label_encode(st.part_study(spark, d), "p_brand", "trial_id", "code").select("trial_id", "code")


@query
def cluster_stats(spark, d):
    rows, names = st.embedding_columns(spark, d)
    return _round(cluster.cluster_stats(rows, "label", names), 6, "mean", "std")


@query
def pdp_1d_ridge(spark, d):
    return _round(pdp.pdp_1d(st.part_study(spark, d), st.PART, "p_size", "revenue", 20), 3, "x", "y").select("x", "y")


@query
def pdp_2d_ridge(spark, d):
    return _round(pdp.surface(st.part_study(spark, d), st.PART, "p_size", "p_retailprice", "revenue", 15), 3, "x", "y", "z").select("x", "y", "z")


@query
def constraint_feasibility(spark, d):
    rows = st.part_study(spark, d).withColumn("constraints", F.array(F.round(F.col("discount") - 0.05, 9), F.round(F.lit(0.01) - F.col("discount"), 9)))
    return _round(roles.with_feasibility(rows), 6, "constraint_sum").select("trial_id", "is_feasible", "constraint_sum")


@query
def selection_rows(spark, d):
    rows = filters.indexed(st.part_study(spark, d), st.PART)
    ranged = filters.Selection().with_range("p_size", 10, 20).with_range("revenue", None, 0)
    parts = {"ranged": ranged.without_range("revenue"), "none": ranged, "brushed": ranged.brush([1, 5, 10**9]), "narrowed": ranged.brush([1]).with_range("revenue", 50000, 90000)}
    out = None
    for name, chosen in parts.items():
        part = chosen.apply(rows).select(F.lit(name).alias("selection"), "trial_id")
        out = part if out is None else out.unionByName(part)
    return out


@query
def single_trial(spark, d):
    row = filters.trial_at(filters.indexed(st.part_study(spark, d), st.PART), 7, schema=st.PART)
    return row.select("trial_id", F.element_at("params", F.lit("p_size")).alias("p_size"), F.get("values", F.lit(0)).alias("v0"), F.get("values", F.lit(1)).alias("v1"))


@query
def effective_ranges(spark, d):
    """Sliders at the ends of their column are no filter; what the others leave."""
    rows = st.part_study(spark, d)
    ends = rows.agg(F.min("p_size").alias("low"), F.max("p_size").alias("high")).first()
    kept = filters.effective_ranges(rows, {"p_size": (ends.low, ends.high), "p_retailprice": (930.0, 975.5), "discount": (-1.0, 2.0)})
    return filters.range_filter(rows, kept).select("trial_id", F.lit(",".join(sorted(kept))).alias("axes"))


@query
def front_line(spark, d):
    found = pareto.front_line(st.part_study(spark, d), st.PART)
    return history.with_place(found, "revenue", "place", "trial_id").select("trial_id", "place", "revenue")


def _with_gaps(spark, d):
    """The part study without a revenue (NaN) where p_size is 7."""
    return st.part_study(spark, d).withColumn("revenue", F.when(F.col("p_size") == 7, float("nan")).otherwise(F.col("revenue")))


@query
def drawn_front(spark, d):
    return pareto.drawn_as_front(_with_gaps(spark, d), st.PART).select("trial_id")


@query
def ranks_with_gaps(spark, d):
    rows = st.supplier_study(spark, d).withColumn("discount", F.when(F.col("s_nationkey") % 5 == 0, float("nan")).otherwise(F.col("discount")))
    ranked, best, volume = pareto.ranks_and_volume(rows, st.SUPPLIER2)
    marked = ranked.join(best.withColumn("front", F.lit(True)), "trial_id", "left")
    return _round(marked.select("trial_id", "rank", F.coalesce("front", F.lit(False)).alias("front"), F.lit(volume).alias("hv")), 4, "hv")


@query
def edf_objectives(spark, d):
    return _round(history.edf_of(st.part_study(spark, d), st.PART), 9, "y").select("objective", "trial_id", "value", "y")


@query
def csv_quoted(spark, d):
    rows = st.part_study(spark, d).withColumn("note", F.concat(F.col("p_brand"), F.when(F.col("p_size") > 25, ', "large"').otherwise("")))
    return export.csv_lines(rows, ["note", "discount"], "trial_id")


@query
def compared_studies(spark, d):
    """Dominance of the small parts against those of each of two types, and a study that cannot be compared."""
    rows = st.part_study(spark, d)
    others = {t: (rows.where(F.col("p_type") == t), st.PART.directions) for t in ("ECONOMY", "PROMO")} | {"other way": (rows, ("minimize", "minimize"))}
    out = None
    for name, (message, ratio) in pareto.comparisons(rows.where(F.col("p_size") <= 25), st.PART, others).items():
        part = spark.range(1).select(F.lit(name).alias("study"), F.lit(message).alias("message"), *[F.lit(None).cast("int").alias(c) for c in ("main_pct", "other_pct")]) if ratio is None else ratio.select(F.lit(name).alias("study"), F.lit(None).cast("string").alias("message"), "main_pct", "other_pct")
        out = part if out is None else out.unionByName(part)
    return out


@query
def journal_studies(spark, d):
    found = parse_journal(st.journal_lines(st.part_study(spark, d), st.PART)).studies
    return found.select("study_id", "name", F.array_join("directions", ",").alias("directions"), "completed_trials", "total_trials", F.array_join("param_names", ",").alias("params"), F.array_join("objective_names", ",").alias("objectives"), F.array_join("user_attr_names", ",").alias("attrs"), "has_constraints")


@query
def journal_trials(spark, d):
    rows = parse_journal(st.journal_lines(st.part_study(spark, d), st.PART)).trials
    rows = roles.with_feasibility(rows)
    return rows.select("trial_id", F.element_at("params", F.lit("p_size")).alias("p_size"), F.get("objectives", F.lit(0)).alias("revenue"), F.element_at("attrs_num", F.lit("key")).cast("long").alias("key"), F.element_at("attrs_str", F.lit("tag")).alias("tag"), "is_feasible")


@query
def journal_study_table(spark, d):
    found = parse_journal(st.journal_lines(st.part_study(spark, d), st.PART))
    return found.select(0).select("row_idx", "trial_id", "p_size", "obj0", "c2", "is_feasible")


@query
def journal_mixed(spark, d):
    rows = parse_journal(st.mixed_journal_lines(st.part_study(spark, d))).trials
    param, label = (lambda n: F.try_element_at("params", F.lit(n))), (lambda n: F.try_element_at("param_labels", F.lit(n)))
    found = rows.select("trial_id", "study_id", *[param(n).alias(n) for n in ("n", "price", "brand", "w")], param("c").alias("c_index"), label("brand").alias("brand_label"), label("c").alias("c_label"))
    found = found.join(rows.select("trial_id", F.get("objectives", F.lit(0)).alias("disc"), F.get("objectives", F.lit(1)).alias("rev"), F.size("attrs_num").alias("n_attrs")), "trial_id")
    return _round(found, 6, "price")


@query
def journal_mixed_studies(spark, d):
    found = parse_journal(st.mixed_journal_lines(st.part_study(spark, d))).studies
    return found.select("study_id", "name", "completed_trials", "total_trials", *[F.array_join(c, ",").alias(c) for c in ("directions", "param_names", "label_names", "objective_names")])


@query
def sobol(spark, d):
    return sensitivity.sobol(st.part_study(spark, d), st.PART, 1024)


@query
def pca_projection(spark, d):
    rows, names = st.embedding_columns(spark, d)
    return _round(cluster.pca(rows, names, 2)[0].select("vec_id", "pc1", "pc2"), 5, "pc1", "pc2")


@query
def kmeans(spark, d):
    rows, names = st.embedding_columns(spark, d)
    return cluster.kmeans(rows, names, 4, "vec_id")[0].select("vec_id", F.col("label"))


@query
def elbow(spark, d):
    rows, names = st.embedding_columns(spark, d)
    values, best = cluster.elbow(rows, names, "vec_id")
    return _round(spark.createDataFrame([(i + 2, v, i + 2 == best) for i, v in enumerate(values)], "k int, wcss double, recommended boolean"), 4, "wcss")


@query
def cluster_view(spark, d):
    return _round(cluster.cluster_view(st.part_study(spark, d), st.PART, "all", 3)[1], 4, "mean", "std")


@query
def forest_surface(spark, d):
    return pdp.surface(st.part_study(spark, d), st.PART, "p_size", "p_retailprice", "revenue", 20, "random_forest")


@query
def kriging_surface(spark, d):
    return pdp.surface(st.supplier_study(spark, d), roles.StudySchema(("s_nationkey", "balance"), ("quantity",)), "s_nationkey", "balance", "quantity", 20, "kriging")


@query
def live_replay(spark, d):
    """The journal of the part study replayed as a stream of four segments, one a batch, whose state goes on from batch to batch."""
    folder = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    lines = st.journal_lines(st.part_study(spark, d), st.PART).select(F.lit("part").alias("journal"), F.col("line_no").alias("offset"), "value")
    held = Scratch(spark).save(lines)
    n = held.count()
    for k in range(4):  # files are streamed in the order in which they were written
        part = held.where((F.col("offset") >= k * n // 4) & (F.col("offset") < (k + 1) * n // 4))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("journal string, offset long, value string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    run = completed_trials(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("study_id", "trial_id", F.element_at("params", F.lit("p_size")).alias("p_size"), F.get("objectives", F.lit(0)).alias("revenue"))


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
