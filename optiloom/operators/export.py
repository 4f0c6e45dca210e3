"""CSV text, report statistics, HTML report and session documents."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optiloom.functions.schema import finite
from optiloom.operators.filters import long_form, plain_number, trials_batch

BOM = "﻿"
MAX_PINS = 20


def parse_columns(text: str) -> list[str]:
    """Names of a JSON array of strings. Other members are skipped; text that is no array names nothing."""
    try:
        found = json.loads(text)
    except ValueError:
        return []
    return [x for x in found if isinstance(x, str)] if isinstance(found, list) else []


def csv_field(text: Column) -> Column:
    """Quoted only if it holds a comma, a quote or a line feed."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\n]'), quoted).otherwise(text)


def csv_cell(df: DataFrame, name: str) -> Column:
    kinds = dict(df.dtypes)
    if name not in kinds:
        return F.lit("")
    text = F.coalesce(F.col(name).cast("string"), F.lit(""))
    return csv_field(plain_number(F.col(name)) if kinds[name] in ("double", "float") else text)


def csv_lines(df: DataFrame, columns: Sequence[str], order: str | None = None) -> DataFrame:
    """``line`` per row (without the header) and its ``ordinal``; no columns mean all of them."""
    columns = list(columns) or [c for c in df.columns if c != order]
    keep = [F.col(order).alias("ordinal")] if order else []
    return df.select(*keep, F.concat_ws(",", *[F.coalesce(csv_cell(df, c), F.lit("")) for c in columns]).alias("line"))


def csv_text(df: DataFrame, columns: Sequence[str], positions: Sequence[int] | None = None, bom: bool = False) -> str:
    """The text of a download: header and the rows at the given positions in that order (all by ``row_idx`` if none)."""
    columns = list(columns) or [c for c in df.columns if c != "row_idx"]
    chosen = trials_batch(df, positions) if positions is not None else df.withColumn("ordinal", F.col("row_idx"))
    lines = csv_lines(chosen, columns, "ordinal").orderBy("ordinal").toLocalIterator()
    return (BOM if bom else "") + "\n".join([",".join(columns), *(r.line for r in lines)]) + "\n"


def csv_write(df: DataFrame, path: str, columns: Sequence[str], bom: bool = False) -> None:
    """Distributed export: text files whose names rise with ``row_idx``, end to end equal to :func:`csv_text`.

    The first line of the first file is the header, after a byte order mark if one is
    asked for. Files appear when all of them are written; a failed task leaves none.
    """
    columns = list(columns) or [c for c in df.columns if c != "row_idx"]
    header = df.sparkSession.createDataFrame([(-1, (BOM if bom else "") + ",".join(columns))], "ordinal long, line string")
    lines = header.unionByName(csv_lines(df, columns, "row_idx").withColumn("ordinal", F.col("ordinal").cast("long")))
    lines.orderBy("ordinal").select("line").write.mode("overwrite").text(path)


def report_stats(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """name, min, max, mean, std (sample, 0 for one row), count over finite values; columns without any are left out."""
    rows = long_form(df, names).where(finite(F.col("value")))
    return rows.groupBy("name").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count(F.lit(1)).alias("count"))


def html_report(title: str, stats: DataFrame, sections: dict[str, str] | None = None) -> str:
    """A page with the statistics as a table, the given sections, and the data embedded as JSON."""
    rows = [r.asDict() for r in stats.orderBy("name").collect()]  # a row per column
    head = "".join(f"<th>{h}</th>" for h in ("name", "min", "max", "mean", "std", "count"))
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(r[h]))}</td>" for h in ("name", "min", "max", "mean", "std", "count")) + "</tr>" for r in rows)
    extra = "".join(f"<section><h2>{html.escape(k)}</h2><p>{html.escape(v)}</p></section>" for k, v in (sections or {}).items())
    data = json.dumps(rows, default=float).replace("</", "<\\/")
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>{extra}<script type="application/json" id="data">{data}</script></body></html>'


def report_sections(front: DataFrame, pinned: DataFrame, history: DataFrame, clusters: DataFrame | None, columns: Sequence[str], rows: int = MAX_PINS) -> dict[str, str]:
    """Texts of a report's sections: sizes and the first ``rows`` of the front, the pinned trials, last best value, cluster sizes."""
    listed = lambda df: "; ".join(r.line for r in csv_lines(df, columns, "row_idx").orderBy("ordinal").limit(rows).collect())
    last = history.agg(F.count(F.lit(1)).alias("n"), F.max_by("best", "row_idx").alias("best")).first()
    out = {"Summary": f"{last.n} trials, best value {last.best}", "Pareto front": f"{front.count()} trials: {listed(front)}", "Pinned trials": listed(pinned), "History": f"best value {last.best} after {last.n} trials"}
    if clusters is not None:
        out["Clusters"] = ", ".join(f"{r[0]}: {r[1]}" for r in clusters.groupBy("cluster").count().orderBy("cluster").collect())  # a row per cluster
    return out


def session_document(ranges: dict, selected: Sequence[int], pins: Sequence[int]) -> str:
    return json.dumps({"version": "1.0", "filterRanges": ranges, "selectedIndices": list(selected), "pinnedTrials": list(pins)[:MAX_PINS]})


def load_session(text: str) -> dict:
    found = json.loads(text)
    if found.get("version") != "1.0":
        raise ValueError("unknown session version")
    return found
