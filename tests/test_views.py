"""Selections, reports, fronts as views draw them, and the parts of live tailing that need no stream."""

import json
import math

import pytest
from pyspark.sql import functions as F

from optiloom.functions.ordered import running, with_position
from optiloom.functions.schema import StudySchema
from optiloom.operators import export, filters, pareto, pdp, sensitivity
from optiloom.sources import artifacts
from optiloom.sources import byte_ranges
from optiloom.sources.journal import read_files, read_lines
from optiloom.streaming.live import Births, TailReader, Trials, UpdateHistory, keep_running

STUDY = StudySchema(("p",), ("a", "b"), ("minimize", "minimize"))


@pytest.fixture(scope="module")
def study(spark):
    rows = [(0, 1.0, 3.0, 1.0), (1, 2.0, 1.0, 3.0), (2, 3.0, 2.0, 2.0), (3, 4.0, 3.0, 3.0), (4, 5.0, float("nan"), 0.0)]
    return spark.createDataFrame(rows, "trial_id long, p double, a double, b double").withColumn("row_idx", F.col("trial_id"))


def ids(df):
    return sorted(r.trial_id for r in df.collect())


def test_selection(study):
    s = filters.Selection()
    assert ids(s.apply(study)) == [0, 1, 2, 3, 4]
    s = s.with_range("p", 2.0, None).with_range("a", None, 2.0)
    assert ids(s.apply(study)) == [1, 2]
    assert ids(s.without_range("a").apply(study)) == [1, 2, 3, 4] and ids(s.without_range("a").without_range("p").apply(study)) == [0, 1, 2, 3, 4]
    assert ids(s.brush([0, 3]).apply(study)) == [0, 3] and ids(s.brush([0]).with_range("p", 5, 5).apply(study)) == []
    assert ids(s.brush([]).apply(study)) == [] and s.clear() == filters.Selection()


def test_fronts_of_views(study):
    assert [r.trial_id for r in pareto.front_line(study, STUDY).collect()] == [1, 2, 0]
    assert ids(pareto.drawn_as_front(study, STUDY)) == [0, 1, 2, 4]
    ranked, best, volume = pareto.ranks_and_volume(study, STUDY)
    assert ids(best) == [0, 1, 2] and volume == pytest.approx(pareto.hypervolume(study, STUDY).first().hv)
    assert {r.trial_id: r["rank"] for r in ranked.collect()} == {0: 1, 1: 1, 2: 1, 3: 2, 4: 3}
    assert pareto.ranks_and_volume(study.where("trial_id = 1"), STUDY)[2] is None


def test_columns_and_files(study, spark, tmp_path):
    assert export.parse_columns('["a", 3, "b"]') == ["a", "b"] and export.parse_columns("[broken") == [] and export.parse_columns('{"a": 1}') == []
    export.csv_write(study, str(tmp_path / "csv"), ["trial_id", "a"])
    read = lambda name: "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
    assert read("csv") == export.csv_text(study, ["trial_id", "a"]) == "trial_id,a\n0,3\n1,1\n2,2\n3,3\n4,\n"
    many = spark.range(5000).select(F.col("id").alias("row_idx"), F.concat(F.lit('a "b",'), "id").alias("t"), (F.col("id") / 7).alias("x")).repartition(9)
    export.csv_write(many, str(tmp_path / "many"), ["t", "x", "none"], bom=True)
    assert read("many") == export.csv_text(many, ["t", "x", "none"], bom=True) and read("many").startswith(export.BOM)
    broken = many.withColumn("t", F.when(F.col("row_idx") == 4000, F.raise_error(F.lit("broken"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="broken"):
        export.csv_write(broken, str(tmp_path / "broken"), ["t"])
    assert not [p for p in (tmp_path / "broken").rglob("*") if p.is_file()]
    found = {r.category for r in artifacts.list_artifacts(spark, str(tmp_path / "csv")).collect()}
    assert "text" in found


def test_report(study):
    history = running(study.where("trial_id < 4"), "trial_id", F.col("a"), F.min, "best")
    sections = export.report_sections(pareto.front(study, STUDY), study.where("trial_id = 3"), history, study.select("row_idx", (F.col("p") > 2).cast("int").alias("cluster")), ["trial_id", "p"])
    assert sections["Summary"] == "4 trials, best value 1.0" and sections["Pareto front"].startswith("3 trials") and sections["Clusters"] == "0: 2, 1: 3"
    page = export.html_report("<t>", export.report_stats(study, ["p"]), sections)
    assert "&lt;t&gt;" in page and "Pinned trials" in page


def test_surface_cache(study):
    cache, schema = pdp.SurfaceCache(), StudySchema(("p", "b"), ("a",))
    first = cache.surface(study.where("trial_id < 4"), schema, "p", "b", "a", 3)
    other = study.where("trial_id < 3")
    assert cache.surface(other, schema, "p", "b", "a", 3) is cache.surface(other, schema, "p", "b", "a", 3) is not first
    again = study.where("trial_id < 3")
    assert again is not other and cache.surface(again, schema, "p", "b", "a", 3) is cache.surface(other, schema, "p", "b", "a", 3)
    assert cache.surface(again, schema, "p", "b", "a", 2) is not cache.surface(again, schema, "p", "b", "a", 3)


def test_typed_record(study):
    row = filters.trial_at(study, 2, schema=STUDY).first()
    assert (row.trial_id, row.params, row["values"]) == (2, {"p": 3.0}, [2.0, 2.0])


def test_null_labels_keep_their_rows(spark):
    df = spark.createDataFrame([(0, "x"), (1, None), (2, "y"), (3, None), (4, "x")], "trial_id long, t string")
    got = {r.trial_id: r.code for r in sensitivity.label_encode(df, "t", "trial_id", "code").collect()}
    assert got == {0: 0.0, 1: 1.0, 2: 2.0, 3: 1.0, 4: 0.0}


def test_ranges_split_ties_and_series(spark):
    df = spark.range(400).select((F.col("id") % 3).alias("o"), F.col("id").alias("t"), (F.col("id") % 2).alias("s"), (F.col("id") * 7 % 11).alias("v"))
    got = sorted((r.o, r.t, r.row_idx) for r in with_position(df, "o", "row_idx", "t").collect())
    assert [x[2] for x in got] == list(range(400))
    rows = sorted((r.s, r.t, r.v, r.total) for r in running(df, "t", F.col("v"), F.sum, "total", by=("s",)).collect())
    sums = {0: 0, 1: 0}
    for s, _, v, total in rows:
        sums[s] += v
        assert total == sums[s]


def test_state_survives_odd_writes():
    trials = Trials()
    feed = lambda trial=6, study=None, **o: trials.feed(trial, json.dumps(o), study)
    log = {"name": "FloatDistribution", "log": True}
    done = feed(5, 0, op_code=4, study_id=0, distributions={}, params={"a": "x", "b": 2}, values=[None, 1], user_attrs={"k": 1, "t": "u", "n": None}, state=1)
    assert done["values"] == [1.0] and done["params"] == {"a": 0.0, "b": 2.0} and done["labels"] == {"a": "x"} and done["num"] == {"k": 1.0} and done["text"] == {"t": "u"}
    assert feed(6, 0, op_code=4, study_id=0) is None and feed(7, op_code=6, state=1) is None
    for o in ({"param_name": "p", "distribution": "{broken", "param_value_internal": 3}, {"param_name": "q", "distribution": log, "param_value_internal": 1000.0}, {"param_name": ["r"]}, {"param_name": "c", "distribution": {"name": "CategoricalDistribution", "choices": 5}, "param_value_internal": "x"}):
        assert feed(op_code=5, **o) is None
    assert feed(op_code=8, user_attr={"z": 2.5, "w": "v\ud800", "o": {}}) is None and feed(op_code=9, system_attr={"constraints": "x"}) is None
    assert feed(op_code=6, values="text") is None
    held = trials.dump()
    done = feed(op_code=6, state=1, values=[7])
    assert done["params"] == {"p": 3.0, "q": math.inf, "c": 0.0} and done["values"] == [7.0] and done["num"] == {"z": 2.5} and done["text"] == {"w": "v?"}
    assert not trials.pending and Trials(held).feed(6, '{"op_code": 6, "state": 1}', None)["params"] == {"p": 3.0, "q": math.inf, "c": 0.0}
    births = Births(studies=1, trials=5)
    assert [births.feed(json.dumps(o)) for o in ({"op_code": 4}, {"op_code": 4, "study_id": 1}, {"op_code": 0}, {"op_code": 4, "study_id": 1})] == [(5, 0), None, None, (6, 1)]


def read_all(reader, at=0):
    """Lines and the end of each batch until there are no more."""
    seen, ends = [], []
    reader.partitions({"at": at}, {"at": at})
    while (end := reader.latestOffset()["at"]) > at:
        for p in reader.partitions({"at": at}, {"at": end}):
            seen += list(reader.read(p))
        ends.append(end)
        reader.commit({"at": end})
        at = end
    return seen, ends


@pytest.mark.parametrize("step", [1, 3, 8, 1000])
def test_byte_ranges_hold_each_line_once(tmp_path, monkeypatch, step):
    monkeypatch.setattr(byte_ranges, "RANGE_BYTES", step)
    monkeypatch.setattr(byte_ranges, "_STEP", 2)
    path = tmp_path / "j"
    path.write_bytes("ab\n\ncd é\r\na line longer than a range\nrest".encode())
    seen, ends = read_all(TailReader(str(path)))
    assert [x[2] for x in seen] == ["ab", "", "cd é\r", "a line longer than a range"] and [x[1] for x in seen] == [0, 3, 4, 11]
    with path.open("a") as f:
        f.write(" of it\n")
    assert [x[2] for x in read_all(TailReader(str(path)), ends[-1])[0]] == ["rest of it"]


def test_batches_are_bounded(tmp_path, monkeypatch):
    from optiloom.streaming import live

    monkeypatch.setattr(live, "MAX_BYTES", 8)
    path = tmp_path / "j"
    path.write_text("ab\ncd\na line longer than a batch\nrest")
    reader = TailReader(str(path))
    reader.initialOffset()
    seen, ends = read_all(reader)
    assert [x[2] for x in seen] == ["ab", "cd", "a line longer than a batch"] and ends == [6, 33]
    assert TailReader(str(tmp_path / "none")).latestOffset() == {"at": 0}


def test_a_large_growth_is_planned_as_several_ranges(tmp_path):
    path = tmp_path / "j"
    with path.open("wb") as f:
        f.truncate(1 << 30)
        f.seek(0, 2)
        f.write(b"\n")
    reader = TailReader(str(path))
    end = reader.latestOffset()
    assert end == {"at": (1 << 30) + 1} and len(reader.partitions({"at": 0}, end)) == 129


def test_files_as_a_batch_source(spark, tmp_path, monkeypatch):
    (tmp_path / "logs").mkdir()
    for name, n in (("b", 700), ("a", 300), ("empty", 0)):
        (tmp_path / "logs" / name).write_text("".join(f"{name}{i}\n" for i in range(n)))
    (tmp_path / "logs" / "c").write_text("no end")
    found = read_files(spark, str(tmp_path / "logs")).orderBy("line_no").collect()
    assert [r.value for r in found] == [r.value for r in read_lines(spark, str(tmp_path / "logs")).orderBy("line_no").collect()]
    assert len({r.line_no for r in found}) == len(found) == 1001
    assert [r.value for r in read_files(spark, str(tmp_path / "logs" / "a*")).orderBy("line_no").collect()] == [f"a{i}" for i in range(300)]


def test_update_history_keeps_errors_between_batches(spark, tmp_path):
    """Two good batches with a failed one between them, over a restart."""
    history = UpdateHistory()
    spark.streams.addListener(history)
    try:
        source, flag = tmp_path / "in", tmp_path / "fail"
        source.mkdir()
        for k in range(3):
            (source / f"{k}.txt").write_text(f"{k}\n" * (k + 1))
            flag.write_text("x") if k == 1 else flag.unlink(missing_ok=True)

            def sink(df, _):
                df.count()
                if flag.exists():
                    raise ValueError("the sink is full")

            query = spark.readStream.text(str(source)).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            try:
                query.awaitTermination()
            except Exception:
                assert k == 1
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        got = history.updates
        assert [(u.rows, u.batch) for u in got] == [(1, 0), (0, 1), (2, 1), (3, 2)] and [bool(u.error) for u in got] == [False, True, False, False]
        assert "the sink is full" in got[1].error
        history._held = type(history._held)(got, maxlen=2)
        assert history.updates == got[-2:]
    finally:
        spark.streams.removeListener(history)


def test_artifacts(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "t.CSV").write_text("x,y\n" + "".join(f"{i},{i}\n" for i in range(30)))
    for i in range(60):
        (tmp_path / "a" / f"p{i:02}.png").write_bytes(b"x" * (i + 1))
    found = artifacts.list_artifacts(spark, str(tmp_path / "a"))
    assert {r.category: r["count"] for r in found.groupBy("category").count().collect()} == {"image": 60, "table": 1}
    pages = [[r.path.rsplit("/", 1)[1] for r in artifacts.gallery_page(found, k).collect()] for k in range(3)]
    assert [len(p) for p in pages] == [48, 13, 0] and pages[0][0] == "p00.png" and pages[1][-1] == "t.CSV"
    preview = artifacts.preview_csv(spark, str(tmp_path / "a" / "t.CSV"))
    assert preview.columns == ["x", "y"] and preview.count() == 20


def test_restarts_end_after_errors_in_a_row():
    from pyspark.errors import StreamingQueryException

    class Failing:
        lastProgress = None

        def awaitTermination(self):
            raise StreamingQueryException("failed")

    begun = []
    with pytest.raises(StreamingQueryException):
        keep_running(lambda: begun.append(1) or Failing(), 3)
    assert len(begun) == 3


def test_one_long_series_in_fifty_ranges(spark):
    """Series of one key over many ranges: values cross the ranges' ends, and means the blocks' ends."""
    import numpy as np

    from optiloom.functions import ordered
    from optiloom.operators import history

    rng = np.random.default_rng(3)
    v = rng.integers(0, 10_000, 700).astype(float)
    rows = [(i, "long", float(x)) for i, x in enumerate(v)] + [(i, None, float(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "t long, s string, v double").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    size, ordered.AVERAGED = ordered.AVERAGED, 7
    try:
        of = lambda df, c: [r[c] for r in df.where("s = 'long'").orderBy("t").collect()]
        mean = of(history.moving_average(df, "t", "v", ("s",)), "moving_avg")
        assert mean == pytest.approx([v[max(0, i - 4) : i + 1].mean() for i in range(len(v))])
        best = np.minimum.accumulate(v)
        step = [0.0] + [abs((a - b) / a) * 100 if a else 0.0 for a, b in zip(best, best[1:])]
        assert of(history.improvement(df, "t", "v", ("s",)), "improvement") == pytest.approx(step)
        records = [i for i in range(len(v)) if i == 0 or v[i] < best[i - 1]]
        assert of(history.record_trials(df, "t", "v", ("s",)), "t") == records
        found = {r.s: r for r in history.convergence(df, "t", "v", ("s",)).collect()}
        assert found["long"].n == 700 and found["long"].rate == pytest.approx(abs((best[560] - best[-1]) / best[560])) and found[None].verdict == "insufficient"
        assert sorted(r.row_idx for r in with_position(df.where("s = 'long'"), "v", "row_idx", "t").collect()) == list(range(700))
    finally:
        ordered.AVERAGED = size
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_edf_of_two_objectives(study):
    from optiloom.operators import history

    got = sorted((r.objective, r.trial_id, r.value, r.y) for r in history.edf_of(study, STUDY).collect())
    assert got == [("a", 0, 3.0, 0.75), ("a", 1, 1.0, 0.25), ("a", 2, 2.0, 0.5), ("a", 3, 3.0, 1.0), ("b", 0, 1.0, 0.4), ("b", 1, 3.0, 0.8), ("b", 2, 2.0, 0.6), ("b", 3, 3.0, 1.0), ("b", 4, 0.0, 0.2)]
