"""Replay of journals, in one batch and as a stream."""

import json

import pytest
from pyspark.sql import functions as F

from optiloom.sources.journal import JournalError, parse_journal, read_lines
from optiloom.streaming.live import completed_trials, tail


def lines(spark, ops):
    text = [o if isinstance(o, str) else json.dumps(o) for o in ops]
    return spark.createDataFrame(list(enumerate(text)), "line_no long, value string")


INT = {"name": "IntDistribution", "attributes": {"low": 0, "high": 10, "step": 2, "log": False}}
CAT = json.dumps({"name": "CategoricalDistribution", "choices": ["u", "v"]})
OPS = [
    {"op_code": 0, "study_name": "s", "directions": [1, 2]},
    {"op_code": 4, "study_id": 7},
    {"op_code": 6, "trial_id": 0, "state": 1, "values": [9, 9]},
    {"op_code": 4, "study_id": 0},
    "{broken",
    {"op_code": 5, "trial_id": 0, "param_name": "n", "param_value_internal": 2.0, "distribution": INT},
    {"op_code": 5, "trial_id": 0, "param_name": "c", "param_value_internal": 1.0, "distribution": CAT},
    {"op_code": 5, "trial_id": 0, "param_name": "", "param_value_internal": 1.0},
    {"op_code": 8, "trial_id": 0, "user_attr": {"k": 3, "t": "x", "b": True}},
    {"op_code": 9, "trial_id": 0, "system_attr": {"constraints": [-0.5, 0.3]}},
    {"op_code": 4, "study_id": 0},
    {"op_code": 6, "trial_id": 0, "state": 1, "values": [1.0, None, 2.0]},
    {"op_code": 6, "trial_id": 0, "state": 1},
    {"op_code": 4, "study_id": 0, "distributions": {"n": INT}, "params": {"n": 5}, "state": 1, "value": 4.0},
    {"op_code": 6, "trial_id": 1, "state": 3},
    {"op_code": 99},
]


def test_replay(spark):
    found = parse_journal(lines(spark, OPS))
    study = found.studies.first()
    assert (study.completed_trials, study.total_trials, study.directions) == (2, 3, ["minimize", "maximize"])
    assert study.objective_names == ["obj0", "obj1"] and study.user_attr_names == ["k", "t"]
    trial = found.trials.where("trial_id = 0").first()
    assert trial.params == {"n": 4.0, "c": 1.0} and trial.param_labels == {"c": "v"} and trial.objectives == [1.0, 2.0]
    assert trial.attrs_num == {"k": 3.0} and trial.attrs_str == {"t": "x"} and trial.constraints == [-0.5, 0.3]
    assert found.trials.where("trial_id = 2").first().params == {"n": 5.0}
    wide = found.select(0).orderBy("row_idx").collect()
    assert [(r.row_idx, r.trial_id, r.c, r.is_feasible, r.c2) for r in wide] == [(0, 0, "v", 0.0, 0.3), (1, 2, "", 1.0, 0.0)]
    with pytest.raises(KeyError):
        found.select(3)


def test_replay_of_odd_forms(spark):
    """Inline trials, metric names, strings that hold distributions, writes before creation, and values of the wrong form."""
    cat = {"name": "CategoricalDistribution", "attributes": {"choices": ["u", 2, True, 1.5]}}
    log_int = json.dumps({"name": "IntDistribution", "low": 1, "step": 3, "log": True})
    ops = [
        {"op_code": 3, "study_id": 0, "system_attr": {"study:metric_names": ["early"]}},
        {"op_code": 0},
        {"op_code": 0, "study_name": "t", "directions": [2]},
        {"op_code": 3, "study_id": 1, "system_attr": {"study:metric_names": ["loss", 3, "time"]}},
        {"op_code": 3, "study_id": 1, "system_attr": {"study:metric_names": []}},
        {"op_code": 4, "study_id": 1, "distributions": {"c": cat}, "params": {"c": True, "d": "nowhere", "e": 2.5, "f": None}, "state": 1, "values": None, "value": 7, "user_attrs": {"k": 1, "t": "x", "z": []}, "system_attrs": {"constraints": [1, None, -2]}},
        {"op_code": 5, "trial_id": 0, "param_name": "i", "param_value_internal": 0.7, "distribution": log_int},
        {"op_code": 5, "trial_id": 0, "param_name": "c", "param_value_internal": 3.2, "distribution": cat},
        {"op_code": 5, "trial_id": 0, "param_name": "g", "param_value_internal": 9.0, "distribution": cat},
        {"op_code": 5, "trial_id": 0, "param_name": "u"},
        {"op_code": 8, "trial_id": 0, "user_attr": {"k": "now text"}},
        {"op_code": 8, "trial_id": 1, "user_attr": {"too": 1}},
        {"op_code": 4},
        {"op_code": 6, "trial_id": 1, "state": 1, "values": [1, "x", None, 2]},
        {"op_code": 6, "trial_id": 1, "values": [5]},
        {"op_code": 6, "trial_id": 1, "state": 1},
        {"op_code": True},
        [1],
        "null",
        '{"op_code": 6, "trial_id": 1, "state": 2, "values": [NaN]}',
    ]
    found = parse_journal(lines(spark, ops))
    studies = {r.study_id: r for r in found.studies.collect()}
    assert (studies[0].name, studies[0].directions, studies[0].objective_names) == ("", [], ["obj0"])
    assert (studies[1].name, studies[1].directions, studies[1].objective_names) == ("t", ["maximize"], ["loss", "time"])
    trials = {r.trial_id: r for r in found.trials.collect()}
    assert trials[0].study_id == 1 and trials[0].params == {"c": 3.0, "d": 0.0, "e": 2.5, "g": 9.0, "i": 7.0, "u": 0.0}
    assert trials[0].param_labels == {"c": "1.5", "d": "nowhere"} and trials[0].objectives == [7.0] and trials[0].constraints == [1.0, -2.0]
    assert trials[0].attrs_num == {"k": 1.0} and trials[0].attrs_str == {"k": "now text", "t": "x"}
    assert trials[1].study_id == 0 and trials[1].objectives == [5.0] and trials[1].attrs_num == {}


def test_last_write_of_a_field_counts_over_many_parts(spark):
    """50,000 writes to one trial over 40 parts; blocks of running counts of 16 lines."""
    from optiloom.sources import journal

    bits, journal.BLOCK_BITS = journal.BLOCK_BITS, 4
    try:
        ops = [{"op_code": 0, "study_name": "s", "directions": [1]}, *({"op_code": 4, "study_id": 0} for _ in range(100))]
        ops += [{"op_code": 5, "trial_id": 7, "param_name": f"p{i % 5}", "param_value_internal": float(i)} for i in range(5000)]
        ops += [{"op_code": 6, "trial_id": i, "state": 1, "values": [float(i)]} for i in range(100)]
        found = parse_journal(lines(spark, ops).repartition(40))
        trials = {r.trial_id: r for r in found.trials.collect()}
        assert sorted(trials) == list(range(100)) and trials[7].params == {f"p{k}": float(4995 + k) for k in range(5)}
        assert all(t.objectives == [float(i)] for i, t in trials.items())
    finally:
        journal.BLOCK_BITS = bits


def test_empty_and_garbage(spark):
    assert parse_journal(lines(spark, [])).studies.count() == 0
    with pytest.raises(JournalError):
        parse_journal(lines(spark, ["nonsense", "more"]))


def test_read_lines_keeps_order(spark, tmp_path):
    (tmp_path / "j.log").write_text("".join(f"{i}\n" for i in range(3000)))
    got = read_lines(spark, str(tmp_path / "j.log")).orderBy("line_no").collect()
    assert [r.value for r in got] == [str(i) for i in range(3000)] and [r.line_no for r in got] == list(range(3000))


def test_stream_equals_batch(spark, tmp_path):
    path = tmp_path / "j.log"
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    text = [o if isinstance(o, str) else json.dumps(o) for o in OPS]
    for part in (text[:6], text[6:12], text[12:]):
        with path.open("a") as f:
            f.write("".join(x + "\n" for x in part))
        q = tail(spark, str(path)).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
        q.processAllAvailable()
        q.stop()
    got = {r.trial_id: (r.params, r.objectives) for r in spark.read.parquet(out).collect()}
    want = {r.trial_id: (r.params, r.objectives) for r in parse_journal(lines(spark, OPS)).trials.collect()}
    assert got == want and callable(completed_trials) and F is not None
