"""Live tailing of a growing journal.

``JournalTail`` is a streaming source whose offset is a byte position. A batch ends
at the last complete line, so a half-written line waits; it is planned as byte
ranges, which executors read. ``tail`` folds its lines with state by key: creation
lines pass a counter of their journal, which gives ids; then trials wait in state by
id, few together, until they complete. They are then appended once, with
what the batch replay would give, and their state goes. A batch reads and writes the
state of the trials it touches and of their neighbours, no more. Writes that no value can be read from are
skipped, whatever their form; they never end the stream.

A batch takes at most ``MAX_BYTES`` (but for the first one after a restart), or one
line. The source opens its path as a file, so the journal must lie where the driver
and all executors can read it.
"""

from __future__ import annotations

import json
import os
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from optiloom.sources import operations as ops
from optiloom.sources.byte_ranges import Range, last_line_end, lines_of, ranges_of

OUT = "journal string, study_id long, trial_id long, params map<string,double>, param_labels map<string,string>, objectives array<double>, constraints array<double>, attrs_num map<string,double>, attrs_str map<string,string>"
#: Trials of following ids that share a row of state.
NEIGHBOURS = 256
#: Bytes of a journal read for one batch.
MAX_BYTES = 256 << 20


class JournalTail(DataSource):
    """``spark.readStream.format("journal_tail").option("path", file)``; rows: journal, offset, value."""

    @classmethod
    def name(cls) -> str:
        return "journal_tail"

    def schema(self) -> str:
        return "journal string, offset long, value string"

    def streamReader(self, schema):
        return TailReader(self.options["path"])


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path
        self._at: int | None = None  # where the next batch begins, as far as known

    def initialOffset(self) -> dict:
        self._at = 0
        return {"at": 0}

    def latestOffset(self) -> dict:
        if not os.path.exists(self.path):
            return {"at": self._at or 0}
        return {"at": last_line_end(self.path, self._at or 0, None if self._at is None else self._at + MAX_BYTES)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self._at = end["at"]
        return [InputPartition(r) for r in ranges_of(self.path, start["at"], end["at"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        own: Range = partition.value
        for at, line in lines_of(own):
            yield own.path, at, line

    def commit(self, end: dict) -> None:
        self._at = max(self._at or 0, end["at"])


_ROLES = {"p": "params", "l": "labels", "n": "num", "t": "text"}


def _apply(trial: dict, write: ops.Write) -> None:
    kind, key, num, text, values = write
    if kind in _ROLES:
        trial[_ROLES[kind]][key] = text if kind in "lt" else num
    elif kind in "vc":
        trial["values" if kind == "v" else "constraints"] = values


class Trials:
    """State of neighbouring trials: those that were created and have not ended."""

    def __init__(self, held: str | None = None):
        self.pending: dict[int, dict] = {int(k): v for k, v in json.loads(held).items()} if held else {}

    def dump(self) -> str:
        return json.dumps(self.pending)

    def feed(self, trial: int, line: str, study: int | None = None) -> dict | None:
        """Applies one line of a trial, with ``study`` the one that creates it; the trial comes back if it completes with it."""
        o = ops.parse(line)
        if study is not None:
            self.pending[trial] = {"study": study, "params": {}, "labels": {}, "values": [], "constraints": [], "num": {}, "text": {}}
        if trial not in self.pending:
            return None
        state = None
        for write in ops.writes_of(ops.whole(o["op_code"]), o):
            _apply(self.pending[trial], write)
            state = write[2] if write[0] == "s" else state
        ended = self.pending.pop(trial) if state in (1, 2, 3) else None
        return ended if state == 1 else None


class Births:
    """Counters of one journal, which see its creation lines in order."""

    def __init__(self, studies: int = 0, trials: int = 0):
        self.studies, self.trials = studies, trials

    def feed(self, line: str) -> tuple[int, int] | None:
        """(trial, study) that a line creates."""
        o = ops.parse(line)
        if ops.whole(o.get("op_code")) == 0:
            self.studies += 1
        elif (study := ops.whole(o.get("study_id"))) < self.studies:
            self.trials += 1
            return self.trials - 1, study
        return None


def _sorted(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values("offset")


class BirthsOfJournal(StatefulProcessor):
    """Gives every accepted creation line its trial's id and study."""

    def __init__(self, studies: int, trials: int):
        self.first = (studies, trials)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", "studies long, trials long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        count = Births(*(self.counters.get() or self.first))
        lines = _sorted(rows)
        found = [count.feed(line) for line in lines["value"]]
        self.counters.update((count.studies, count.trials))
        born = lines[[f is not None for f in found]]
        made = [f for f in found if f is not None]
        yield pd.DataFrame({"journal": key[0], "trial": [t for t, _ in made], "offset": born["offset"].to_numpy(), "value": born["value"].to_numpy(), "study": [s for _, s in made]})

    def close(self) -> None:
        pass


class WritesOfTrials(StatefulProcessor):
    """Holds trials until they end; complete ones come out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "blob string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.held.get()
        trials, out = Trials(before[0] if before else None), []
        for trial, value, study in _sorted(rows)[["trial", "value", "study"]].itertuples(index=False):
            done = trials.feed(int(trial), value, None if pd.isna(study) else int(study))
            if done:
                out.append((key[0], done["study"], trial, done["params"], done["labels"], done["values"], done["constraints"], done["num"], done["text"]))
        if trials.pending:
            self.held.update((trials.dump(),))
        elif before:
            self.held.clear()
        yield pd.DataFrame(out, columns=["journal", "study_id", "trial_id", "params", "param_labels", "objectives", "constraints", "attrs_num", "attrs_str"])

    def close(self) -> None:
        pass


def _routed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines that matter, with their operation and the trial they name."""
    for f in frames:
        parsed = [ops.parse(v) if v else None for v in f["value"]]
        codes = [ops.whole(o.get("op_code"), -1) if isinstance(o, dict) else -1 for o in parsed]
        f = f.assign(op=codes, trial=[ops.whole(o.get("trial_id")) if c >= 0 else 0 for o, c in zip(parsed, codes, strict=True)])
        yield f[f["op"].isin((0, 4, 5, 6, 8, 9))]


def completed_trials(lines: DataFrame, studies: int = 0, next_trial: int = 0) -> DataFrame:
    """Trials that complete, from a stream of journal, offset, value.

    State is two counters a journal, and one row for ``NEIGHBOURS`` trials of
    following ids of which some are not complete, in the session's RocksDB state
    store, which this operator asks for.
    Counting starts with ``studies`` known studies and at ``next_trial``, for a
    tail that begins behind a batch replay. A new checkpoint resets the state.
    """
    spark = lines.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")  # a batch writes its changes, not whole files
    routed = lines.mapInPandas(_routed, "journal string, offset long, value string, op long, trial long")
    creations = routed.where("op in (0, 4)").select("journal", "offset", "value")
    fields = "journal string, trial long, offset long, value string, study long"
    born = creations.groupBy("journal").transformWithStateInPandas(BirthsOfJournal(studies, next_trial), fields, "Append", "None")
    later = routed.where("op not in (0, 4)").select("journal", "trial", "offset", "value", F.lit(None).cast("long").alias("study"))
    both = born.unionByName(later).withColumn("part", F.floor(F.col("trial") / NEIGHBOURS))
    return both.groupBy("journal", "part").transformWithStateInPandas(WritesOfTrials(), OUT, "Append", "None")


def keep_running(start: Callable[[], StreamingQuery], most: int = 3) -> None:
    """Runs the query that ``start`` begins until it ends by itself. After an error it begins anew, until ``most`` errors follow each other without a batch between them."""
    failed = 0
    while True:
        query = start()
        try:
            query.awaitTermination()
            return
        except StreamingQueryException:
            failed = 1 if query.lastProgress else failed + 1
            if failed >= most:
                raise


def tail(spark: SparkSession, path: str) -> DataFrame:
    """Stream of completed trials of one growing journal file."""
    spark.dataSource.register(JournalTail)
    return completed_trials(spark.readStream.format("journal_tail").option("path", path).load())


@dataclass(frozen=True)
class Update:
    """One batch that ended, or the error that ended a query."""

    time: str
    batch: int
    rows: int
    error: str | None = None


class UpdateHistory(StreamingQueryListener):
    """The last ``n`` updates of all queries of a session, over restarts: register with ``spark.streams.addListener``. Batches without rows are left out."""

    def __init__(self, n: int = 10):
        self._held: deque[Update] = deque(maxlen=n)
        self._batch: dict[str, int] = {}

    @property
    def updates(self) -> list[Update]:
        return list(self._held)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._batch[str(p.id)] = p.batchId
        if p.numInputRows:
            self._held.append(Update(p.timestamp, p.batchId, p.numInputRows))

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self._held.append(Update("", self._batch.get(str(event.id), -1) + 1, 0, event.exception))


def recent_updates(query: StreamingQuery, n: int = 10) -> list[dict]:
    """Times and row counts of the last batches of a running query."""
    return [{"time": p["timestamp"], "rows": p["numInputRows"]} for p in query.recentProgress[-n:]]
