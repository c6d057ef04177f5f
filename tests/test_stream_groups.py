"""Sessions that share a call of the stream's state function."""

from parley import session
from parley.plans import queries as q
from parley.sources import tables as tb
from parley.streaming import ledger as st
from tests.test_sessions import _said

SMALL = "/root/testdata/sf0.001"


class State:
    """A group's state with a clock that the test moves."""

    def __init__(self):
        self.exists, self.hasTimedOut, self.now, self.due = False, False, 0, None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.exists, self.value = True, value

    def remove(self):
        self.exists = False

    def getCurrentProcessingTimeMs(self):
        return self.now

    def setTimeoutDuration(self, ms):
        self.due = self.now + ms


def _frame(spark, rows):
    return st._packed(spark.createDataFrame(rows, st.OBSERVED)).toPandas()


def _applied(step, state, frames):
    return [(r.session_id, r.turn, r.n_evidence) for out in step((0,), frames, state) for r in out.itertuples()]


def test_sessions_of_a_group_have_timers_of_their_own(spark):
    step, state = st.advance(100, 10, 1_000), State()
    first = _frame(spark, [_said(1, 1, ["a"]), _said(1, 3, ["c"]), _said(2, 1, ["b"])])
    assert _applied(step, state, [first]) == [(1, 1, 1), (2, 1, 1)] and state.due == 100
    state.now = 60  # another session's turn neither releases what waits nor puts it off
    assert _applied(step, state, [_frame(spark, [_said(3, 1, ["d"])])]) == [(3, 1, 1)] and state.due == 100
    state.now, state.hasTimedOut = 100, True
    assert _applied(step, state, []) == [(1, 3, 2)] and state.due == 1_000
    state.now = 1_000  # session 2 is forgotten, the others stay
    assert _applied(step, state, []) == [] and sorted(st._load(state)) == [1, 3] and state.due == 1_060
    state.now = 1_100
    assert _applied(step, state, []) == [] and not state.exists


def test_groups_give_the_same_ledger(spark, tmp_path):
    batches = [[_said(s, t, [f"p{t}", f"s{s}"]) for s in range(40) for t in (1, 2, 4) if (s + t) % 5],
               [_said(s, t, [f"p{t}"]) for s in range(40) for t in (2, 3, 5)], [_said(s, 1, ["late"]) for s in range(0, 40, 3)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, st.OBSERVED).coalesce(1).write.parquet(f"{tmp_path}/said/batch={i}")
    got = []
    for groups in (None, 3):
        out = st.ledger_stream(st.read_analysed(spark, f"{tmp_path}/said", 1), gap_ms=None, groups=groups)
        (out.writeStream.format("parquet").option("path", f"{tmp_path}/out{groups}").option("checkpointLocation", f"{tmp_path}/c{groups}")
         .trigger(availableNow=True).start().awaitTermination())
        got.append(sorted(map(tuple, spark.read.schema(st.OUTPUT).parquet(f"{tmp_path}/out{groups}").collect())))
    assert got[0] == got[1] and len(got[0]) > 100


def test_a_call_serves_many_sessions(spark, monkeypatch):
    """The query's state has as many rows as groups, not as sessions."""
    session.configure(spark)
    seen = []
    whole = st.ledger_stream
    monkeypatch.setattr(st, "ledger_stream", lambda *a, **k: seen.append(k["groups"]) or whole(*a, **k))
    assert q.QUERIES["stream_ledger"](spark, SMALL).count() == tb.messages(spark, SMALL).count()
    sessions = tb.messages(spark, SMALL).select("session_id").distinct().count()
    assert len(seen) == 1 and seen[0] < sessions / 10
