"""Session ledger over a stream of messages.

Two queries, connected by a folder:

1. `analyse` reads messages and, per micro-batch, runs the same operators as the batch ledger
   (templates, spans, mining, attestation) and appends what every message states. It keeps no state.
2. `ledger_stream` reads those rows and keeps a small state of every session: evidence, stale and lost
   counts, override epoch, rejected items, asked attributes. Sessions can share a call of the state function, as calls cost far
   more than what they do for a session.

The ledger depends on turn order. A turn that arrives early waits in state until the turns before it are
applied, or until a timer gives them up; a turn that arrives after a later one was applied is counted as
late and not applied. Splitting the stream into micro-batches differently therefore gives the same ledger.

State is small. After the last turn only counters stay, so that repeats are still told apart, and a timer removes
what no message has touched for `ttl_ms`. A finite log has no timers: `flush` gives the turns that still wait at its end.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parley.operators import catalogue as cat
from parley.operators import index as ix
from parley.operators import ledger as lg
from parley.plans import scale
from parley.settings import DEFAULTS, Settings

STATE = "sessions string"  # JSON: of every session its id, the values of `_empty`, and when it is given up or forgotten
OBSERVED = ("session_id bigint, turn int, noinfo boolean, known boolean, override boolean, counted boolean, "
            f"states_con boolean, evidence {lg.EVIDENCE}, shown array<bigint>, asked string")
OUTPUT = ("session_id bigint, turn int, grew int, stale int, lost int, epoch int, n_evidence int, n_rejected int, "
          "n_asked int, late int, added string")
ADDED = lg.EVIDENCE


def analyse(messages: DataFrame, items: DataFrame, folder: str, checkpoint: str, spans: bool = True,
            cfg: Settings = DEFAULTS, trigger: dict | None = None, index: ix.PhraseIndex | None = None) -> StreamingQuery:
    """Stream of (session_id, turn, user_message[, shown, asked]) -> analysed rows under `folder`.

    Micro-batches look phrases up in a stored `index` of the items, built here where none is given; none reads the catalogue.

    Each micro-batch writes its own sub-folder once; a batch repeated after a failure is skipped when
    its output is already complete. `trigger` goes to the writer; the default reads what is there and ends.
    """
    spark = messages.sparkSession
    indexed = index or ix.build_index(cat.index_fields(items), cfg=cfg)
    cats = attrs = None
    if spans:
        cats = scale.keep(cat.category_vocabulary(items, cfg))
        attrs = scale.keep(cat.attribute_vocabulary(cat.disclosable_values(items, cfg), cfg))

    def run(batch: DataFrame, batch_id: int) -> None:
        out = f"{folder}/batch={batch_id}"
        if _complete(spark, f"{folder}/done/{batch_id}"):
            return
        rows = scale.keep(batch)
        said = scale.keep(lg.text_evidence(rows, indexed, cats, attrs, cfg=cfg))
        seen = lg.observe(rows, said, cfg=cfg)
        extra = [c if c in rows.columns else f"cast(null as {t}) as {c}"
                 for c, t in (("shown", "array<bigint>"), ("asked", "string"))]
        seen = seen.join(rows.selectExpr("session_id", "turn", *extra), ["session_id", "turn"])
        seen.write.mode("overwrite").parquet(out)
        spark.range(1).write.mode("overwrite").parquet(f"{folder}/done/{batch_id}")

    return (messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a mark says that a batch's folder was written to its end."""
    try:
        return not spark.read.schema("id bigint").parquet(path).isEmpty()
    except AnalysisException:
        return False


def _empty() -> dict:
    return dict(last=0, stale=0, lost=0, epoch=0, late=0, phrases=set(), rejected=[], asked=[], waiting={})


def _apply(session_id: int, s: dict, turn: int, body: dict) -> tuple:
    """One turn: an override clears rejections, new phrases enter, stale and lost counts move."""
    if body["override"]:
        s["epoch"], s["rejected"] = s["epoch"] + 1, []
    n_rejected, n_asked = len(s["rejected"]), len(s["asked"])
    added = []
    for seq, phrase, tier, df in sorted(body["evidence"]):
        if phrase not in s["phrases"]:
            s["phrases"].add(phrase)
            added.append({"seq": seq, "phrase": phrase, "tier": tier, "df": df})
    grew = int(any(a["seq"] < lg.LATE for a in added))
    if body["counted"]:
        s["stale"] = 0 if grew else s["stale"] + 1
    s["lost"] += int(not body["noinfo"] and not body["known"])
    s["rejected"] += [i for i in body["shown"] if i not in s["rejected"]]
    if body["asked"] is not None and body["asked"] not in s["asked"]:
        s["asked"].append(body["asked"])
    s["last"] = turn
    return (session_id, turn, grew, s["stale"], s["lost"], s["epoch"], len(s["phrases"]), n_rejected, n_asked,
            s["late"], json.dumps(added))


def _packed(observed: DataFrame) -> DataFrame:
    """Analysed rows as session, turn and one JSON column."""
    body = F.to_json(F.struct("noinfo", "known", "override", "counted", "evidence", "shown", "asked"))
    return observed.select("session_id", "turn", body.alias("body"))


def _body(packed: str) -> dict:
    r = json.loads(packed)
    return dict({k: bool(r.get(k)) for k in ("noinfo", "known", "override", "counted")},
                evidence=[(e["seq"], e["phrase"], e["tier"], e["df"]) for e in r.get("evidence") or ()],
                asked=r.get("asked"), shown=r.get("shown") or [])


def _load(state: GroupState) -> dict[int, dict]:
    """Sessions of a group, each with `due`, the time at which it is given up or forgotten."""
    sessions = {}
    for key, last, stale, lost, epoch, late, phrases, rejected, asked, waiting, due in json.loads(state.get[0]) if state.exists else ():
        sessions[key] = dict(last=last, stale=stale, lost=lost, epoch=epoch, late=late, phrases=set(phrases), rejected=rejected,
                             asked=asked, waiting={int(t): b for t, b in waiting}, due=due)
    return sessions


def _save(state: GroupState, sessions: dict[int, dict]) -> None:
    state.update((json.dumps([(key, s["last"], s["stale"], s["lost"], s["epoch"], s["late"], sorted(s["phrases"]), s["rejected"], s["asked"],
                               sorted(s["waiting"].items()), s["due"]) for key, s in sessions.items()], separators=(",", ":")),))


def _take(s: dict, rows: Iterable[tuple[int, str]], max_turns: int) -> None:
    """Arrived turns wait until it is their turn; repeated, late and surplus ones are counted."""
    for turn, packed in rows:
        if turn <= s["last"] or turn in s["waiting"] or turn > max_turns:
            s["late"] += 1
        else:
            s["waiting"][turn] = _body(packed)


def _release(session_id: int, s: dict, over_gaps: bool) -> list[tuple]:
    """Apply waiting turns in order, up to the first missing one or over it."""
    out = []
    for turn in sorted(s["waiting"]):
        if turn != s["last"] + 1 and not over_gaps:
            break
        out.append(_apply(session_id, s, turn, s["waiting"].pop(turn)))
    return out


NAMES = [c.split()[0] for c in OUTPUT.split(", ")]


def advance(gap_ms: int | None, max_turns: int, ttl_ms: int = 86_400_000):
    """State function of a group of sessions."""
    def settle(key: int, s: dict, over_gaps: bool, now: int) -> list[tuple]:
        out = _release(key, s, over_gaps)
        if s["last"] >= max_turns:
            s |= dict(phrases=set(), rejected=[], asked=[], waiting={})
        if gap_ms is not None:
            s["due"] = now + (gap_ms if s["waiting"] else ttl_ms)
        return out

    def step(key, frames, state: GroupState) -> Iterator[pd.DataFrame]:
        sessions, arrived, out = _load(state), {}, []
        now = state.getCurrentProcessingTimeMs() if gap_ms is not None else 0
        for frame in frames:
            for session, *turn in zip(frame["session_id"].tolist(), frame["turn"].tolist(), frame["body"].tolist()):
                arrived.setdefault(session, []).append(turn)
        for session, turns in arrived.items():
            s = sessions.setdefault(session, _empty() | {"due": None})
            _take(s, turns, max_turns)
            out += settle(session, s, False, now)
        if gap_ms is not None:
            for session in [k for k, s in sessions.items() if s["due"] <= now and k not in arrived]:
                if sessions[session]["waiting"]:
                    out += settle(session, sessions[session], True, now)
                else:
                    del sessions[session]
        if sessions:
            _save(state, sessions)
            if gap_ms is not None:
                state.setTimeoutDuration(max(1, min(s["due"] for s in sessions.values()) - now))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=NAMES)

    return step


def ledger_stream(observed: DataFrame, gap_ms: int | None = 60_000, cfg: Settings = DEFAULTS,
                  ttl_ms: int = 86_400_000, groups: int | None = None) -> DataFrame:
    """Analysed rows (see `OBSERVED`) -> one row per applied turn. `added` is JSON of `ADDED`.

    A session whose next turn is missing for `gap_ms` goes on without it, and one that nothing has touched for `ttl_ms` is
    forgotten. Pass None to replay a finite log, where timers never fire, and add what `flush` gives. The state store is the
    session's; RocksDB suits many sessions.

    A session is a call of its own, or with `groups` one of so many groups of sessions is: a call then reads and writes the state of
    its group, which suits replays with a few large micro-batches. The number must stay the same for a checkpoint.
    """
    timeout = GroupStateTimeout.NoTimeout if gap_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    key = F.col("session_id") if groups is None else F.pmod(F.xxhash64("session_id"), F.lit(groups))
    return _packed(observed).withColumn("group", key).groupBy("group").applyInPandasWithState(
        advance(gap_ms, cfg.max_turns, ttl_ms), outputStructType=OUTPUT, stateStructType=STATE, outputMode="append", timeoutConf=timeout)


def flush(observed: DataFrame, applied: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Turns of a finite log that still wait because an earlier one never came, applied over the gaps.

    `observed` are all analysed rows, `applied` what the stream gave. Only sessions with waiting turns are replayed; each
    has at most `max_turns` turns.
    """
    turns = observed.filter(F.col("turn").between(1, cfg.max_turns)).select("session_id", "turn")
    open_ = turns.join(applied.select("session_id", "turn"), ["session_id", "turn"], "left_anti").select("session_id").distinct()

    def replay(key, frame: pd.DataFrame) -> pd.DataFrame:
        s = _empty()
        _take(s, sorted(zip(frame["turn"].tolist(), frame["body"].tolist())), cfg.max_turns)
        return pd.DataFrame(_release(key[0], s, True), columns=NAMES)

    rows = _packed(observed.join(open_, "session_id", "left_semi").dropDuplicates(["session_id", "turn"]))
    done = applied.select("session_id", "turn", F.lit(True).alias("_done"))
    return (rows.groupBy("session_id").applyInPandas(replay, OUTPUT).join(done, ["session_id", "turn"], "left")
            .filter("_done is null").select(*NAMES))


def read_analysed(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(OBSERVED)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{folder}/batch=*")


def evidence_rows(applied: DataFrame) -> DataFrame:
    """Evidence table of a finished stream, in the batch ledger's shape."""
    return applied.select("session_id", "turn", F.inline(F.from_json("added", ADDED))).select(
        "session_id", "turn", "seq", "phrase", "tier", "df")
