"""The session state as a stream: the same fold, keyed by session and ordered by turn."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session long, turn long, n long"
KEPT = "last long, seen array<string>"


def running_distinct(turns: DataFrame, idle: str | None = None) -> DataFrame:
    """turns (session long, turn long, words array<string>), a stream: (session, turn, n) distinct words up to each turn.

    Rows of a batch are taken in order of turn; a turn at or before the last one is a repeat and is ignored. With `idle`
    (such as "1 hour") a session that stays idle for so long loses its state; a stream that is to end with its input takes
    none, for waiting for time-outs never ends."""
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, seen = state.get if state.exists else (None, [])
        known = set(seen)
        out = []
        rows = pd.concat(list(batches)).sort_values("turn", kind="stable")
        for turn, same in rows.groupby("turn", sort=True):
            if last is not None and turn <= last:
                continue
            for words in same["words"]:
                known.update(words)
            last = int(turn)
            out.append((key[0], last, len(known)))
        state.update((last, sorted(known)))
        if wait:
            state.setTimeoutDuration(wait)
        yield pd.DataFrame(out, columns=["session", "turn", "n"])

    return turns.groupBy("session").applyInPandasWithState(step, OUT, KEPT, "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


FOLDED = "session long, turn long, bucket string, constraints array<string>, opening array<string>, n_vocab long, asked int, late boolean"
STATE = "last long, bucket string, constraints array<string>, opening array<string>, vocab array<string>, asked int"


def folded(turns: DataFrame, idle: str | None = None) -> DataFrame:
    """turns (session long, turn long, words, kind, category, told, hint), a stream: the session state after each turn, as
    `operators.sessions.folded` has it in batch. `told` are the event's constraints.

    Rows of a batch are taken in order of turn. A turn at or before the session's last one changes nothing; it comes out
    marked `late`, with the state as it is. `idle` as for `running_distinct`."""
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, bucket, told, opening, vocab, asked = state.get if state.exists else (None, None, [], [], [], 0)
        told, opening, vocab, out = list(told), list(opening), dict.fromkeys(vocab), []
        for r in pd.concat(list(batches)).sort_values("turn", kind="stable").itertuples():
            late = last is not None and r.turn <= last
            if not late:
                new, over = [] if r.told is None else list(r.told), r.kind == "override"
                opens = r.kind == "opening" and r.category is not None and bucket is None
                if over:
                    told, vocab, asked = [c for c in told if c not in opening], {}, 0
                opening = [] if over else new if opens and r.hint == "intent_override" else opening
                bucket = r.category if opens else bucket
                told = list(dict.fromkeys([*told, *new]))
                vocab.update(dict.fromkeys(r.words))
                last, asked = int(r.turn), asked + 1
            out.append((key[0], r.turn, bucket, list(told), list(opening), len(vocab), asked, late))
        state.update((last, bucket, told, opening, list(vocab), asked))
        if wait:
            state.setTimeoutDuration(wait)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FOLDED.split(", ")])

    return turns.groupBy("session").applyInPandasWithState(step, FOLDED, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Beyond the session protocol: counts per event-time window and type, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
