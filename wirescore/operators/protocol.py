"""Protocol machines run over tables of events.

What a stretch of events does to a machine is a function: for each state it may be in before, the state after, or the first
event that is not allowed. Such functions are composed in any grouping, so a long session is cut into chunks by its order;
each chunk is folded by itself, for all states at once, and a session is then as many functions as it has chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Machine:
    """moves[state][kind] is the next state; a kind that is not there is not allowed. The first state is where a session
    begins. Kinds in worded must have a text, kinds in fatal end any session."""

    moves: dict[str, dict[str, str]]
    end: str
    worded: tuple[str, ...] = ()
    fatal: tuple[str, ...] = ()

    @property
    def states(self) -> list[str]:
        return list(self.moves)

    @property
    def kinds(self) -> list[str]:
        return list(dict.fromkeys([k for to in self.moves.values() for k in to] + [*self.worded, *self.fatal]))


#: The order of messages of a realtime session. A file upload is sent whole before the answer comes; in a
#: paced session the answer may begin while audio goes out.
REALTIME = Machine(
    {
        "new": {"session.created": "created"},
        "created": {"session.update": "updated"},
        "updated": {"commit": "sending"},
        "sending": {"append": "sending", "commit.final": "waiting"},
        "waiting": {"transcription.delta": "waiting", "transcription.done": "done"},
        "done": {},
    },
    "done", ("transcription.delta", "transcription.done"), ("error",),
)
PACED_REALTIME = Machine(REALTIME.moves | {"sending": REALTIME.moves["sending"] | {"transcription.delta": "sending"}}, "done", REALTIME.worded, REALTIME.fatal)


def _code(machine: Machine) -> Column:
    """The number of an event's kind; the one after the last for a kind that the machine does not know, and one more for a missing text."""
    known = F.array_position(F.array(*[F.lit(k) for k in machine.kinds]), F.col("kind"))
    code = F.when(F.coalesce(known, F.lit(0)) == 0, len(machine.kinds)).otherwise(known - 1)
    bare = F.col("kind").isin(*machine.worded) & F.col("text").isNull() if machine.worded else F.lit(False)
    return F.when(bare, len(machine.kinds) + 1).otherwise(code).cast("int")


def run_machine(events: DataFrame, machine: Machine, chunk: Column, item: str = "item", seq: str = "seq") -> DataFrame:
    """events (item, seq, kind, text): rows item, n_events, state (where the session stands, or stood at the first event that is
    not allowed), at_seq (the seq of that event), problem and finished. seq orders a session without ties; chunk must not fall as
    seq grows, and is what bounds the events that are folded in one place."""
    states, width = machine.states, len(machine.kinds) + 2
    moves = [states.index(machine.moves[s][k]) if k in machine.moves[s] else -1 for s in states for k in [*machine.kinds, None, None]]
    rows = events.select(F.col(item).alias("item"), F.col(seq).cast("bigint").alias("seq"), chunk.alias("chunk"), _code(machine).alias("k"))
    folded = rows.groupBy("item", "chunk").agg(F.sort_array(F.collect_list(F.struct("seq", "k"))).alias("events"))
    place = "array({})[s.state * {} + e.k]".format(", ".join(map(str, moves)), width)
    step = f"""transform(f, s -> case when s.at is not null then s
                                      when {place} >= 0 then named_struct('state', {place}, 'at', cast(null as bigint), 'k', cast(null as int))
                                      else named_struct('state', s.state, 'at', e.seq, 'k', e.k) end)"""
    start = "named_struct('state', {}, 'at', cast(null as bigint), 'k', cast(null as int))"
    each = f"transform(sequence(0, {len(states) - 1}), i -> {start.format('i')})"
    folded = folded.select("item", "chunk", F.size("events").alias("n"), F.expr(f"aggregate(events, {each}, (f, e) -> {step})").alias("f"))
    whole = folded.groupBy("item").agg(F.sum("n").alias("n_events"), F.sort_array(F.collect_list(F.struct("chunk", "f"))).alias("parts"))
    run = f"aggregate(parts, {start.format('0')}, (a, p) -> if(a.at is not null, a, p.f[a.state]))"
    done = whole.select("item", "n_events", F.expr(run).alias("r"))
    state = F.array(*[F.lit(s) for s in states])[F.col("r.state")]
    kind = F.array(*[F.lit(k) for k in [*machine.kinds, "an unknown event"]])[F.col("r.k")]
    problem = F.when(F.col("r.k") == width - 1, F.lit("text must be a string")).when(kind.isin(*machine.fatal), F.lit("the server reported an error")).otherwise(F.concat(kind, F.lit(" is not allowed when "), state))
    return done.select(
        "item", "n_events", state.alias("state"), F.col("r.at").alias("at_seq"), F.when(F.col("r.at").isNotNull(), problem).alias("problem"), (F.col("r.at").isNull() & (state == machine.end)).alias("finished")
    )


def transcripts(events: DataFrame, done: str = "transcription.done", delta: str = "transcription.delta", item: str = "item", seq: str = "seq") -> DataFrame:
    """events (item, seq, kind, text): item, deltas (all deltas in order) and text. The text of the first done event is what
    was said, whatever the deltas add up to; without one it is null."""
    at = F.when(F.col("kind") == done, F.col(seq))
    said = F.sort_array(F.collect_list(F.when(F.col("kind") == delta, F.struct(F.col(seq), F.coalesce("text", F.lit("")).alias("t")))))
    rows = events.groupBy(item).agg(F.min_by("text", at).alias("text"), said.alias("said"))
    return rows.select(item, F.array_join(F.transform("said", lambda s: s["t"]), "").alias("deltas"), "text")
