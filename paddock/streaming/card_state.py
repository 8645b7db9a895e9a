"""Live card state from an event log: create and delete, odds ticks, scratches.

Rules per race, applied in (ts, seq) order:
  * create: rejected while the race exists or when its card has fewer than 2 runners;
    otherwise the race gets that card, a new version, and nobody is scratched.
  * delete: the race is gone until it is created again. delete_all (no race key): so is
    every race.
  * anything else is rejected for a race that doesn't exist or a post that is not on its card.
  * scratch: rejected for an already scratched runner, or when fewer than 3 runners are
    active; otherwise the runner is scratched.
  * unscratch: rejected for a runner that is not scratched.
  * odds tick: applied to an active runner, skipped for a scratched one.

Batch: the event log is dealt out by race and sorted; ``mapInArrow`` streams batches
through the fold, keeping only the current race's state. Ticks change nothing, so only the
other events are stepped through one by one. No race's log is ever gathered into one
call, so a race with a huge log costs time, not memory.

Streaming: the same rules run in ``transformWithStateInPandas`` keyed by race. The
state is typed (the card with its scratches, a map of odds by post), and a timer drops it
when a race has been silent for long enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MIN_FIELD = 2  # fixed values: a card has at least 2 runners, and a race keeps as many
MIN_ACTIVE_TO_SCRATCH = 3
#: Cards are bit masks of their posts, 1 to 63.
MAX_POST = 63

EVENT_SCHEMA = "race_key bigint, post_position bigint, ts timestamp_ntz, seq bigint, kind string, live_odds double, card bigint"
FOLD_SCHEMA = (
    f"{EVENT_SCHEMA}, accepted boolean, reason string, exists_after boolean, version bigint, card_after bigint, mask_after bigint, "
    "scratched_after boolean, n_active_after bigint, cleared bigint"
)
KINDS = ["odds", "scratch", "unscratch", "create", "delete"]
NO_RACE = -(1 << 63)


class CardState(NamedTuple):
    """A race: how often it was created, its posts and the scratched ones as bit masks."""

    version: int
    card: int
    mask: int
    exists: bool


NO_CARD = CardState(0, 0, 0, False)


def step(s: CardState, kind: str | None, post: int | None, card: int | None = None) -> tuple[CardState, bool, str | None]:
    """One transition: (state, accepted, reason)."""
    if kind not in KINDS:
        return s, False, "unknown event"
    if kind == "create":
        if s.exists:
            return s, False, "already exists"
        if (card or 0).bit_count() < MIN_FIELD:
            return s, False, "fewer than 2 runners"
        return CardState(s.version + 1, card, 0, True), True, None
    if not s.exists:
        return s, False, "unknown race"
    if kind == "delete":
        return s._replace(exists=False), True, None
    bit = 1 << (post - 1) if post is not None and 1 <= post <= MAX_POST else 0
    if not s.card & bit:
        return s, False, "unknown post"
    scratched = bool(s.mask & bit)
    if kind == "scratch":
        if scratched:
            return s, False, "already scratched"
        if (s.card & ~s.mask).bit_count() < MIN_ACTIVE_TO_SCRATCH:
            return s, False, "too few active runners"
        return s._replace(mask=s.mask | bit), True, None
    if kind == "unscratch":
        if not scratched:
            return s, False, "not scratched"
        return s._replace(mask=s.mask & ~bit), True, None
    return s, not scratched, "scratched" if scratched else None


# --------------------------------------------------------------------------- batch


class _Clears:
    """The delete_all events, in order; how many of them come before others."""

    def __init__(self) -> None:
        self.at: list[tuple[int, int]] = []

    def before(self, ts: np.ndarray, seq: np.ndarray) -> np.ndarray:
        if not self.at:
            return np.zeros(len(ts), np.int64)
        c = np.array(self.at, np.int64)
        n = np.searchsorted(c[:, 0], ts, side="left")
        for i in np.nonzero(np.searchsorted(c[:, 0], ts, side="right") > n)[0].tolist():  # the same moment
            n[i] += int(((c[:, 0] == ts[i]) & (c[:, 1] < seq[i])).sum())
        return n


def _numbers(column: pa.Array, null: int = NO_RACE) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), null).to_numpy(zero_copy_only=False)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, part, clears, state, seen = None, None, _Clears(), NO_CARD, 0
    for whole in batches:
        parts = _numbers(whole.column("part"))
        is_clear = pc.fill_null(pc.equal(whole.column("kind"), "delete_all"), False).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.nonzero(parts[1:] != parts[:-1])[0] + 1).tolist(), len(parts)] if len(parts) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if parts[a] != part:
                part, clears, now = int(parts[a]), _Clears(), None
            batch, mine = whole.slice(a, b - a), is_clear[a:b]
            ts, seq = _numbers(batch.column("ts").cast(pa.timestamp("us"))), _numbers(batch.column("seq"))
            clears.at += list(zip(ts[mine].tolist(), seq[mine].tolist()))
            batch = batch.filter(pa.array(~mine))
            n = batch.num_rows
            if not n:
                continue
            ts, seq = ts[~mine], seq[~mine]
            key = _numbers(batch.column("race_key"))
            post, card = _numbers(batch.column("post_position"), 0), batch.column("card").to_pylist()
            kind = batch.column("kind").to_pylist()
            tick = np.array([k == "odds" for k in kind], bool)
            cleared = clears.before(ts, seq)
            turn = ~tick
            turn[0] = True
            turn[1:] |= (key[1:] != key[:-1]) | (cleared[1:] != cleared[:-1])
            exists, accepted = np.zeros(n, bool), np.zeros(n, bool)
            version, posts, mask = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            reason = np.full(n, None, object)
            places = np.nonzero(turn)[0].tolist()
            for i, until in zip(places, [*places[1:], n]):
                if key[i] != now:
                    now, state, seen = int(key[i]), NO_CARD, 0
                if cleared[i] != seen:
                    state, seen = state._replace(exists=False), int(cleared[i])
                if not tick[i]:
                    state, accepted[i], reason[i] = step(state, kind[i], int(post[i]), card[i])
                version[i:until], posts[i:until], mask[i:until], exists[i:until] = state
            bit = np.where((post >= 1) & (post <= MAX_POST), np.left_shift(1, np.clip(post - 1, 0, MAX_POST - 1)), 0)
            scratched, known = (mask & bit) != 0, (posts & bit) != 0
            accepted = np.where(tick, exists & known & ~scratched, accepted)
            why = np.select([~exists, ~known, scratched], ["unknown race", "unknown post", "scratched"], "")
            reason = [(w or None) if t else r for t, w, r in zip(tick.tolist(), why.tolist(), reason.tolist())]
            extra = [accepted, pa.array(reason, pa.string()), exists, version, posts, mask, scratched & exists, np.bitwise_count(posts & ~mask).astype(np.int64), cleared]
            names = [x.strip().split(" ")[0] for x in FOLD_SCHEMA.split(",")]
            own = batch.select(names[: batch.num_columns - 1])
            yield pa.RecordBatch.from_arrays([*own.columns, *[x if isinstance(x, pa.Array) else pa.array(x) for x in extra]], names)


def created(card: DataFrame) -> DataFrame:
    """Create events that open every race of ``card`` (race_key, post_position) before its log begins."""
    bit = F.expr("shiftleft(1L, int(post_position - 1))")
    posts = card.where(F.col("post_position").between(1, MAX_POST)).select("race_key", bit.alias("bit"))
    null = lambda t: F.lit(None).cast(t)
    return posts.groupBy("race_key").agg(F.bit_or("bit").alias("card")).select(
        "race_key", null("bigint").alias("post_position"), null("timestamp_ntz").alias("ts"), null("bigint").alias("seq"),
        F.lit("create").alias("kind"), null("double").alias("live_odds"), "card",
    )


def as_log(events: DataFrame) -> DataFrame:
    """The columns of ``EVENT_SCHEMA``; a log without create events has no ``card``."""
    card = F.col("card") if "card" in events.columns else F.lit(None)
    return events.select("race_key", "post_position", "ts", "seq", "kind", "live_odds", card.cast("bigint").alias("card"))


def fold_events(events: DataFrame, card: DataFrame | None = None) -> DataFrame:
    """Z3 + Z4 (+ Z1 tick acceptance): every event with its decision and the state after it.

    ``card``: runners (race_key, post_position) of races that exist before the log begins;
    their create events, with neither time nor number, are in the result too. Null times and
    numbers come first. Events without a race key are events of a race that doesn't exist.
    delete_all events reach every task as times; they have no rows of their own.
    """
    log = as_log(events)
    clears = log.where(F.col("kind") == "delete_all")
    races = log.where(F.col("kind").isNull() | (F.col("kind") != "delete_all"))
    if card is not None:
        races = created(card).unionByName(races)
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    races = races.withColumn("part", F.pmod(F.xxhash64("race_key"), F.lit(parts)).cast("int"))
    clears = clears.withColumn("race_key", F.lit(None).cast("bigint")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    order = ["part", F.coalesce(F.col("kind") != "delete_all", F.lit(True)), *[F.col(c).asc_nulls_first() for c in ("race_key", "ts", "seq")]]
    dealt = races.unionByName(clears).repartition("part").sortWithinPartitions(*order)
    return dealt.mapInArrow(_fold, FOLD_SCHEMA)


def posts_of(mask: Column) -> Column:
    """The posts of a bit mask, ascending."""
    return F.filter(F.sequence(F.lit(1).cast("bigint"), F.lit(MAX_POST).cast("bigint")), lambda p: mask.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), (p - 1).cast("int"))) != 0)


def latest_state(folded: DataFrame, card: DataFrame, clears: int = 0) -> DataFrame:
    """Z2 + Z3 + Z4: per runner of every race that exists after the log: the latest applied
    odds (the morning line of ``card`` by default), the number of ticks and the scratch flag.

    ``clears``: how many delete_all events the log has. Ticks count for the version of the
    card they were applied to.
    """
    order = F.struct("ts", "seq")
    last = folded.groupBy("race_key").agg(F.max_by(F.struct("exists_after", "version", "card_after", "mask_after", "cleared"), order).alias("s"))
    alive = last.where(F.col("s.exists_after") & (F.col("s.cleared") == clears)).select("race_key", "s.version", "s.card_after", "s.mask_after")
    runners = alive.withColumn("post_position", F.explode(posts_of(F.col("card_after"))))
    scratched = F.array_contains(posts_of(F.col("mask_after")), F.col("post_position"))
    ticks = folded.where((F.col("kind") == "odds") & F.col("accepted")).groupBy("race_key", "version", "post_position").agg(
        F.max_by("live_odds", order).alias("latest_odds"), F.count(F.lit(1)).alias("n_ticks")
    )
    return (
        runners.join(ticks, ["race_key", "version", "post_position"], "left")
        .join(card.select("race_key", "post_position", "morning_line_odds"), ["race_key", "post_position"], "left")
        .select(
            "race_key",
            "post_position",
            F.coalesce("latest_odds", "morning_line_odds").alias("latest_odds"),
            F.col("morning_line_odds").alias("default_odds"),
            F.coalesce("n_ticks", F.lit(0)).cast("bigint").alias("n_ticks"),
            scratched.alias("scratched"),
            "version",
        )
    )


def refresh_report(folded: DataFrame, window: str = "15 seconds") -> DataFrame:
    """Z5 + Z7 + J10: ticks grouped into refresh windows per race; a window applies the first
    tick per post (repeat reads inside the window reuse it). Reported are the applied posts,
    the posts skipped because the runner was scratched at that moment (or is not on the card),
    and the missing ones: on the card, not scratched after the window's last tick, and
    without a tick in the window."""
    ticks = folded.where(F.col("kind") == "odds").withColumn("w", F.window(F.col("ts").cast("timestamp"), window))
    active = F.when(F.col("exists_after"), F.col("card_after").bitwiseAND(F.bitwise_not("mask_after"))).otherwise(0)
    first = ticks.withColumn("active", active).groupBy("race_key", "w", "post_position").agg(
        F.min_by("accepted", F.struct("ts", "seq")).alias("applied"), F.max(F.struct("ts", "seq", "active")).alias("last")
    )
    out = first.groupBy("race_key", F.col("w.start").alias("window_start")).agg(
        F.sum(F.col("applied").cast("bigint")).alias("n_applied"),
        F.sum((~F.col("applied")).cast("bigint")).alias("n_skipped"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("applied"), F.col("post_position")))), ",").alias("applied_posts"),
        F.collect_list("post_position").alias("_ticked"),
        F.max("last")["active"].alias("_active"),
    )
    out = out.withColumn("_missing", F.array_except(posts_of(F.col("_active")), "_ticked"))
    return out.select(
        "race_key", "window_start", "n_applied", "n_skipped", "applied_posts",
        F.size("_missing").cast("bigint").alias("n_missing"), F.array_join("_missing", ",").alias("missing_posts"),
    )


# --------------------------------------------------------------------------- streaming

STATE_SCHEMA = "race_key bigint, exists boolean, version bigint, post_position bigint, latest_odds double, n_ticks bigint, scratched boolean"
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class CardProcessor(StatefulProcessor):
    """A race's card, scratches and latest odds as typed state, dropped by a timer ``idle_ms`` after its last event."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.race = handle.getValueState("race", "version bigint, card bigint, mask bigint, exists boolean, last_ms bigint")
        self.odds = handle.getMapState("odds", "post bigint", "live_odds double, n_ticks bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.race.get() if self.race.exists() else None
        state, last = (CardState(*held[:4]), held[4]) if held else (NO_CARD, None)
        odds = {k[0]: v for k, v in self.odds.iterator()} if held else {}
        # one trigger's events of this race, in log order
        events = pd.concat(list(rows), ignore_index=True)
        events["ts_ms"] = events["ts_ms"].fillna(0).astype("int64")
        events = events.sort_values(["ts_ms", "seq"], kind="stable", na_position="first")
        number = lambda x: None if pd.isna(x) else int(x)
        fresh = set()
        for e in events.itertuples(index=False):
            post = number(e.post_position)
            state, ok, _ = step(state, e.kind, post, number(e.card))
            if ok and e.kind == "odds":
                odds[post] = (float(e.live_odds), odds.get(post, (0.0, 0))[1] + 1)
                fresh.add(post)
            elif ok and e.kind in ("create", "delete"):
                odds, fresh = {}, set()
                self.odds.clear()
        for post in fresh:
            self.odds.updateValue((post,), odds[post])
        if last is not None:
            self.handle.deleteTimer(last + self.idle_ms)
        last = max(int(events["ts_ms"].max()), last or 0)
        self.handle.registerTimer(last + self.idle_ms)
        self.race.update((*state, last))
        names = [c.strip().split(" ")[0] for c in STATE_SCHEMA.split(",")]
        race = int(key[0])
        if not state.exists:
            yield pd.DataFrame([(race, False, state.version, None, None, None, None)], columns=names).astype(object)
            return
        posts = [p for p in range(1, MAX_POST + 1) if state.card >> (p - 1) & 1]
        out = [(race, True, state.version, p, *odds.get(p, (None, 0)), bool(state.mask >> (p - 1) & 1)) for p in posts]
        yield pd.DataFrame(out, columns=names).astype(object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.race.clear()
        self.odds.clear()
        yield pd.DataFrame({c.strip().split(" ")[0]: pd.Series(dtype=object) for c in STATE_SCHEMA.split(",")})

    def close(self) -> None:
        pass


def stream_card_state(events_stream: DataFrame, idle: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Z2 + Z3 + Z4 on a stream: after each trigger the runners of every race it changed.

    ``latest_odds`` is null and ``n_ticks`` 0 for a runner without a tick. A deleted race
    gives one row that says so. Events within one trigger are applied in (ts, seq) order,
    across triggers in arrival order; events later than ``late`` are dropped. ``idle`` after
    a race's last event its state goes: what comes later meets a race that doesn't exist. A
    keyed stream has no delete_all; send a delete to each race. The session needs
    Spark's RocksDB state store (``STATE_STORE``), which typed state lives in.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    log = as_log(events_stream).withColumn("ts", F.col("ts").cast("timestamp"))
    # masks travel as text: pandas would make numbers with nulls doubles
    log = log.withColumn("ts_ms", F.unix_millis("ts")).withColumn("card", F.col("card").cast("string")).withWatermark("ts", late)
    return log.groupBy("race_key").transformWithStateInPandas(CardProcessor(idle_ms), STATE_SCHEMA, "Update", "EventTime")


def _kept_ticks(seconds: float):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for pdf in pdfs:
            pdf = pdf.sort_values(["ts", "seq"], kind="stable")
            keep = []
            for at in pdf["ts"].astype("datetime64[us]").astype("int64"):
                fresh = last is None or at - last >= seconds * 1e6
                last = int(at) if fresh else last
                keep.append(fresh)
            yield pdf[keep]
        if last is not None:
            state.update((last,))

    return fn


def throttle_ticks(ticks_stream: DataFrame, seconds: float = 15.0) -> DataFrame:
    """A runner's tick is dropped within ``seconds`` of the last one that was kept, however far apart triggers are."""
    return ticks_stream.groupBy("race_key", "post_position").applyInPandasWithState(
        _kept_ticks(seconds), ticks_stream.schema, "last bigint", "Append", GroupStateTimeout.NoTimeout
    )
