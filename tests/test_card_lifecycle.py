"""Cards that come and go: rules, batch fold, streams with typed state, scoring by batch, odds feed, snapshots."""

import datetime as dt
import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from paddock.operators import serving, snapshots
from paddock.plans.pipeline import Pipeline
from paddock.sources import files
from paddock.streaming import card_state, live_scoring, odds_feed
from paddock.streaming.card_state import NO_CARD, CardState, step

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)
EVENT = card_state.EVENT_SCHEMA


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def tmp():
    return tempfile.mkdtemp(prefix="paddock-life-")


def test_rules():
    s, ok, _ = step(NO_CARD, "create", None, 0b111)
    assert ok and s == CardState(1, 0b111, 0, True)
    assert step(s, "create", None, 0b111)[1:] == (False, "already exists")
    assert step(NO_CARD, "create", None, 0b100)[1:] == (False, "fewer than 2 runners") == step(NO_CARD, "create", None, None)[1:]
    assert step(NO_CARD, "odds", 1)[1:] == (False, "unknown race") == step(NO_CARD, "delete", None)[1:]
    m, ok, _ = step(s, "scratch", 1)
    assert ok and m.mask == 1
    assert step(m, "scratch", 2)[1:] == (False, "too few active runners")
    assert step(m, "scratch", 1)[1:] == (False, "already scratched")
    assert step(s, "unscratch", 2)[1:] == (False, "not scratched")
    assert step(m, "odds", 1)[1:] == (False, "scratched") and step(m, "odds", 2)[1]
    assert step(s, "odds", 4)[1:] == (False, "unknown post") == step(s, "odds", None)[1:] == step(s, "scratch", 64)[1:]
    assert step(s, None, 1)[1:] == (False, "unknown event")
    gone, ok, _ = step(m, "delete", None)
    assert ok and not gone.exists
    again, ok, _ = step(gone, "create", None, 0b11)
    assert ok and again == CardState(2, 0b11, 0, True)


def life_log(n=600, races=5, clears=True):
    rnd = random.Random(7)
    rows = []
    for i in range(n):
        kind = rnd.choices(["odds", "scratch", "unscratch", "create", "delete", "delete_all", "bogus", None], [8, 3, 2, 2, 1, 0.2 * clears, 0.2, 0.2])[0]
        key = None if kind == "delete_all" or rnd.random() < 0.02 else rnd.randrange(races)
        card = rnd.choice([0b11111, 0b101, 0b1, (1 << 62) | 0b11, None]) if kind == "create" else None
        post = rnd.choice([1, 2, 3, 4, 5, 9, 63, 64, None]) if kind not in ("create", "delete", "delete_all") else None
        rows.append((key, post, at(7 * (i // 3)), i, kind, rnd.uniform(1, 20) if kind == "odds" else None, card))
    return rows


def replay(rows, card):
    """The rules, one event after the other."""
    state = {}
    for key, posts in card.items():
        state[key], _, _ = step(NO_CARD, "create", None, sum(1 << (p - 1) for p in posts))
    out, odds = [], {}
    for key, post, ts, seq, kind, live, offered in rows:
        if kind == "delete_all":
            state = {k: s._replace(exists=False) for k, s in state.items()}
            continue
        s, ok, why = step(state.get(key, NO_CARD), kind, post, offered)
        state[key] = s
        out.append((seq, ok, why, s.exists, s.version, s.card, s.mask))
        if ok and kind == "odds":
            was = odds.get((key, s.version, post), (0, 0))
            odds[key, s.version, post] = (live, was[1] + 1)
    return sorted(out), state, odds


@pytest.mark.parametrize("batch_rows", ["10000", "7"])
def test_fold_equals_replay(spark, batch_rows):
    rows, card = life_log(), {0: [1, 2, 3], 1: [1, 2, 9], 2: [4], 7: [1, 2]}
    log = spark.createDataFrame(rows, EVENT)
    cards = spark.createDataFrame([(k, p, 1.0 * p) for k, ps in card.items() for p in ps], "race_key long, post_position long, morning_line_odds double")
    want, state, odds = replay(rows, card)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, batch_rows)
    try:
        folded = card_state.fold_events(log.repartition(4), cards).collect()
    finally:
        spark.conf.set(key, was)
    got = sorted((r["seq"], r["accepted"], r["reason"], r["exists_after"], r["version"], r["card_after"], r["mask_after"]) for r in folded if r["seq"] is not None)
    assert got == want
    n = sum(r[4] == "delete_all" for r in rows)
    latest = card_state.latest_state(card_state.fold_events(log, cards), cards, n).collect()
    expect = {}
    for k, s in state.items():
        for p in range(1, 64) if s.exists else ():
            if s.card >> (p - 1) & 1:
                live, ticks = odds.get((k, s.version, p), (None, 0))
                line = 1.0 * p if p in card.get(k, []) else None
                expect[k, p] = (live if ticks else line, ticks, bool(s.mask >> (p - 1) & 1), s.version)
    assert {(r["race_key"], r["post_position"]): (r["latest_odds"], r["n_ticks"], r["scratched"], r["version"]) for r in latest} == expect


def test_fold_of_an_empty_log(spark):
    log = spark.createDataFrame([], EVENT)
    assert card_state.fold_events(log).count() == 0


def write_in_order(spark, rows, path, size, schema=EVENT):
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(path)


def test_stream_over_many_triggers_equals_the_batch(spark):
    rows = [r for r in life_log(clears=False) if r[0] is not None]
    rows = [(k, None, T0, -1, "create", None, 0b111) for k in (0, 1)] + rows
    root = tmp()
    write_in_order(spark, rows, f"{root}/log", 120)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{root}/log")
    live_scoring.follow(stream, live_scoring.keep_state(f"{root}/out"), f"{root}/ckpt", late="1 day", idle="30 days")
    none = spark.createDataFrame([], "race_key long, post_position long, morning_line_odds double")
    batch = card_state.latest_state(card_state.fold_events(spark.createDataFrame(rows, EVENT)), none)
    columns = ["race_key", "version", "post_position", "latest_odds", "n_ticks", "scratched"]
    got = sorted((tuple(r) for r in live_scoring.current_rows(spark, f"{root}/out").select(*columns).collect()), key=repr)
    assert got == sorted((tuple(r) for r in batch.select(*columns).collect()), key=repr) and got
    assert spark.read.parquet(f"{root}/out/races").select("batch").distinct().count() > 1


def test_state_goes_when_a_race_is_over(spark):
    hour = 3600
    rows = [
        [(1, None, at(0), 0, "create", None, 0b11), (1, 1, at(5), 1, "odds", 4.0, None)],
        [(2, None, at(10 * hour), 2, "create", None, 0b11)],
        [(2, 1, at(10 * hour + 60), 3, "odds", 2.0, None)],
        [(1, 1, at(11 * hour), 4, "odds", 9.0, None), (2, 2, at(11 * hour), 5, "odds", 3.0, None)],
    ]
    root = tmp()
    for part in rows:
        write_in_order(spark, part, f"{root}/log", 10)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{root}/log")
    live_scoring.follow(stream, live_scoring.keep_state(f"{root}/out"), f"{root}/ckpt", late="10 minutes", idle="6 hours")
    got = {(r["race_key"], r["post_position"]): r["latest_odds"] for r in live_scoring.current_rows(spark, f"{root}/out").collect()}
    assert got == {(2, 1): 2.0, (2, 2): 3.0}  # race 1 was silent for too long: its late tick met no race


@pytest.fixture(scope="module")
def features(spark):
    return Pipeline(spark, SF).derived.cache()


def test_scoring_by_batch_and_its_replay(spark, features):
    keys = [r[0] for r in features.where("field_size >= 4").select("race_number").distinct().orderBy("race_number").limit(3).collect()]
    fields = {k: sorted(r[0] for r in features.where(F.col("race_number") == k).select("post_position").collect()) for k in keys}
    a, b, c = keys
    tick = lambda k, p, i: (k, p, at(60 + i), i, "odds", 2.0 + p, None)
    opened = [(k, None, T0, -1, "create", None, sum(1 << (p - 1) for p in fields[k])) for k in keys]
    first = opened + [tick(a, p, 10 + p) for p in fields[a]] + [tick(b, p, 30 + p) for p in fields[b]]
    second = [(a, fields[a][0], at(200), 100, "scratch", None, None), (b, None, at(201), 101, "delete", None, None), tick(c, fields[c][0], 202)]
    root = tmp()
    for part in (first, second):
        write_in_order(spark, part, f"{root}/log", 1000)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{root}/log")
    sink, seen = live_scoring.score_changed(features, f"{root}/out"), []

    def remember(batch, batch_id):
        seen.append((batch_id, batch.collect()))
        sink(batch, batch_id)

    live_scoring.follow(stream, remember, f"{root}/ckpt", late="1 day")
    rows = lambda: sorted((tuple(r) for r in live_scoring.current_rows(spark, f"{root}/out").drop("race_key").collect()), key=repr)
    got = rows()
    none = spark.createDataFrame([], "race_key long, post_position long, morning_line_odds double")
    state = card_state.latest_state(card_state.fold_events(spark.createDataFrame(first + second, EVENT)), none)
    want = serving.live_predictions(features, state)
    assert got == sorted((tuple(r) for r in want.collect()), key=repr) and got
    assert {r[0] for r in got} == {r["race_id"] for r in features.where(F.col("race_number") == a).collect()}
    for batch_id, held in seen:  # the same batch once more changes nothing
        if held:
            sink(spark.createDataFrame(held, card_state.STATE_SCHEMA), batch_id)
    assert rows() == got


def test_feed_stream_drops_late_and_repeated_payloads(spark):
    runner = lambda program, odds, trend=None: {"programNumber": program, "liveOdds": odds, "oddsTrend": {"current": {"oddsNumeric": trend, "oddsText": None}}}
    one = [runner("1", "5/2"), runner("1A", 9.0), runner("2B", None, 3.5), runner("2", 4), runner("x", 1), runner("3", "bad")]
    line = lambda key, seconds, payload: json.dumps({"race_key": key, "fetched_at": at(seconds).isoformat() + "Z", "payload": payload})
    parts = [
        [line(1, 0, one), line(1, 0, one), line(2, 10, {"race": {"runners": [runner("4", "EVEN")]}}), "no json", json.dumps({"race_key": 3})],
        [line(1, 0, one), line(1, 60, {"entries": [runner("1", 7)]})],
        [line(2, 7200, [runner("4", 2.5)])],
        [line(2, 7260, [runner("4", 3.5)])],
        [line(1, 120, [runner("5", 1.5)]), line(2, 7320, [])],  # the first one is two hours late
    ]
    root = tmp()
    for i, lines in enumerate(parts):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(f"{root}/feed")
    odds = odds_feed.stream_odds(odds_feed.read_feed(spark, f"{root}/feed", 1))
    q = (
        odds.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    got = sorted((r["race_key"], r["fetched_at"], r["post_position"], r["live_odds"]) for r in spark.read.parquet(f"{root}/out").collect())
    batch = odds_feed.envelopes(spark.read.text(f"{root}/feed")).where(F.col("fetched_at") != F.lit(at(120).isoformat() + "Z").cast("timestamp")).distinct()
    by_groups = files.parse_odds_payloads(batch)
    assert got == sorted((r["race_key"], r["fetched_at"], r["post_position"], r["live_odds"]) for r in by_groups.collect())
    assert [(k, p, o) for k, t, p, o in got] == [(1, 1, 2.5), (1, 2, 3.5), (1, 1, 7.0), (2, 4, 1.0), (2, 4, 2.5), (2, 4, 3.5)]
    ticks = odds_feed.as_ticks(spark.read.parquet(f"{root}/out"))
    card = spark.createDataFrame([(k, p) for k in (1, 2) for p in (1, 2, 4)], "race_key long, post_position long")
    assert card_state.fold_events(ticks, card).where("kind = 'odds' and accepted").count() == len(got)


def test_snapshots_are_published_once_and_whole(spark):
    root = tmp()
    assert snapshots.versions(spark, root) == []
    with pytest.raises(ValueError):
        snapshots.read_version(spark, root)
    assert snapshots.publish(spark.range(3), root, "000001") and not snapshots.publish(spark.range(9), root, "000001")
    spark.range(5).write.parquet(f"{root}/rows/version=000002")  # a writer that died before it published
    assert snapshots.read_version(spark, root).count() == 3
    assert snapshots.publish(spark.range(7), root, "000002") and snapshots.versions(spark, root) == ["000001", "000002"]
    assert snapshots.read_version(spark, root).count() == 7 and snapshots.read_version(spark, root, "000001").count() == 3
    assert {(r["version"], r["count"]) for r in snapshots.read_all(spark, root).groupBy("version").count().collect()} == {("000001", 3), ("000002", 7)}
