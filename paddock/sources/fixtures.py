"""Contest-domain views over the driver's star-schema tables.

Mapping (race = order, runner = line item, horse = part, track = customer's nation):
every view below is a lazy DataFrame over the parquet scans, so column pruning and
predicate pushdown reach the files. No row ever passes through the driver.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import make_race_id
from ..session import partitions_for, table_path

# Code lists the mapping cycles through by key modulo.
SEX_BY_PART_MOD5 = ["G", "F", "M", "C", "H"]
AGE_RESTRICTION_BY_ORDER_MOD4 = ["3U", "02", "34", None]
SEX_RESTRICTION_BY_ORDER_MOD5 = ["F", "B", "A", "D", None]
# Share of the purse paid to the first three finishers (career earnings).
PURSE_SHARE_BY_FINISH = {1: 0.6, 2: 0.2, 3: 0.1}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def _pick(values: list, index: F.Column) -> F.Column:
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(v) if v is not None else F.lit(None).cast("string")
        expr = F.when(index == i, lit) if expr is None else expr.when(index == i, lit)
    return expr


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a race's columns come from: its order and the customer's nation."""
    o = read(spark, sf_dir, "orders")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    r = o.join(c, o.o_custkey == c.c_custkey, "inner")
    return r.select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice", "c_nationkey")


def _race_columns() -> list[F.Column]:
    race_date = F.to_date("o_orderdate")
    track = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))
    k = F.col("o_orderkey")
    return [
        make_race_id(race_date, track, k).alias("race_id"),
        race_date.alias("race_date"),
        track.alias("track"),
        k.alias("race_number"),
        (F.lit(880) + F.lit(110) * (k % 12)).cast("bigint").alias("distance_yards"),
        F.when(F.col("o_orderstatus") == "O", "T").otherwise("D").alias("surface"),
        F.when(F.col("o_orderpriority") == "5-LOW", "Hurdle")
        .when(F.col("o_orderstatus") == "P", "All Weather Track")
        .when(F.col("o_orderstatus") == "O", "Turf")
        .otherwise("Dirt")
        .alias("course_desc"),
        F.col("o_totalprice").cast("double").alias("purse"),
        (F.lit(60) + F.floor(F.col("o_totalprice") / 1000) % 60).cast("double").alias("race_class_rating"),
        _pick(AGE_RESTRICTION_BY_ORDER_MOD4, k % 4).alias("age_restriction"),
        _pick(SEX_RESTRICTION_BY_ORDER_MOD5, k % 5).alias("sex_restriction"),
    ]


def races(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per race (order), with its track from the customer's nation."""
    return _orders(spark, sf_dir).select(*_race_columns())


def history_partitions(spark: SparkSession, sf_dir: str) -> int:
    """Partitions of the shuffles of all runners: they grow with the line items."""
    return partitions_for(spark, table_path(sf_dir, "lineitem"))


def _listed_parts(li: DataFrame, part: DataFrame) -> DataFrame:
    """A row per line item whose part is listed: its two keys, and the sizes the part is listed with.

    Nothing else of the line items is shuffled by part, however many parts there are.
    """
    sizes = part.groupBy("p_partkey").agg(F.collect_list(F.struct("p_size")).alias("sizes"))
    return li.select("l_orderkey", "l_partkey").join(sizes, F.col("l_partkey") == F.col("p_partkey"), "inner").drop("p_partkey")


def runner_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (race, horse) with race, outcome, odds and card columns.

    Line items are shuffled once by order key, together with what the part (horse) dimension
    has for them, and join their order (race); every
    per-race window -- the duplicate (order, part) filter that keeps the first line
    by (linenumber, suppkey, extendedprice, quantity), the runner count, post
    position and finish order -- is partitioned by that key, so they all reuse
    that one shuffle.
    """
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"
    )
    listed = _listed_parts(li, read(spark, sf_dir, "part")).withColumn("_line", F.lit(False))
    # the one shuffle of the line items: by order key. The order join (sort-merge at
    # scale, broadcast when orders are small) and every per-race window below reuse it.
    # The races' texts are made after it.
    li = li.withColumn("_line", F.lit(True)).unionByName(listed, allowMissingColumns=True)
    li = li.repartition(history_partitions(spark, sf_dir), "l_orderkey")
    sizes = F.first("sizes", ignorenulls=True).over(Window.partitionBy("l_orderkey", "l_partkey"))
    li = li.withColumn("sizes", sizes).where("_line").drop("_line")
    base = li.join(_orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"), "inner")

    first_line = Window.partitionBy("l_orderkey", "l_partkey").orderBy("l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity")
    base = base.withColumn("_dup", F.row_number().over(first_line)).where(F.col("_dup") == 1).drop("_dup")

    by_race = Window.partitionBy("l_orderkey")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    pk = F.col("l_partkey")
    base = base.select(
        "*",
        F.count(F.lit(1)).over(by_race).cast("bigint").alias("num_runners"),
        F.row_number().over(by_race.orderBy("l_linenumber", "l_partkey")).cast("bigint").alias("post_position"),
        F.row_number().over(by_race.orderBy(net.desc(), pk.asc())).cast("bigint").alias("official_finish"),
    )
    # runners without a listed part go after the race windows, which count them
    base = base.select("*", F.size("sizes").cast("bigint").alias("copies"), F.explode("sizes").alias("listed"))
    base = base.select("*", *_race_columns(), F.col("listed.p_size").alias("p_size"))
    return base.select(
        "race_id",
        "race_date",
        "track",
        "race_number",
        "distance_yards",
        "surface",
        "course_desc",
        "purse",
        "race_class_rating",
        "age_restriction",
        "sex_restriction",
        "num_runners",
        F.concat(F.lit("H"), pk.cast("string")).alias("horse_name"),
        "post_position",
        "official_finish",
        F.when((F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "N"), F.lit(0.0))
        .otherwise(F.col("l_quantity") / 2)
        .alias("dollar_odds"),
        (F.col("l_quantity") / 2 * (1 + F.col("l_discount") - F.col("l_tax"))).alias("morning_line_odds_float"),
        F.when(F.col("l_tax") > 0.075, F.lit(None).cast("double"))
        .otherwise(F.lit(50.0) + F.floor(F.col("l_extendedprice") / 2500))
        .alias("speed_figure"),
        (F.lit(112.0) + (F.col("l_suppkey") % 14)).alias("weight_carried"),
        (F.col("p_size") * 10).cast("double").alias("entry_class_rating"),
        _pick(SEX_BY_PART_MOD5, pk % 5).alias("sex"),
        (F.year("race_date") - 2 - (pk % 6)).cast("bigint").alias("year_of_birth"),
        "copies",
    )


def results(base: DataFrame) -> DataFrame:
    """Result-chart view (one row per runner), reference column names."""
    return base.select(
        "race_id",
        "race_date",
        "track",
        "race_number",
        "distance_yards",
        "surface",
        "course_desc",
        "num_runners",
        "horse_name",
        "post_position",
        "official_finish",
        "dollar_odds",
        "purse",
        F.col("race_class_rating").alias("class_rating"),
        F.col("speed_figure").alias("speed_rating"),
    )


def entries(runners: DataFrame) -> DataFrame:
    """Entry-card view (one row per runner) with career-to-date totals."""
    return runners.select(
        "race_id",
        "race_date",
        "track",
        "race_number",
        "horse_name",
        "morning_line_odds_float",
        "post_position",
        "weight_carried",
        F.col("entry_class_rating").alias("class_rating"),
        "purse",
        "year_of_birth",
        "sex",
        "age_restriction",
        "sex_restriction",
        "career_starts",
        "career_wins",
        "career_seconds",
        "career_thirds",
        "career_earnings",
        "surface_starts",
        "surface_wins",
        "surface_seconds",
        "surface_thirds",
    )


def earnings() -> F.Column:
    """A start's earnings, in whole currency units: integer sums are exact at any scale and in any order."""
    share = F.coalesce(
        *[F.when(F.col("official_finish") == k, F.lit(v)) for k, v in PURSE_SHARE_BY_FINISH.items()], F.lit(0.0)
    )
    return F.floor(F.col("purse") * share).cast("bigint").alias("earnings")


def runs_for_history(base: DataFrame) -> DataFrame:
    """Every start of every horse (all courses, all odds) as the history source."""
    return base.select(
        "race_id",
        "horse_name",
        "race_date",
        "race_number",
        "track",
        "surface",
        "distance_yards",
        "num_runners",
        "official_finish",
        "dollar_odds",
        "speed_figure",
        earnings(),
    )


def workouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workout rows per horse: line items flagged 'A' (date = ship date)."""
    li = read(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "A")
    return li.select(
        F.concat(F.lit("H"), F.col("l_partkey").cast("string")).alias("horse_name"),
        F.to_date("l_shipdate").alias("workout_date"),
        F.col("l_linenumber").cast("bigint").alias("workout_ranking"),
        (F.col("l_quantity").cast("int") % 12).cast("bigint").alias("workout_num_in_group"),
        F.col("l_orderkey").alias("wk_key1"),
        F.col("l_linenumber").cast("bigint").alias("wk_key2"),
    )


def card_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card-event log: odds ticks, scratches and unscratches keyed by (race, post)."""
    ev = read(spark, sf_dir, "events")
    kind = (
        F.when(F.col("event_type").isin("view", "click", "purchase"), "odds")
        .when(F.col("event_type") == "error", "scratch")
        .when(F.col("event_type") == "signup", "unscratch")
    )
    return ev.select(
        F.col("user_id").alias("race_key"),
        (F.col("event_id") % 8 + 1).cast("bigint").alias("post_position"),
        F.col("ts").alias("ts"),
        F.col("event_id").alias("seq"),
        kind.alias("kind"),
        F.when(kind == "odds", F.col("value") / 10).alias("live_odds"),
    )


def log_card(spark: SparkSession, sf_dir: str, base: DataFrame) -> DataFrame:
    """The cards behind the event log: runners and morning lines of the races it has events of."""
    keys = read(spark, sf_dir, "events").select(F.col("user_id").alias("race_key")).distinct()
    card = base.select(F.col("race_number").alias("race_key"), "post_position", F.col("morning_line_odds_float").alias("morning_line_odds"))
    return card.join(keys, "race_key", "left_semi")


def lifecycle_events(spark: SparkSession, sf_dir: str, card: DataFrame) -> DataFrame:
    """The event log with cards that come and go.

    Fixed rules: every fifth purchase creates the race (with its first three posts only, if
    the event's number is a multiple of 3), every fifth click deletes it, and a view with
    number 7 modulo 500 deletes all races.
    """
    ev = read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "event_type")
    n = F.col("seq")
    life = (
        F.when((F.col("event_type") == "view") & (n % 500 == 7), "delete_all")
        .when((F.col("event_type") == "purchase") & (n % 5 == 0), "create")
        .when((F.col("event_type") == "click") & (n % 5 == 1), "delete")
    )
    log = card_events(spark, sf_dir).join(ev.select("seq", life.alias("life")).where(F.col("life").isNotNull()), "seq", "left")
    posts = card.where("post_position <= 63").groupBy("race_key").agg(F.expr("bit_or(shiftleft(1L, int(post_position - 1)))").alias("posts"))
    log = log.join(posts, "race_key", "left")
    offered = F.when(n % 3 == 0, F.col("posts").bitwiseAND(F.lit(7))).otherwise(F.col("posts"))
    tick = F.col("life").isNull()
    return log.select(
        F.when(tick | (F.col("life") != "delete_all"), F.col("race_key")).alias("race_key"),
        F.when(tick, F.col("post_position")).alias("post_position"),
        "ts",
        "seq",
        F.coalesce("life", "kind").alias("kind"),
        F.when(tick, F.col("live_odds")).alias("live_odds"),
        F.when(F.col("life") == "create", offered).alias("card"),
    )


def odds_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's ticks as feed payloads: one per race and day, its runners in event order.

    Fixed rules: every other runner is a coupled entry ('2A'); odds come as a number, as a
    fraction, or only as the trend, by the event's number modulo 3.
    """
    ev = card_events(spark, sf_dir).where(F.col("kind") == "odds")
    n, dollars = F.col("seq"), F.col("live_odds").cast("string")
    program = F.concat(F.col("post_position").cast("string"), F.when(n % 2 == 0, "A").otherwise(""))
    odds = F.when(n % 3 == 0, F.concat(F.lit('"liveOdds": '), dollars)).when(
        n % 3 == 1, F.concat(F.lit('"liveOdds": "'), F.floor("live_odds").cast("string"), F.lit('/2"'))
    ).otherwise(F.concat(F.lit('"liveOdds": null, "oddsTrend": {"current": {"oddsNumeric": '), dollars, F.lit("}}")))
    runner = F.concat(F.lit('{"programNumber": "'), program, F.lit('", '), odds, F.lit("}"))
    day = F.to_date("ts")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", runner.alias("r")))), lambda x: x["r"])
    fetched = F.max("ts").cast("timestamp").alias("fetched_at")
    rows = ev.groupBy("race_key", day.alias("race_date")).agg(F.concat(F.lit('{"race": {"runners": ['), F.array_join(listed, ", "), F.lit("]}}")).alias("payload"), fetched)
    return rows


CARD_FEED = T.StructType([T.StructField("race_number", T.LongType()), T.StructField("race_date", T.DateType()), T.StructField("purse", T.DoubleType())])
ODDS_FEED = T.StructType([T.StructField("race_key", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("live_odds", T.DoubleType())])


def write_feeds(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Card lines (CSV, a folder per year) and odds lines (JSON, a folder per day) with defects.

    Fixed rules, by the order's number: 47 a line with too many fields, 43 no race number, 41 a
    purse that is no number; by the event's number: 37 a line that breaks off, 53 no race, 59
    odds that are no number; the first that fits.
    """
    o, n = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    number = F.when((n % 43 == 0) & (n % 47 != 0), F.lit("")).otherwise(n.cast("string"))
    purse = F.when(n % 41 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    line = F.concat_ws(",", number, F.to_date("o_orderdate").cast("string"), purse, F.when(n % 47 == 0, F.lit("one,two")))
    cards = o.select(F.year("o_orderdate").cast("string").alias("part"), line.alias("value"))
    # one header line a file: every partition's lines follow it
    lines = cards.repartition("part").sortWithinPartitions("part")
    lines.mapInPandas(_with_headers, "part string, value string").write.partitionBy("part").text(f"{root}/card")
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    race = F.when(k % 53 == 0, F.lit("null")).otherwise(F.col("user_id").cast("string"))
    odds = F.when(k % 59 == 0, F.lit('"none"')).otherwise(F.coalesce(F.col("value").cast("string"), F.lit("null")))
    text = F.format_string('{"race_key": %s, "seq": %d, "live_odds": %s}', race, k, odds)
    broken = F.format_string('{"race_key": %s, "seq":', race)
    e.select(F.to_date("ts").cast("string").alias("part"), F.when(k % 37 == 0, broken).otherwise(text).alias("value")).repartition("part").write.partitionBy(
        "part"
    ).text(f"{root}/odds")


def _with_headers(batches):
    seen = None
    for pdf in batches:
        for part, rows in pdf.groupby("part", sort=False):
            if part != seen:
                yield pd.DataFrame({"part": [part], "value": ["race_number,race_date,purse"]})
                seen = part
            yield rows


def overrides(base: DataFrame) -> DataFrame:
    """Override rows keyed by (race_id, post_position), derived by rule from every runner.

    Values: race class and post time per race, entry class, and speed figures (a
    blank overwrites too). Rule-based defects exercise the checks: the post-1
    runner of races with number % 97 == 0 has no override (missing key), races
    with number % 89 == 0 get an override for a post that does not exist (extra
    key), and post 2 of races with number % 53 == 0 disagrees on post time.
    """
    n = F.col("race_number")
    hour = F.lit(1) + n % 9
    minute = (n * 7) % 60
    post_time = F.format_string("%d:%02d PM", hour, minute)
    conflict = (n % 53 == 0) & (F.col("post_position") == 2)
    rows = base.where(~((n % 97 == 0) & (F.col("post_position") == 1))).select(
        "race_id",
        "race_number",
        "post_position",
        "horse_name",
        F.col("race_class_rating"),
        F.when(conflict, F.format_string("%d:%02d PM", hour, (minute + 1) % 60)).otherwise(post_time).alias("post_time"),
        F.when((F.col("post_position") == 3) & (n % 3 == 0), F.lit(None).cast("double")).otherwise(F.col("entry_class_rating")).alias("entry_class_rating"),
        F.col("speed_figure").alias("speed_fig_L1"),
        (F.col("speed_figure") - 2).alias("speed_fig_L2"),
        F.when(n % 4 == 0, F.lit(None).cast("double")).otherwise(F.col("speed_figure") - 4).alias("speed_fig_L3"),
    )
    extra = (
        base.where(n % 89 == 0)
        .groupBy("race_id", "race_number")
        .agg(F.max("num_runners").alias("_n"), F.max("race_class_rating").alias("race_class_rating"))
        .select(
            "race_id",
            "race_number",
            (F.col("_n") + 1).cast("bigint").alias("post_position"),
            F.lit(None).cast("string").alias("horse_name"),
            "race_class_rating",
            post_time.alias("post_time"),
            F.lit(None).cast("double").alias("entry_class_rating"),
            F.lit(None).cast("double").alias("speed_fig_L1"),
            F.lit(None).cast("double").alias("speed_fig_L2"),
            F.lit(None).cast("double").alias("speed_fig_L3"),
        )
    )
    return rows.unionByName(extra)
