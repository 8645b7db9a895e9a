"""File sources: result-chart XML, zipped card XML, positional CSV, odds JSON, CSVs.

(S1-S17.) Every feed is read with one parallel scan over a glob with an explicit
schema and parsed with column expressions on the executors -- never row dicts on
the driver. Unreadable records are kept in ``_corrupt_record`` (PERMISSIVE mode)
so a bad file is counted and quarantined instead of failing the whole load.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators.staging import check_override_columns

# Fixed value: finish codes from here on say why a horse did not finish.
NOT_FINISHED = 90

S = T.StringType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


def _text(c: str | Column) -> Column:
    """F5 on an XML element that may carry attributes (text lands in ``_VALUE``)."""
    return C.blank_to_null(C.col(c))


# --------------------------------------------------------------------------- S1/S2 result charts

_POC = _struct(_WHICH=S, POSITION=S, LENGTHS=S)
_PERSON = _struct(FIRST_NAME=S, LAST_NAME=S)
_ENTRY = _struct(
    NAME=S, PROGRAM_NUM=S, POST_POS=S, WEIGHT=S, AGE=S, SEX=_struct(CODE=S), MEDS=S, EQUIP=S, CLAIM_PRICE=S,
    DOLLAR_ODDS=S, OFFICIAL_FIN=S, FINISH_TIME=S, SPEED_RATING=S, COMMENT=S, DH_DQ_FLAGS=S, JOCKEY=_PERSON,
    TRAINER=_PERSON, WIN_PAYOFF=S, PLACE_PAYOFF=S, SHOW_PAYOFF=S, POINT_OF_CALL=T.ArrayType(_POC),
)
_RACE = _struct(
    _NUMBER=S, BREED=S, TYPE=S, COURSE_ID=S, COURSE_DESC=S, PURSE=S, DISTANCE=S, DIST_UNIT=S, RUNUPDIST=S,
    SURFACE=S, TRK_COND=S, WEATHER=S, CLASS_RATING=S, WIN_TIME=S, FRACTION_1=S, FRACTION_2=S, FRACTION_3=S,
    FRACTION_4=S, FRACTION_5=S, PACE_CALL1=S, PACE_CALL2=S, PACE_FINAL=S, FOOTNOTES=S, ENTRY=T.ArrayType(_ENTRY),
)
RESULT_CHART_SCHEMA = _struct(_RACE_DATE=S, TRACK=_struct(CODE=S), RACE=T.ArrayType(_RACE), _corrupt_record=S)


def read_result_charts(spark: SparkSession, path: str) -> DataFrame:
    """S1 + S2 + S17: one row per runner; race fields repeated; ``num_runners`` = entries.

    Races without a number are dropped. Points of call become a map keyed by the
    call (``final`` for FINAL) -> struct(position, lengths); ``point_of_call_wide``
    flattens it to ``point_of_call_{k}_{position,lengths}`` columns.
    """
    raw = (
        spark.read.format("xml").option("rowTag", "CHART").option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record").schema(RESULT_CHART_SCHEMA).load(path)
    )
    races = raw.where(F.col("_corrupt_record").isNull()).select(
        C.iso_date(F.col("_RACE_DATE")).alias("race_date"), _text("TRACK.CODE").alias("track"), F.explode("RACE").alias("r")
    )
    races = races.withColumn("race_number", C.safe_int("r._NUMBER")).where(F.col("race_number").isNotNull())
    runners = races.select("*", F.size("r.ENTRY").cast("bigint").alias("num_runners"), F.explode("r.ENTRY").alias("e"))
    dist_val, dist_unit = C.safe_int("r.DISTANCE"), _text("r.DIST_UNIT")
    calls = F.map_from_entries(
        F.transform(
            F.coalesce(F.col("e.POINT_OF_CALL"), F.array().cast(T.ArrayType(_POC))),
            lambda p: F.struct(
                F.when(p["_WHICH"] == "FINAL", F.lit("final")).otherwise(p["_WHICH"]).alias("key"),
                F.struct(C.safe_int(p["POSITION"]).alias("position"), _text(p["LENGTHS"]).alias("lengths")).alias("value"),
            ),
        )
    )
    return runners.select(
        C.make_race_id("race_date", "track", "race_number").alias("race_id"),
        "race_date", "track", "race_number",
        _text("r.BREED").alias("breed"), _text("r.TYPE").alias("race_type"), _text("r.COURSE_ID").alias("course_id"),
        _text("r.COURSE_DESC").alias("course_desc"), C.safe_int("r.RUNUPDIST").alias("run_up_distance"),
        C.safe_float("r.PURSE").alias("purse"), dist_val.alias("distance_val"), dist_unit.alias("distance_unit"),
        C.to_yards(dist_val, dist_unit).alias("distance_yards"), _text("r.SURFACE").alias("surface"),
        _text("r.TRK_COND").alias("track_condition"), _text("r.WEATHER").alias("weather"),
        C.safe_int("r.CLASS_RATING").alias("class_rating"), "num_runners", _text("r.WIN_TIME").alias("win_time"),
        *[C.safe_float(f"r.FRACTION_{k}").alias(f"fraction_{k}") for k in range(1, 6)],
        _text("r.PACE_CALL1").alias("pace_call_1"), _text("r.PACE_CALL2").alias("pace_call_2"),
        _text("r.PACE_FINAL").alias("pace_final"), _text("r.FOOTNOTES").alias("footnotes"),
        _text("e.NAME").alias("horse_name"), _text("e.PROGRAM_NUM").alias("program_number"),
        C.safe_int("e.POST_POS").alias("post_position"), C.safe_int("e.WEIGHT").alias("weight"),
        C.safe_int("e.AGE").alias("age"), _text("e.SEX.CODE").alias("sex"), _text("e.MEDS").alias("medication"),
        _text("e.EQUIP").alias("equipment"), C.safe_float("e.CLAIM_PRICE").alias("claim_price"),
        C.safe_float("e.DOLLAR_ODDS").alias("dollar_odds"), C.safe_int("e.OFFICIAL_FIN").alias("official_finish"),
        _text("e.FINISH_TIME").alias("finish_time"), C.safe_int("e.SPEED_RATING").alias("speed_rating"),
        _text("e.COMMENT").alias("comment"), _text("e.DH_DQ_FLAGS").alias("dh_dq_flags"),
        _text("e.JOCKEY.FIRST_NAME").alias("jockey_first_name"), _text("e.JOCKEY.LAST_NAME").alias("jockey_last_name"),
        _text("e.TRAINER.FIRST_NAME").alias("trainer_first_name"), _text("e.TRAINER.LAST_NAME").alias("trainer_last_name"),
        C.safe_float("e.WIN_PAYOFF").alias("win_payoff"), C.safe_float("e.PLACE_PAYOFF").alias("place_payoff"),
        C.safe_float("e.SHOW_PAYOFF").alias("show_payoff"), calls.alias("point_of_call"),
    )


def point_of_call_wide(results: DataFrame) -> DataFrame:
    """Widen the call map to columns; keys come from the data (distinct map keys)."""
    keys = [r[0] for r in results.select(F.explode(F.map_keys("point_of_call"))).distinct().orderBy(1).collect()]  # a handful of call names
    cols = []
    for k in keys:
        cols += [F.col("point_of_call")[k]["position"].alias(f"point_of_call_{k}_position"), F.col("point_of_call")[k]["lengths"].alias(f"point_of_call_{k}_lengths")]
    return results.select("*", *cols)


def quarantine(spark: SparkSession, path: str, row_tag: str = "CHART") -> DataFrame:
    """Records that could not be parsed, with their source file, for an error count."""
    raw = (
        spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record").schema(RESULT_CHART_SCHEMA).load(path)
    )
    return raw.where(F.col("_corrupt_record").isNotNull()).select(F.input_file_name().alias("file"), "_corrupt_record")


# --------------------------------------------------------------------------- S3-S7 zipped card XML

_V = _struct(Value=S)
_DIST = _struct(DistanceId=S, DistanceUnit=_V)
_CARD_POC = _struct(PointOfCall=S, Position=S, LengthsBehind=S)
_START = _struct(
    PostPosition=S, OfficialFinish=S, SpeedFigure=S, Odds=S, WeightCarried=S, ClassRating=S,
    PointOfCall=T.ArrayType(_CARD_POC),
)
_PP = _struct(
    RaceDate=S, Track=_struct(TrackID=S), RaceNumber=S, Distance=_DIST, Course=_struct(CourseType=_V),
    NumberOfStarters=S, PurseUSA=S, Start=_START,
)
_WORKOUT = _struct(Date=S, Track=_struct(TrackID=S), Distance=_DIST, Timing=S, Ranking=S, NumberInRankingGroup=S)
_SUMMARY = _struct(NumberOfStarts=S, NumberOfWins=S, NumberOfSeconds=S, NumberOfThirds=S, EarningsUSA=S, Surface=_V)
_STARTER = _struct(
    Horse=_struct(HorseName=S, RegistrationNumber=S, YearOfBirth=S, Sex=_V), PostPosition=S, ProgramNumber=S,
    Odds=S, WeightCarried=S, TodaysHorseClassRating=S, PastPerformance=T.ArrayType(_PP),
    Workout=T.ArrayType(_WORKOUT), RaceSummary=T.ArrayType(_SUMMARY),
)
_CARD_RACE = _struct(
    RaceNumber=S, Distance=_DIST, Course=_struct(CourseType=_V), PurseUSA=S, NumberOfRunners=S,
    AgeRestriction=_V, SexRestriction=_V, Starters=T.ArrayType(_STARTER),
)
CARD_SCHEMA = _struct(RaceDate=S, Track=_struct(TrackID=S), Race=T.ArrayType(_CARD_RACE))


def _unzip_first_member(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts, errors = [], []
        for blob in pdf["content"]:
            text = error = None
            try:
                with zipfile.ZipFile(io.BytesIO(bytes(blob))) as zf:
                    text = zf.read(zf.namelist()[0]).decode("utf-8")
            except (zipfile.BadZipFile, zlib.error, EOFError, IndexError, UnicodeDecodeError, RuntimeError, NotImplementedError) as e:
                error = f"{type(e).__name__}: {e}"
            texts.append(text)
            errors.append(error)
        yield pd.DataFrame({"path": pdf["path"], "xml": texts, "error": errors})


def read_card_zips(spark: SparkSession, path_glob: str) -> DataFrame:
    """S3: the first member of every ZIP, parsed with ``from_xml`` into one card row per file.

    A file that can't be unpacked gives a row with a null card and its ``error``.
    """
    blobs = spark.read.format("binaryFile").load(path_glob).select("path", "content")
    xml = blobs.mapInPandas(_unzip_first_member, "path string, xml string, error string")
    return xml.select("path", F.from_xml("xml", CARD_SCHEMA).alias("card"), "error")


def read_card_xml(spark: SparkSession, path: str, row_tag: str = "EntryRaceCard") -> DataFrame:
    """Plain (unzipped) card XML goes straight to the XML source."""
    df = spark.read.format("xml").option("rowTag", row_tag).schema(CARD_SCHEMA).load(path)
    return df.select(F.input_file_name().alias("path"), F.struct(*df.columns).alias("card"))


def card_starters(cards: DataFrame) -> DataFrame:
    """Explode cards to one row per starter with race fields (internal helper for S3-S7)."""
    c = cards.select(C.iso_date("card.RaceDate").alias("race_date"), _text("card.Track.TrackID").alias("track"), F.explode("card.Race").alias("r"))
    c = c.withColumn("race_number", C.safe_int("r.RaceNumber")).where(F.col("race_number").isNotNull())
    c = c.withColumn("race_id", C.make_race_id("race_date", "track", "race_number"))
    return c.select("*", F.explode("r.Starters").alias("s"))


def card_entries(starters: DataFrame) -> DataFrame:
    """S3 + S7 + F7: one row per entry with career and today's-surface totals."""
    surface = _text("r.Course.CourseType.Value")
    summ = F.coalesce(F.col("s.RaceSummary"), F.array().cast(T.ArrayType(_SUMMARY)))

    def total(field: str, only_surface: bool = False, as_float: bool = False) -> Column:
        zero = F.lit(0.0) if as_float else F.lit(0).cast("bigint")
        conv = C.safe_float if as_float else C.safe_int
        return F.aggregate(
            summ, zero,
            lambda acc, x: acc + F.when(F.lit(not only_surface) | (_text(x["Surface"]["Value"]) == surface), F.coalesce(conv(x[field]), zero)).otherwise(zero),
        )

    career = {k: total(f) for k, f in [("career_starts", "NumberOfStarts"), ("career_wins", "NumberOfWins"), ("career_seconds", "NumberOfSeconds"), ("career_thirds", "NumberOfThirds")]}
    surf = {k: total(f, True) for k, f in [("surface_starts", "NumberOfStarts"), ("surface_wins", "NumberOfWins"), ("surface_seconds", "NumberOfSeconds"), ("surface_thirds", "NumberOfThirds")]}
    dist_val, dist_unit = C.safe_int("r.Distance.DistanceId"), _text("r.Distance.DistanceUnit.Value")
    raw_class = C.safe_int("s.TodaysHorseClassRating")
    df = starters.select(
        "race_id", "race_date", "track", "race_number", surface.alias("surface"),
        C.to_yards(dist_val, dist_unit).alias("distance_yards"), C.safe_float("r.PurseUSA").alias("purse"),
        _text("r.AgeRestriction.Value").alias("age_restriction"), _text("r.SexRestriction.Value").alias("sex_restriction"),
        _text("s.Horse.HorseName").alias("horse_name"), _text("s.Horse.RegistrationNumber").alias("registration_number"),
        C.safe_int("s.Horse.YearOfBirth").alias("year_of_birth"), _text("s.Horse.Sex.Value").alias("sex"),
        C.safe_int("s.PostPosition").alias("post_position"), _text("s.ProgramNumber").alias("program_number"),
        _text("s.Odds").alias("morning_line_odds"), C.parse_odds("s.Odds").alias("morning_line_odds_float"),
        C.safe_int("s.WeightCarried").alias("weight_carried"), (raw_class / 10).alias("class_rating"),
        total("EarningsUSA", as_float=True).alias("_earn"),
        *[v.alias(k) for k, v in {**career, **surf}.items()],
    )
    has = F.col("career_starts") > 0
    has_s = F.col("surface_starts") > 0
    out = df.withColumns({k: F.when(has, F.col(k)) for k in career}).withColumn("career_earnings", F.when(has, F.col("_earn")))
    return out.withColumns({k: F.when(has_s, F.col(k)) for k in surf}).drop("_earn")


def card_past_performances(starters: DataFrame) -> DataFrame:
    """S4 + S5 + F7: PP rows, newest first (null dates last), ``pp_index`` from 1."""
    pp = starters.select("race_id", _text("s.Horse.HorseName").alias("horse_name"), _text("s.Horse.RegistrationNumber").alias("registration_number"), F.posexplode("s.PastPerformance").alias("_pos", "p"))
    finish = C.safe_int("p.Start.OfficialFinish")
    speed = C.safe_int("p.Start.SpeedFigure")
    cls = C.safe_int("p.Start.ClassRating")
    calls = F.coalesce(F.col("p.Start.PointOfCall"), F.array().cast(T.ArrayType(_CARD_POC)))

    def call(which: str, field: str) -> Column:
        hit = F.try_element_at(F.filter(calls, lambda x: _text(x["PointOfCall"]) == which), F.lit(1))
        return F.nullif(C.safe_int(hit[field]), F.lit(0))

    dist_val, dist_unit = C.safe_int("p.Distance.DistanceId"), _text("p.Distance.DistanceUnit.Value")
    df = pp.select(
        "race_id", "horse_name", "registration_number", "_pos",
        C.iso_date("p.RaceDate").alias("pp_race_date"), _text("p.Track.TrackID").alias("pp_track"),
        C.safe_int("p.RaceNumber").alias("pp_race_number"), C.to_yards(dist_val, dist_unit).alias("pp_distance_yards"),
        _text("p.Course.CourseType.Value").alias("pp_surface"), F.nullif(C.safe_int("p.NumberOfStarters"), F.lit(0)).alias("pp_num_starters"),
        C.safe_float("p.PurseUSA").alias("pp_purse"), C.safe_int("p.Start.PostPosition").alias("pp_post_position"),
        F.when(finish < NOT_FINISHED, finish).alias("pp_official_finish"),
        F.when(~speed.isin(0, 9999), F.floor(speed / 10)).cast("bigint").alias("pp_speed_figure"),
        C.parse_odds("p.Start.Odds").alias("pp_odds"), C.safe_int("p.Start.WeightCarried").alias("pp_weight_carried"),
        F.when(~cls.isin(0, 9999), cls / 10).alias("pp_class_rating"),
        call("S", "Position").alias("pp_poc_start_pos"), call("F", "Position").alias("pp_poc_final_pos"),
        call("F", "LengthsBehind").alias("pp_poc_final_behind"),
        *[call(str(k), "Position").alias(f"pp_poc_{k}_pos") for k in range(1, 6)],
    )
    from pyspark.sql import Window

    w = Window.partitionBy("race_id", "horse_name", "registration_number").orderBy(F.col("pp_race_date").desc_nulls_last(), "_pos")
    return df.withColumn("pp_index", F.row_number().over(w).cast("bigint")).drop("_pos")


def card_workouts(starters: DataFrame) -> DataFrame:
    """Workout rows; rank and group size arrive as text and are cast safely."""
    wk = starters.select("race_id", _text("s.Horse.HorseName").alias("horse_name"), F.explode("s.Workout").alias("w"))
    return wk.select(
        "race_id", "horse_name", C.iso_date("w.Date").alias("workout_date"), _text("w.Track.TrackID").alias("workout_track"),
        _text("w.Timing").alias("workout_time"), C.safe_int("w.Ranking").cast("int").alias("workout_ranking"),
        C.safe_int("w.NumberInRankingGroup").cast("int").alias("workout_num_in_group"),
    )


# --------------------------------------------------------------------------- S8-S10 positional CSV

N_POSITIONAL_FIELDS = 1435
POSITIONAL_SCHEMA = T.StructType([T.StructField(f"_c{i}", S, True) for i in range(N_POSITIONAL_FIELDS)])
# Age-class letter -> (min age, max age); sex-restriction char -> code.
AGE_CLASS_RANGES = {"A": (2, 2), "B": (3, 3), "C": (4, 4), "D": (5, 5), "E": (3, 4), "F": (4, 5), "G": (3, 5), "H": (2, 99)}
SEX_RESTRICTION_MAP = {"N": None, "M": "B", "C": "A", "F": "F"}
VALID_SEX_CODES = ["G", "F", "M", "C", "H", "R", "B"]


def field(n: int) -> Column:
    """1-based positional field; a missing field reads as empty text."""
    return F.coalesce(F.col(f"_c{n - 1}"), F.lit(""))


def read_positional_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every row of the 1435-field CSV with a generated all-string schema."""
    return spark.read.option("mode", "PERMISSIVE").option("header", False).schema(POSITIONAL_SCHEMA).csv(path)


def age_restriction_code(code: Column) -> Column:
    """3-char age/sex code -> 2-char restriction ('BUM' -> '3U', 'BON' -> '03', 'EON' -> '34')."""
    c = F.trim(code)
    cls, mode = F.substring(c, 1, 1), F.substring(c, 2, 1)
    out = None
    for k, (lo, hi) in AGE_CLASS_RANGES.items():
        open_ended = F.lit(f"{lo}U")
        only = F.lit(f"0{lo}" if lo == hi else f"{lo}{hi}")
        val = F.when((mode == "U") | F.lit(hi >= 99), open_ended).when(mode == "O", only)
        out = F.when(cls == k, val) if out is None else out.when(cls == k, val)
    return F.when(F.length(c) >= 2, out)


def sex_restriction_code(code: Column) -> Column:
    """third char N -> null, M -> B, C -> A, F -> F."""
    ch = F.substring(F.trim(code), 3, 1)
    out = None
    for k, v in SEX_RESTRICTION_MAP.items():
        lit = F.lit(v) if v is not None else F.lit(None).cast("string")
        out = F.when(ch == k, lit) if out is None else out.when(ch == k, lit)
    return F.when(F.length(F.trim(code)) >= 3, out)


def positional_entries(rows: DataFrame) -> DataFrame:
    """S8 + F8-F14: entry columns from the positional fields."""
    surface = F.when(F.trim(field(7)).isin("D", "d"), "D").when(F.trim(field(7)).isin("T", "t"), "T")
    race_date = C.yyyymmdd_date(field(2))
    race_number = C.csv_int(field(3))
    turf = [C.csv_int(field(n)) for n in (75, 76, 77, 78)]
    names = ["surface_starts", "surface_wins", "surface_seconds", "surface_thirds"]
    surf_stats = {
        nm: F.when(surface == "T", turf[i]).when(surface == "D", C.sub_nonneg(C.csv_int(field(97 + i)), C.csv_int(field(75 + i))))
        for i, nm in enumerate(names)
    }
    sex = F.upper(F.trim(field(49)))
    yy = C.csv_int(field(46))
    return rows.select(
        C.make_race_id(race_date, F.trim(field(1)), F.coalesce(race_number, F.lit(0))).alias("race_id"),
        race_date.alias("race_date"), F.trim(field(1)).alias("track"), race_number.alias("race_number"),
        C.csv_abs_int(field(6)).alias("distance_yards"), surface.alias("surface"),
        F.when(F.trim(field(25)) == "A", "All Weather Track").alias("course_desc"), C.safe_float(field(12)).alias("purse"),
        age_restriction_code(field(10)).alias("age_restriction"), sex_restriction_code(field(10)).alias("sex_restriction"),
        F.trim(field(45)).alias("horse_name"), F.coalesce(F.nullif(C.csv_int(field(58)), F.lit(0)), C.csv_int(field(4))).alias("post_position"),
        C.blank_to_null(field(44)).alias("morning_line_odds"), C.safe_float(field(44)).alias("morning_line_odds_float"),
        C.csv_int(field(51)).alias("weight_carried"), F.when(yy.isNotNull(), yy + 2000).alias("year_of_birth"),
        F.when(sex.isin(VALID_SEX_CODES), sex).alias("sex"),
        C.csv_int(field(97)).alias("career_starts"), C.csv_int(field(98)).alias("career_wins"),
        C.csv_int(field(99)).alias("career_seconds"), C.csv_int(field(100)).alias("career_thirds"),
        C.safe_float(field(101)).alias("career_earnings"),
        *[v.alias(k) for k, v in surf_stats.items()],
        (F.trim(field(5)) == "S").alias("feed_scratched"),
    )


def _finish(text: Column) -> Column:
    """A finish position; codes of ``NOT_FINISHED`` and more mean that the horse didn't finish."""
    place = C.csv_int(text)
    return F.when(place < NOT_FINISHED, place)


def positional_past_performances(rows: DataFrame) -> DataFrame:
    """10 PP slots from parallel field blocks, empty dates skipped, pp_index = slot."""
    race_id = C.make_race_id(C.yyyymmdd_date(field(2)), F.trim(field(1)), F.coalesce(C.csv_int(field(3)), F.lit(0)))
    slots = F.array(*[
        F.struct(
            F.lit(i + 1).cast("bigint").alias("pp_index"), C.yyyymmdd_date(field(256 + i)).alias("pp_race_date"),
            C.csv_abs_int(field(316 + i)).alias("pp_distance_yards"), C.blank_to_null(field(326 + i)).alias("pp_surface"),
            C.csv_int(field(346 + i)).alias("pp_num_starters"), _finish(field(616 + i)).alias("pp_official_finish"),
            C.csv_int(field(846 + i)).alias("pp_speed_figure"), C.safe_float(field(516 + i)).alias("pp_odds"),
            C.csv_int(field(1167 + i)).alias("pp_class_rating"),
        )
        for i in range(10)
    ])
    out = rows.select(race_id.alias("race_id"), F.trim(field(45)).alias("horse_name"), F.explode(slots).alias("p"))
    return out.where(F.col("p.pp_race_date").isNotNull()).select("race_id", "horse_name", "p.*")


def positional_workouts(rows: DataFrame) -> DataFrame:
    """12 workout slots (date / group size / rank blocks), empty dates skipped."""
    race_id = C.make_race_id(C.yyyymmdd_date(field(2)), F.trim(field(1)), F.coalesce(C.csv_int(field(3)), F.lit(0)))
    slots = F.array(*[
        F.struct(
            C.yyyymmdd_date(field(102 + i)).alias("workout_date"), C.csv_int(field(198 + i)).alias("workout_ranking"),
            C.csv_int(field(186 + i)).alias("workout_num_in_group"),
        )
        for i in range(12)
    ])
    out = rows.select(race_id.alias("race_id"), F.trim(field(45)).alias("horse_name"), F.explode(slots).alias("w"))
    return out.where(F.col("w.workout_date").isNotNull()).select("race_id", "horse_name", "w.*")


# --------------------------------------------------------------------------- S12-S15 small CSV / JSON feeds

OVERRIDES_SCHEMA = _struct(
    race_id=S, race_number=T.LongType(), post_position=T.LongType(), horse_name=S, race_class_rating=T.DoubleType(),
    post_time=S, entry_class_rating=T.DoubleType(), speed_fig_L1=T.DoubleType(), speed_fig_L2=T.DoubleType(), speed_fig_L3=T.DoubleType(),
)


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Overrides CSV with a header; the required columns are checked up front."""
    header = spark.read.option("header", True).csv(path).columns
    check_override_columns(header)
    fields = [f for f in OVERRIDES_SCHEMA.fields if f.name in header]
    return spark.read.option("header", True).option("enforceSchema", False).schema(T.StructType(fields)).csv(path)


def read_staged(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Staged CSV; blank cells are null; dates parsed by the schema."""
    return spark.read.option("header", True).option("nullValue", "").option("dateFormat", "yyyy-MM-dd").schema(schema).csv(path)


def read_track_codes(spark: SparkSession, path: str) -> DataFrame:
    """Track-code export (country, id, name, state); header skipped, rows without id dropped."""
    schema = _struct(country=S, track_id=S, track_name=S, state=S)
    return spark.read.option("header", True).schema(schema).csv(path).where(C.blank_to_null("track_id").isNotNull())


#: Live odds come as a JSON number or as text, which mean different things.
_FEED_RUNNER = _struct(programNumber=S, liveOdds=T.VariantType(), oddsTrend=_struct(current=_struct(oddsNumeric=T.DoubleType(), oddsText=S)))
_FEED_LIST = T.ArrayType(_FEED_RUNNER)
_FEED = _struct(
    runners=_FEED_LIST, entries=_FEED_LIST, raceEntries=_FEED_LIST,
    race=_struct(runners=_FEED_LIST, entries=_FEED_LIST, raceEntries=_FEED_LIST),
)


def _feed_runners(text_col: str) -> Column:
    t = F.trim(F.col(text_col))
    as_list = F.from_json(F.when(t.startswith("["), t), _FEED_LIST)
    obj = F.from_json(F.when(t.startswith("{"), t), _FEED)
    return F.coalesce(as_list, obj["runners"], obj["entries"], obj["raceEntries"], obj["race"]["runners"], obj["race"]["entries"], obj["race"]["raceEntries"])


def _feed_odds(runner: Column) -> Column:
    raw = runner["liveOdds"]
    of_type = F.schema_of_variant(raw)
    number = F.when(of_type.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(raw, "$", "double"))
    words = F.when(of_type == "STRING", F.try_variant_get(raw, "$", "string"))
    return C.live_odds_choice(number, words, runner["oddsTrend"]["current"]["oddsNumeric"])


def payload_odds(text_col: str) -> Column:
    """A payload's odds as an array of (post_position, live_odds), without grouping rows.

    The rules are those of ``parse_odds_payloads``: offers are sorted by post, then by their
    place in the payload, and the first one of a post stays.
    """
    offer = lambda r, i: F.struct(C.parse_program_number(r["programNumber"]).alias("post_position"), i.alias("i"), _feed_odds(r).alias("live_odds"))
    offers = F.filter(F.transform(_feed_runners(text_col), offer), lambda x: x["post_position"].isNotNull() & x["live_odds"].isNotNull())
    ordered = F.array_sort(offers)
    none = F.array(F.lit(None).cast("struct<post_position:bigint,i:int,live_odds:double>"))
    fresh = lambda x, before: x.isNotNull() & ~x["post_position"].eqNullSafe(before["post_position"])
    firsts = F.zip_with(ordered, F.concat(none, ordered), lambda x, before: F.when(fresh(x, before), F.struct(x["post_position"], x["live_odds"])))
    return F.array_compact(firsts)


def parse_odds_payloads(payloads: DataFrame, text_col: str = "payload") -> DataFrame:
    """S15 + Z1 + F15-F17: odds per (payload, post) from JSON text.

    A payload is a bare list of runners, or has them under runners / entries /
    raceEntries, at the top or under ``race``. Coupled entries ('1', '1A') collapse
    to one post; the first runner with parseable odds wins. A number is odds as it is, text
    must be a fraction or EVEN; else the trend's number counts, and without it the runner is left out.
    """
    runners = _feed_runners(text_col)
    ex = payloads.select("*", F.posexplode(runners).alias("_i", "_r"))
    odds = _feed_odds(F.col("_r"))
    rows = ex.select(*payloads.columns, "_i", C.parse_program_number("_r.programNumber").alias("post_position"), odds.alias("live_odds"))
    rows = rows.where(F.col("post_position").isNotNull() & F.col("live_odds").isNotNull())
    keys = [c for c in payloads.columns if c != text_col]
    return rows.groupBy(*keys, "post_position").agg(F.min_by("live_odds", "_i").alias("live_odds"))


def read_odds_feed(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file (whole file as text), parsed with ``parse_odds_payloads``."""
    docs = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("source"), F.col("value").alias("payload"))
    return parse_odds_payloads(docs)
