"""File sources on small hand-written files (the driver tables hold no XML/CSV/JSON)."""

import datetime as dt
import io
import os
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from paddock.sources import files

DATA = os.path.join(os.path.dirname(__file__), "data")


def test_result_chart_xml(spark):
    rows = {r["horse_name"]: r for r in files.read_result_charts(spark, os.path.join(DATA, "chart_sample.xml")).collect()}
    assert set(rows) == {"ALPHA", "BRAVO"}  # the race without a number is dropped
    a = rows["ALPHA"]
    assert a["race_id"] == "2023-04-29_CD_R1" and a["num_runners"] == 2 and a["distance_yards"] == 1320
    assert a["dollar_odds"] == 2.5 and a["official_finish"] == 1 and a["jockey_last_name"] == "Lee"
    assert a["point_of_call"]["final"]["position"] == 1 and a["point_of_call"]["1"]["lengths"] == "1"
    assert rows["BRAVO"]["speed_rating"] is None and rows["BRAVO"]["jockey_first_name"] is None


def test_point_of_call_wide(spark):
    wide = files.point_of_call_wide(files.read_result_charts(spark, os.path.join(DATA, "chart_sample.xml")))
    assert {"point_of_call_1_position", "point_of_call_final_position", "point_of_call_final_lengths"} <= set(wide.columns)


CARD_XML = """<EntryRaceCard>
  <RaceDate>2023-05-06+00:00</RaceDate><Track><TrackID>CD</TrackID></Track>
  <Race>
    <RaceNumber>3</RaceNumber><Distance><DistanceId>850</DistanceId><DistanceUnit><Value>F</Value></DistanceUnit></Distance>
    <Course><CourseType><Value>T</Value></CourseType></Course><PurseUSA>75000</PurseUSA>
    <AgeRestriction><Value>3U</Value></AgeRestriction>
    <Starters>
      <Horse><HorseName>CHARLIE</HorseName><RegistrationNumber>R1</RegistrationNumber><YearOfBirth>2019</YearOfBirth><Sex><Value>C</Value></Sex></Horse>
      <PostPosition>4</PostPosition><Odds>5/2</Odds><WeightCarried>122</WeightCarried><TodaysHorseClassRating>570</TodaysHorseClassRating>
      <RaceSummary><NumberOfStarts>5</NumberOfStarts><NumberOfWins>2</NumberOfWins><NumberOfSeconds>1</NumberOfSeconds><NumberOfThirds>0</NumberOfThirds><EarningsUSA>1000</EarningsUSA><Surface><Value>T</Value></Surface></RaceSummary>
      <RaceSummary><NumberOfStarts>3</NumberOfStarts><NumberOfWins>0</NumberOfWins><NumberOfSeconds>1</NumberOfSeconds><NumberOfThirds>1</NumberOfThirds><EarningsUSA>500</EarningsUSA><Surface><Value>D</Value></Surface></RaceSummary>
      <PastPerformance><RaceDate>2023-03-01</RaceDate><RaceNumber>5</RaceNumber><NumberOfStarters>9</NumberOfStarters>
        <Start><OfficialFinish>95</OfficialFinish><SpeedFigure>870</SpeedFigure><Odds>450</Odds>
          <PointOfCall><PointOfCall>1</PointOfCall><Position>0</Position></PointOfCall></Start></PastPerformance>
      <PastPerformance><RaceDate>2023-04-01</RaceDate><RaceNumber>2</RaceNumber><NumberOfStarters>0</NumberOfStarters>
        <Start><OfficialFinish>2</OfficialFinish><SpeedFigure>9999</SpeedFigure><Odds>3/1</Odds>
          <PointOfCall><PointOfCall>F</PointOfCall><Position>2</Position><LengthsBehind>3</LengthsBehind></PointOfCall></Start></PastPerformance>
      <Workout><Date>2023-04-20</Date><Ranking>3</Ranking><NumberInRankingGroup>12</NumberInRankingGroup></Workout>
    </Starters>
  </Race>
</EntryRaceCard>"""


def test_zipped_card(spark):
    d = tempfile.mkdtemp(prefix="paddock-zip-")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        zf.writestr("card.xml", CARD_XML)
    with open(os.path.join(d, "card.zip"), "wb") as f:
        f.write(buf.getvalue())
    starters = files.card_starters(files.read_card_zips(spark, os.path.join(d, "*.zip")))
    e = files.card_entries(starters).first()
    assert e["race_id"] == "2023-05-06_CD_R3" and e["distance_yards"] == 1870 and e["morning_line_odds_float"] == 2.5
    assert e["class_rating"] == 57.0 and e["career_starts"] == 8 and e["career_wins"] == 2 and e["career_earnings"] == 1500.0
    assert e["surface_starts"] == 5 and e["surface_wins"] == 2
    pp = sorted(files.card_past_performances(starters).collect(), key=lambda r: r["pp_index"])
    assert [r["pp_race_date"] for r in pp] == [dt.date(2023, 4, 1), dt.date(2023, 3, 1)]
    assert pp[0]["pp_speed_figure"] is None and pp[0]["pp_num_starters"] is None and pp[0]["pp_odds"] == 3.0
    assert pp[0]["pp_poc_final_pos"] == 2 and pp[0]["pp_poc_final_behind"] == 3
    assert pp[1]["pp_official_finish"] is None and pp[1]["pp_speed_figure"] == 87 and pp[1]["pp_odds"] == 4.5
    assert pp[1]["pp_poc_1_pos"] is None
    w = files.card_workouts(starters).first()
    assert (w["workout_ranking"], w["workout_num_in_group"]) == (3, 12)


def _positional_row(values: dict) -> str:
    row = [""] * 1435
    for k, v in values.items():
        row[k - 1] = v
    return ",".join(row)


def test_positional_csv(spark):
    d = tempfile.mkdtemp(prefix="paddock-csv-")
    vals = {1: "CD", 2: "20230506", 3: "4", 4: "3", 5: "S", 6: "-1320", 7: "t", 10: "BUF", 12: "50000", 44: "4.5", 45: "DELTA",
            46: "20", 49: "f", 51: "121.0", 58: "", 75: "4", 76: "1", 77: "1", 78: "0", 97: "10", 98: "3", 99: "2", 100: "1", 101: "12345",
            256: "20230401", 257: "", 258: "20230101", 316: "1320", 326: "T", 346: "8", 616: "2", 846: "85", 516: "3.5",
            102: "20230420", 186: "10", 198: "2"}
    with open(os.path.join(d, "card.csv"), "w") as f:
        f.write(_positional_row(vals) + "\n")
    rows = files.read_positional_csv(spark, os.path.join(d, "card.csv"))
    e = files.positional_entries(rows).first()
    assert e["race_id"] == "2023-05-06_CD_R4" and e["distance_yards"] == 1320 and e["surface"] == "T"
    assert e["age_restriction"] == "3U" and e["sex_restriction"] == "F" and e["year_of_birth"] == 2020 and e["sex"] == "F"
    assert e["post_position"] == 3 and e["weight_carried"] == 121 and e["surface_starts"] == 4 and e["feed_scratched"]
    pp = sorted(files.positional_past_performances(rows).collect(), key=lambda r: r["pp_index"])
    assert [r["pp_index"] for r in pp] == [1, 3] and pp[0]["pp_speed_figure"] == 85 and pp[0]["pp_odds"] == 3.5
    w = files.positional_workouts(rows).first()
    assert (w["workout_ranking"], w["workout_num_in_group"]) == (2, 10)


def test_odds_payloads(spark):
    payloads = [
        ("a", '[{"programNumber": "1", "liveOdds": "5/2"}, {"programNumber": "1A", "liveOdds": "3/1"}, {"programNumber": "2", "liveOdds": "garbage", "oddsTrend": {"current": {"oddsNumeric": 7.0}}}]'),
        ("b", '{"runners": [{"programNumber": "3", "liveOdds": 6.0}]}'),
        ("c", '{"race": {"raceEntries": [{"programNumber": "4", "liveOdds": "EVEN"}, {"programNumber": "x"}]}}'),
        ("d", '{"nothing": 1}'),
        ("e", '[{"programNumber": "5", "liveOdds": "9", "oddsTrend": {"current": {"oddsNumeric": 8.5}}}, {"programNumber": "6", "liveOdds": "9"}]'),
        ("f", '[{"programNumber": "7", "liveOdds": 9}, {"programNumber": "8", "liveOdds": null}, {"programNumber": "9", "liveOdds": true}]'),
    ]
    df = spark.createDataFrame(payloads, "source string, payload string")
    got = {(r["source"], r["post_position"]): r["live_odds"] for r in files.parse_odds_payloads(df).collect()}
    assert got == {("a", 1): 2.5, ("a", 2): 7.0, ("b", 3): 6.0, ("c", 4): 1.0, ("e", 5): 8.5, ("f", 7): 9.0}


def test_overrides_required_columns(spark):
    d = tempfile.mkdtemp(prefix="paddock-ovr-")
    with open(os.path.join(d, "o.csv"), "w") as f:
        f.write("race_number,post_position,race_class_rating\n1,1,80\n")
    with pytest.raises(ValueError, match="missing required columns"):
        files.read_overrides(spark, os.path.join(d, "o.csv"))


def test_track_codes(spark):
    d = tempfile.mkdtemp(prefix="paddock-trk-")
    with open(os.path.join(d, "t.csv"), "w") as f:
        f.write("country,track_id,track_name,state\nUSA,CD,Churchill Downs,KY\nUSA,,Nowhere,XX\n")
    assert [r["track_id"] for r in files.read_track_codes(spark, os.path.join(d, "t.csv")).collect()] == ["CD"]


def test_unreadable_card_zips_are_reported(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.xml", "<EntryRaceCard><RaceDate>2024-01-02</RaceDate></EntryRaceCard>" * 3)
    whole = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "cut.zip").write_bytes(whole[: len(whole) // 2])
    locked = bytearray(whole)
    locked[6] |= 1  # the encrypted flag, in the member's header and in the directory
    locked[whole.index(b"PK\x01\x02") + 8] |= 1
    (tmp_path / "locked.zip").write_bytes(bytes(locked))
    got = {os.path.basename(r["path"]): r for r in files.read_card_zips(spark, str(tmp_path / "*.zip")).collect()}
    assert got["a.zip"]["error"] is None and got["a.zip"]["card"] is not None
    assert got["cut.zip"]["error"].startswith("BadZipFile") and got["locked.zip"]["error"].startswith("RuntimeError")
