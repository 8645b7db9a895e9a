"""File ledgers, published ingest tables and the pruned day slice."""

import io
import os
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.operators import snapshots
from paddock.plans import warehouse
from paddock.plans.pipeline import Pipeline
from paddock.sources import ledger

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("race", T.LongType()), T.StructField("odds", T.DoubleType())])


def folder(files):
    root = tempfile.mkdtemp(prefix="paddock-ledger-")
    for name, content in files.items():
        with open(os.path.join(root, name), "wb") as f:
            f.write(content if isinstance(content, bytes) else content.encode())
    return root


def entries(records):
    return {os.path.basename(r["file"]): (r["n_rows"], r["n_bad"], r["reasons"]) for r in ledger.ledger(records).collect()}


def test_csv_ledger(spark):
    root = folder({"a.csv": "race,odds\n1,2.5\n2,x\n,3\n4\n5,1,9\n6,\n", "b.csv": "race,odds\n7,1\n"})
    records = ledger.read_csv(spark, root, SCHEMA, ("race",))
    assert entries(records) == {"a.csv": (6, 4, "unreadable record: 2; bad odds: 1; no race: 1"), "b.csv": (1, 0, "")}
    assert sorted(tuple(r) for r in ledger.good(records).collect()) == [(1, 2.5), (6, None), (7, 1.0)]


def test_json_ledger(spark):
    root = folder({"a.json": '{"race": 1, "odds": 2}\n{"race": 2, "odds"\n{"odds": 3}\n\n{"race": "x"}\n', "b.json": '{"race": 9}\n'})
    records = ledger.read_json_lines(spark, root, SCHEMA, ("race",))
    assert entries(records) == {"a.json": (4, 3, "bad race: 1; no race: 1; unreadable record: 1"), "b.json": (1, 0, "")}


def test_xml_ledger(spark):
    root = folder({"a.xml": "<c><r><race>1</race><odds>2</odds></r><r><race>z</race></r><r><odds>1</odds></r></c>", "b.xml": "<c><r><race>4</race></r><r><race>5<race></r></c>"})
    got = entries(ledger.read_xml(spark, root, "r", SCHEMA, ("race",)))
    assert got["a.xml"] == (3, 2, "bad race: 1; no race: 1") and got["b.xml"][1] >= 1 and "unreadable record" in got["b.xml"][2]


def test_zip_ledger(spark):
    packed, none = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("x.xml", "<a/>")
        z.writestr("y.xml", "<b/>")
    zipfile.ZipFile(none, "w").close()
    root = folder({"a.zip": packed.getvalue(), "b.zip": b"not an archive", "c.zip": none.getvalue()})
    records = ledger.read_zips(spark, root)
    assert entries(records) == {"a.zip": (2, 0, ""), "b.zip": (1, 1, "unreadable archive: BadZipFile: 1"), "c.zip": (1, 1, "empty archive: 1")}
    assert sorted(r["text"] for r in ledger.good(records).collect()) == ["<a/>", "<b/>"]


def test_day_slice_reads_one_year(spark):
    today, pp = warehouse.latest_day(spark, SF)
    for df in (today, pp):
        plan = df._jdf.queryExecution().executedPlan().toString()
        filters = [line for line in plan.split("PartitionFilters: ")[1:]]
        assert any("race_year" in line.split("PushedFilters")[0] and "ubquery" in line.split("PushedFilters")[0] for line in filters), plan[:3000]
    assert today.select("race_date").distinct().count() == 1
    assert today.first()["race_date"] == warehouse.runners(spark, SF).agg(F.max("race_date")).first()[0]


def test_a_rebuild_that_fails_changes_nothing(spark, monkeypatch):
    before = warehouse.runners(spark, SF).count()
    root = warehouse._root(spark, SF)
    published = snapshots.versions(spark, f"{root}/runners")
    broken = lambda spark, sf: spark.range(9).select(F.raise_error(F.lit("no")).cast("int").alias("race_year"))
    monkeypatch.setattr(warehouse, "build_runners", broken)
    with pytest.raises(Exception):
        warehouse.ingest(spark, SF, force=True)
    assert snapshots.versions(spark, f"{root}/runners") == published and warehouse.runners(spark, SF).count() == before
    monkeypatch.setattr(warehouse, "LAYOUT_VERSION", "other")
    assert warehouse._root(spark, SF) != root


def test_features_group_races_without_a_shuffle(spark):
    p = Pipeline(spark, SF)
    plan = p.built_features._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Bucketed: true" in plan and "Exchange" not in plan
    inline = Pipeline(spark, SF, materialize=False)
    key = ["race_id", "horse_name"]
    want = inline.built_features.select(*key, "speed_fig_L1", "num_workouts", "ml_odds_rank")
    got = p.built_features.select(*want.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_a_bucketed_table_is_known_to_a_catalog_that_did_not_write_it(spark):
    root = tempfile.mkdtemp(prefix="paddock-buckets-")
    rows = spark.range(100).select((F.col("id") % 7).cast("string").alias("race_id"), "id")
    snapshots.publish_bucketed(rows, root, "1", "race_id", 3)
    path = f"{root}/rows/version=1-b3"
    spark.sql(f"DROP TABLE {snapshots._table_name(path)}")  # external: the files stay
    counts = snapshots.read_bucketed(spark, root, "race_id").groupBy("race_id").count()
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["count"] for r in counts.collect()) == [14] * 5 + [15] * 2
