"""What a written table leaves on local disk."""

import glob
import os
import time

from pyspark.sql import functions as F

from paddock.operators import snapshots
from paddock.session import stored


def shuffle_files(spark):
    """Shuffle files of the local executor, in the folders that its block manager has."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for d in disk.localDirsString() for f in glob.glob(os.path.join(d, "*", "shuffle_*"))}


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    before = shuffle_files(spark)
    df = spark.range(5000).select((F.col("id") % 97).alias("k"), "id").repartition(4, "id").groupBy("k").agg(F.collect_list("id").alias("ids"))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    assert stored(df).count() == 97
    assert snapshots.publish(df, str(tmp_path / "a"), "000001")
    snapshots.publish_bucketed(df, str(tmp_path / "b"), "000001", "k", 3)
    assert snapshots.read_bucketed(spark, str(tmp_path / "b"), "k").count() == 97
    left = set()
    for _ in range(50):  # files go in the background
        left = {f for f in shuffle_files(spark) - before if os.path.getsize(f) > 2000}
        if not left:
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(key, None) == was
