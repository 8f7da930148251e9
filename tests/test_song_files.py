"""One file a song, all or none."""

import pytest
from pyspark.sql import functions as F

from tempolyra.sources.song_files import write_song_files


def found(path):
    return {p.name: p.read_text() for p in path.glob("[!_]*")}


def test_files_and_failures(spark, tmp_path):
    path = tmp_path / "songs"
    rows = spark.createDataFrame([("a", "﻿x\ny"), ("b/c", "日本"), ("d", None), ("e f", "")], "song_id string, content string").repartition(3)
    write_song_files(rows, str(path))
    want = {"a.ass": "﻿x\ny", "b%2Fc.ass": "日本", "d.ass": "", "e f.ass": ""}
    assert found(path) == want
    # a task that fails after others have written
    more = spark.range(0, 40, 1, 4).select(F.col("id").alias("song_id"), F.when(F.col("id") < 39, F.lit("z")).otherwise(F.raise_error(F.lit("broken"))).alias("content"))
    for bad in (more, rows.withColumn("song_id", F.when(F.col("song_id") != "d", F.col("song_id"))).withColumn("content", F.lit("new"))):
        with pytest.raises(Exception):
            write_song_files(bad, str(path))
        assert found(path) == want
    write_song_files(rows.where("song_id = 'a'").withColumn("content", F.lit("again")), str(path))
    write_song_files(rows.where("song_id = 'none'"), str(path))
    assert found(path) == want | {"a.ass": "again"}
