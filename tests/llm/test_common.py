from __future__ import annotations

import os
import random
import time

import pyarrow as pa
from llm.helpers import ODD, documents
from pyspark.sql import functions as F

from loomshed.llm import queries
from loomshed.llm.common import FILES_GO, MOST_SENT, Scratch, held_out, held_out_col, slices, small, words_of


def test_slices_keep_all_rows():
    rng = random.Random(0)
    texts = [rng.choice([None, "", "x" * rng.randrange(500)]) for _ in range(200)]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[k : k + 70], pa.string()), "k": list(range(k, min(k + 70, 200)))}) for k in range(0, 200, 70)]
    got = list(slices(iter(batches), most=800))
    assert [t for b in got for t in b.column("text").to_pylist()] == texts and [k for b in got for k in b.column("k").to_pylist()] == list(range(200))
    assert max(sum(len(t or "") for t in b.column("text").to_pylist()) for b in got) <= 800


def test_words_split_at_six_characters_alone():
    assert words_of("a\x1cb\x85c\xa0d e f\tg\x0bh") == [w.encode() for w in ("a\x1cb\x85c\xa0d e", "f", "g", "h")]


def test_held_out_agrees_with_spark(spark):
    rows = documents(spark, [(k, "") for k in range(50)] + [(-7, ""), (None, "")]).select("doc_id", held_out_col("doc_id", 4, 2).alias("h")).collect()
    assert all(r.h == held_out(r.doc_id, 4, 2) for r in rows) and any(r.h for r in rows)


def test_scratch_tables(spark):
    work = Scratch(spark, "test")
    a = work.save(documents(spark, ODD), "a")
    before = len(work.tables)
    b, _ = work.save(a.where("doc_id > 3"), "b"), work.save(a, "c")
    work.keep(before, "b")
    assert work.tables == ["a", "b"] and b.count() == len(ODD) - 4 and a.count() == len(ODD)
    assert work.save(a.limit(0), "none").count() == 0


def test_only_small_tables_are_sent(spark):
    df = spark.range(100)
    hinted = lambda d: "broadcast" in spark.range(5).join(d, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert hinted(small(df, 8)) and not hinted(small(df, MOST_SENT))


def test_every_operator_has_its_query():
    numbers = sorted(int(q[2:].split("_")[0]) for q in queries.queries())
    assert numbers == list(range(1, 14)) and set(queries.oracle_sql()) <= set(queries.queries())


def test_sql_gives_the_same_rows(spark):
    from compare import compared, connection

    folder = "/root/testdata/sf0.001"
    con = connection(folder)
    for name, sql in queries.oracle_sql().items():
        assert compared(spark, con, folder, queries.queries()[name], sql) == ""


def test_native_operators_stay_in_the_jvm(spark):
    plan = queries.queries()["op4_mix_sources"](spark, "/root/testdata/sf0.001").select(F.col("*"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_scratch_tables_go_when_cleared(spark):
    import os

    from loomshed.llm.common import Scratch, clear

    before = len(Scratch.made)
    kept, gone = Scratch(spark, "kept"), Scratch(spark, "gone")
    for s in (kept, gone):
        s.save(spark.range(3).toDF("x"), "t")
    clear(before, but=kept)
    assert os.path.exists(kept.root.removeprefix("file://")) and not os.path.exists(gone.root.removeprefix("file://")) and Scratch.made[before:] == [kept]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from loomshed.llm.common import shared_dir

    conf = SimpleNamespace(get=lambda k, d=None: None)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"), conf=conf)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(cluster)


def test_shuffle_files_go_when_a_table_is_written(spark):
    """Not only when garbage is collected; the session's setting is as before."""
    dirs = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    work, df, before = Scratch(spark, "brief"), spark.range(1000).repartition(3, "id"), files()
    work.brief = True
    saved = work.save(df, "t")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(FILES_GO, None) is None
    assert saved.count() == 1000 and sorted(r.id for r in df.collect()) == list(range(1000))
