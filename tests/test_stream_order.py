"""Streams of conversations whose turns come in any order: the same states and pauses as of all turns at once."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from gridquill.operators import session as ss
from gridquill.plans.session import asking
from gridquill.streaming import jobs

SCHEMA = "thread_id string, turn long, role string, content string"


def test_turns_of_a_thread_in_any_order(spark, tmp_path):
    rows = [(str(t), i, "user" if i % 2 == 0 else "assistant", f"{t} says {i}, the 2nd or raw") for t in range(12) for i in range(7)] + [("12", 0, "user", None)]
    source = str(tmp_path / "in")
    for n, part in enumerate(([r for r in rows if r[1] > 3], [r for r in rows if r[1] <= 3])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        for f in (tmp_path / "in").glob("part-*.parquet"):
            if os.path.getmtime(f) > 2_000:
                os.utime(f, (1_000 + n, 1_000 + n))
    stream = jobs.stream_of(spark, source, SCHEMA)
    path = str(tmp_path / "threads")
    jobs.run_now_by_batch(jobs.thread_states(stream), path, str(tmp_path / "marks")).awaitTermination()
    states = {r["thread_id"]: (r["n"], r["last_turn"], r["last_user"], r["roles"]) for r in jobs.latest_states(spark, path).collect()}
    assert states == {str(t): (7, 6, f"{t} says 6, the 2nd or raw", "uauauau") for t in range(12)} | {"12": (1, 0, None, "u")}

    path = str(tmp_path / "choices")
    jobs.run_now_by_batch(jobs.choices(asking(stream)), path, str(tmp_path / "more")).awaitTermination()
    want = ss.pauses(asking(spark.createDataFrame(rows, SCHEMA))).where("answered is not null")
    assert sorted(map(tuple, jobs.resumed_choices(spark, path).collect())) == sorted(map(tuple, want.collect()))


def test_a_gist_is_picked_as_its_reply(spark):
    said = ["2", " 3) L1", "9 raw", "Exposed", "the OFFICIAL one", "comput", "", None, "no 2", "٣", "x" * 50 + "weights l1"]
    rows = spark.createDataFrame([(x,) for x in said], "reply string").withColumn("options", F.explode(F.array(*(F.array(*map(F.lit, o)) for o in (("exposure", "risk-L1"), ("risk-L2", "risk-L1", "exposure"), ("other",))))))
    assert rows.where(ss.picked(F.col("reply"), F.col("options")) != ss.picked(jobs.gist(F.col("reply")), F.col("options"))).count() == 0
