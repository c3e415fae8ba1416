import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from catalore.operators.review import acceptable, latest_action
from catalore.schemas import ACTIONS
from catalore.streaming import review_stream

START = datetime(2024, 1, 1)


def test_state_and_counts_follow_the_stream(spark, tmp_path):
    rng = random.Random(11)
    rows = [
        (i, 0 if rng.random() < 0.3 else rng.randrange(40), f"v{i}",
         rng.choice(["approved", "rejected", "edited", "archived"]), "u", None,
         START + timedelta(minutes=rng.randrange(500)))
        for i in range(400)
    ]
    inbox, folder = tmp_path / "inbox", str(tmp_path / "state")
    arrived = []
    # Files come in any time order, so many actions are late; two triggers per call.
    for call in range(3):
        for part in range(2):
            batch = rows[(call * 2 + part) * 65 : (call * 2 + part + 1) * 65]
            arrived += batch
            frame = spark.createDataFrame(batch, ACTIONS).coalesce(1)
            frame.write.mode("append").parquet(str(inbox))
        stream = review_stream.read_file_stream(spark, str(inbox), ACTIONS, files_per_trigger=1)
        review_stream.run_available(stream, folder)
        expected = latest_action(spark.createDataFrame(arrived, ACTIONS).where(acceptable()))
        found = review_stream.current_state(spark, folder)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
        counts = {r["status"]: r["n"] for r in review_stream.current_status_counts(spark, folder).collect()}
        assert counts == {r["status"]: r["count"] for r in expected.groupBy("status").count().collect()}
    assert review_stream._Versions(spark, f"{folder}/counts").numbers == [4, 5]
    assert review_stream.current_state(spark, folder).where(F.col("status") == "archived").count() == 0


def write_batches(spark, folder, batches, again=()):
    """Triggers over (item_id, status) rows; what ``again`` names runs twice."""
    write = review_stream._write_trigger(folder)
    rows = []
    for batch, changes in enumerate(batches):
        new = [
            (batch * 1000 + i, item, f"v{batch}", status, "u", None, START + timedelta(minutes=(batch * 7) % 11))
            for i, (item, status) in enumerate(changes)
        ]
        rows += new
        known = latest_action(spark.createDataFrame(rows, ACTIONS))
        touched = spark.createDataFrame([(r[1],) for r in new], "item_id long").distinct()
        for _ in range(2 if batch in again else 1):
            write(known.join(touched, "item_id", "left_semi"), batch)
    return known


def test_buckets_follow_the_triggers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(review_stream, "BUCKET_IDS", 4)
    folder, rng = str(tmp_path / "state"), random.Random(5)
    batches = [
        [(rng.randrange(-3, 12), rng.choice(["approved", "edited"])) for _ in range(6)] for _ in range(7)
    ]
    known = write_batches(spark, folder, batches, again=(2, 6))
    found = review_stream.current_state(spark, folder)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, known.collect()))
    counts = {r["status"]: r["n"] for r in review_stream.current_status_counts(spark, folder).collect()}
    assert counts == {r["status"]: r["count"] for r in known.groupBy("status").count().collect()}


def test_a_trigger_reads_the_buckets_it_touches(spark, tmp_path, monkeypatch):
    """What a late trigger reads does not grow with the items that it leaves alone."""
    monkeypatch.setattr(review_stream, "BUCKET_IDS", 10)
    read = []
    for items in (40, 400):
        folder = str(tmp_path / f"state{items}")
        everything = [(i, "approved") for i in range(items)]
        write_batches(spark, folder, [everything, [(3, "edited")], [(3, "rejected"), (17, "edited")], [(17, "approved")]])
        before = review_stream._state_before(spark, folder, [0, 1], 4)
        files = [f.removeprefix("file://") for f in before.inputFiles()]
        assert sorted(f.split("/")[-2] for f in files) == ["batch=2", "batch=3"]
        read.append((before.count(), sum(os.path.getsize(f) for f in files)))
        kept = {p.name: len(list(p.glob("batch=*"))) for p in (tmp_path / f"state{items}" / "state").glob("bucket=*")}
        assert len(kept) == items // 10 and max(kept.values()) <= review_stream.VERSIONS
        assert len(list((tmp_path / f"state{items}" / "counts").glob("batch=*"))) == review_stream.VERSIONS
    assert read[0][0] == read[1][0] == 20 and abs(read[0][1] - read[1][1]) < 200


def test_a_repeated_trigger_changes_nothing(spark, tmp_path):
    """The same trigger written twice, as after a failure, leaves the same counts."""
    folder = str(tmp_path / "state")
    write = review_stream._write_trigger(folder)
    first = latest_action(spark.createDataFrame([(1, 7, "a", "approved", "u", None, START)], ACTIONS))
    second = latest_action(
        spark.createDataFrame([(2, 7, "b", "rejected", "u", None, START + timedelta(1))], ACTIONS)
    )
    write(first, 0)
    write(second, 1)
    write(second, 1)
    assert [tuple(r) for r in review_stream.current_status_counts(spark, folder).collect()] == [("rejected", 1)]
