from datetime import datetime

from catalore.operators import upload as ops
from catalore.operators.items import history_of
from catalore.operators.review import apply_reviews, current_items
from catalore.plans.uploading import upload_items
from catalore.sources import uploads
from catalore.sources.store import (
    append_items,
    create_store,
    export_csv,
    import_history_rows,
    read_history,
    read_items,
    recover_items,
    replace_items,
    to_items,
    upload_template,
    write_history,
    write_items,
)

HEADER = "catalog_name,schema_name,table_name,metadata_type,generated_value,column_name"
AS_OF = datetime(2024, 3, 10, 12, 0, 0)


def write(path, *lines):
    path.write_text("\n".join([HEADER, *lines]) + "\n", encoding="utf8")
    return str(path)


def test_missing_tokens_and_quoted_newlines(spark, tmp_path):
    file = write(
        tmp_path / "up.csv",
        'main,shop,t,comment,"two\nlines and ""quotes""",NA',
        "main,shop,null,description,None,n/a",
        "main,shop,t,description,NaN,",
    )
    rows = uploads.read_upload(spark, file).collect()
    assert rows[0]["generated_value"] == 'two\nlines and "quotes"'
    assert [r["column_name"] for r in rows] == [None, None, None]
    assert rows[1]["table_name"] is None and rows[1]["generated_value"] is None
    kept = uploads.read_upload(spark, file, missing_tokens=()).collect()
    assert kept[1]["generated_value"] == "None"


def test_schema_check(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text("catalog_name,table_name\nmain,t\n")
    frame = uploads.read_upload(spark, str(path))
    assert uploads.schema_message(frame) == (
        "Missing required columns: ['schema_name', 'metadata_type', 'generated_value']"
    )
    full = uploads.read_upload(spark, write(tmp_path / "full.csv", "main,s,t,comment,a b c,"))
    assert uploads.schema_message(full) is None
    assert "generation_method" in uploads.with_optional_columns(full).columns


def test_report_split_and_items(spark, tmp_path):
    file = write(
        tmp_path / "up.csv",
        "main,shop,t,comment,one two three,",
        "main,shop,t,note,text,c1",
        "main,shop,t,,text,c2",
        ",shop,t,description,text,c3",
        f"{'m' * 256},shop,t,description,text,c4",
    )
    frame = uploads.with_optional_columns(uploads.read_upload(spark, file))
    report = {r["message"]: r["n_rows"] for r in ops.upload_report(frame).collect()}
    must = "Must be one of: ['comment', 'description']"
    assert report == {
        "Column 'catalog_name' contains empty values": 1,
        "Column 'metadata_type' contains empty values": 1,
        f"Invalid metadata_type values: ['note']. {must}": 1,
        f"Invalid metadata_type values: ['nan']. {must}": 1,
        "catalog_name is longer than 255": 1,
    }
    split = ops.split_upload(frame)
    # What is accepted is stored, what fails is given back with its reason.
    assert split.accepted.count() == 1 and split.rejected.count() == 4
    assert tuple(split.outcome.first()) == (5, 1, 4)
    items = upload_items(frame, "me", AS_OF).collect()
    assert [(r["table_name"], r["current_value"], r["status"]) for r in items] == [
        ("t", "one two three", "pending")
    ]
    found = ops.upload_report(split.accepted).collect()
    assert [(r["valid"], r["message"], r["n_rows"]) for r in found] == [(True, "Validation successful", 1)]


def test_report_names_every_value(spark):
    rows = [("c", "s", "t", f"kind {i:03}", "text") for i in range(30)]
    frame = spark.createDataFrame(
        rows, "catalog_name string, schema_name string, table_name string, metadata_type string, generated_value string"
    )
    messages = {r["message"] for r in ops.upload_report(frame).collect()}
    assert len(messages) == 30 and all("'kind " in m for m in messages)
    assert ops.invalid_types(frame).count() == 30
    assert ops.preview(frame).count() == 10
    assert ops.upload_summary(frame, approximate=True).first()["total_rows"] == 30


def test_store_round_trip(spark, tmp_path):
    create_store(spark, "tracking")
    create_store(spark, "tracking")
    rows = spark.createDataFrame(
        [("main", "shop", "t", "b", 'say "hi",\nnow'), ("main", "shop", "t", "a", "text")],
        "catalog_name string, schema_name string, table_name string, column_name string, generated_value string",
    ).selectExpr("*", "'description' AS metadata_type")
    for expected in ([1, 2], [1, 2, 3, 4]):
        existing = read_items(spark, "tracking")
        new = to_items(rows, "me", AS_OF)
        write_items(append_items(new, existing, ["column_name"], key="column_name"), "tracking")
        stored = read_items(spark, "tracking")
        assert sorted(r["id"] for r in stored.collect()) == expected
    assert stored.where("id = 1").first()["column_name"] == "a"
    plan = stored.where("schema_name = 'shop'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(schema_name" in plan
    results = stored.selectExpr("id", "id > 2 AS success", "'done' AS message")
    logged = import_history_rows(results, "bulk_importer", AS_OF, read_history(spark, "tracking"))
    write_history(logged, "tracking")
    actions = [r["action"] for r in read_history(spark, "tracking").orderBy("metadata_item_id").collect()]
    assert actions == ["import_failed", "import_failed", "imported", "imported"]

    review = spark.createDataFrame(
        [(1, 3, "better", "edited", "r", None, AS_OF)],
        "action_id long, item_id long, new_value string, status string, reviewed_by string, comment string, ts timestamp_ntz",
    )
    outcome = apply_reviews(stored, review, read_history(spark, "tracking"))
    write_history(outcome.audit, "tracking")
    ids = [r["id"] for r in read_history(spark, "tracking").collect()]
    assert sorted(ids) == [1, 2, 3, 4, 5]
    viewed = current_items(stored, read_history(spark, "tracking")).where("id = 3").first()
    assert (viewed["current_value"], viewed["status"]) == ("better", "edited")
    replace_items(outcome.items, "tracking")
    replace_items(read_items(spark, "tracking"), "tracking")
    stored = read_items(spark, "tracking")
    assert stored.count() == 4
    assert stored.where("id = 3").first()["current_value"] == "better"
    # A rewrite that was cut off between its two renames.
    spark.sql("ALTER TABLE tracking.metadata_items RENAME TO tracking.metadata_items_next")
    assert recover_items(spark, "tracking") and not recover_items(spark, "tracking")
    stored = read_items(spark, "tracking")
    assert stored.count() == 4
    assert history_of(read_history(spark, "tracking"), 3).first()["action"] in ("edited", "imported")

    export_csv(upload_template(stored.where("id <= 2")), str(tmp_path / "out"))
    again = uploads.read_upload(spark, str(tmp_path / "out"))
    assert again.where("column_name = 'b'").first()["generated_value"] == 'say "hi",\nnow'
