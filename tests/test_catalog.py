from datetime import datetime

import pytest
from pyspark.sql import functions as F

from catalore.operators import importer
from catalore.operators.profile import table_stats
from catalore.plans.importing import run_import
from catalore.schemas import ITEMS
from catalore.sources import catalog
from catalore.sources.store import conform

AS_OF = datetime(2024, 3, 10, 12, 0, 0)
TRICKY = "it's a \\n b\nsecond line"


@pytest.fixture
def shop(spark):
    spark.sql("DROP DATABASE IF EXISTS shop CASCADE")
    spark.sql("CREATE DATABASE shop")
    spark.sql("CREATE TABLE shop.orders (id BIGINT COMMENT 'old', state STRING, `my col` INT) USING parquet")
    spark.sql("CREATE TABLE shop.parts (id BIGINT, day STRING) USING parquet PARTITIONED BY (day)")
    spark.sql("INSERT INTO shop.orders VALUES (1, 'N', 1), (2, 'N', 2)")
    yield "shop"
    spark.sql("DROP DATABASE shop CASCADE")


def make_items(spark, rows):
    frame = spark.createDataFrame(
        rows, "id long, table_name string, column_name string, current_value string, original_value string"
    ).selectExpr(
        "*", "'spark_catalog' AS catalog_name", "'shop' AS schema_name",
        "'description' AS metadata_type", "'approved' AS status", "current_value AS generated_value",
        "timestamp_ntz'2024-01-01 00:00:00' AS created_at",
    )
    return conform(frame, ITEMS)


def test_listings(spark, shop):
    tables = catalog.catalog_tables(spark, "spark_catalog", shop)
    assert [r["table_name"] for r in tables.collect()] == ["orders", "parts"]
    some = catalog.catalog_tables(spark, "spark_catalog", shop, "art,", limit=1)
    assert [r["table_name"] for r in some.collect()] == ["parts"]
    columns = catalog.catalog_columns(spark, "spark_catalog", shop, ["orders", "parts"])
    found = [(r["table_name"], r["ordinal"], r["column_name"], r["comment"]) for r in columns.collect()]
    # A partition column counts once, and nothing but columns is listed.
    assert found == [
        ("orders", 1, "id", "old"), ("orders", 2, "state", None), ("orders", 3, "my col", None),
        ("parts", 1, "id", None), ("parts", 2, "day", None),
    ]


def test_clean_describe(spark, shop):
    names = [r["col_name"] for r in catalog.clean_describe(spark.sql("DESCRIBE shop.parts")).collect()]
    assert "id" in names and not any(n.startswith("#") or n == "" for n in names)


def test_properties_and_stats(spark, shop):
    spark.sql("ALTER TABLE shop.orders SET TBLPROPERTIES ('owner_team' = 'sales')")
    properties = catalog.table_properties(spark, "spark_catalog", shop, ["orders", "parts"])
    frames = {name: spark.table(f"shop.{name}") for name in ("orders", "parts")}
    found = {r["table_name"]: r for r in table_stats(frames, properties).collect()}
    assert found["orders"]["row_count"] == 2 and found["parts"]["row_count"] == 0
    assert found["orders"]["properties"]["owner_team"] == "sales"


def test_import_verify_and_roll_back_columns(spark, shop, tmp_path):
    items = make_items(
        spark,
        [
            (1, "orders", "id", TRICKY, "old"),
            (2, "orders", "my col", "spaced", None),
            (3, "orders", "absent", "nothing there", None),
            (4, "gone", "id", "no table", None),
        ],
    )
    tables = catalog.catalog_tables(spark, "spark_catalog", shop)
    dry = run_import(spark, items, tables, "column", AS_OF)
    assert dry.history is None and dry.totals.first()["successful"] == 3
    assert all(r["message"].startswith("DRY RUN: Would execute - ALTER TABLE") for r in dry.results.collect())

    run = run_import(
        spark, items, tables, "column", AS_OF, is_dry_run=False,
        results_path=str(tmp_path / "results"), batch_size=2,
    )
    assert {r["id"]: r["success"] for r in run.results.collect()} == {1: True, 2: True, 3: False}
    assert [r["id"] for r in run.skipped.collect()] == [4]
    assert run.stats.first()["outcome"] == "partial"
    failed = importer.import_failures(run.results).first()
    assert failed["message"].startswith("Failed to apply description to orders.absent")
    assert {r["action"] for r in run.history.collect()} == {"imported", "import_failed"}
    again = importer.retry_set(items, run.history.withColumn("id", F.lit(1)))
    assert sorted(r["id"] for r in again.collect()) == [3, 4]

    columns = catalog.catalog_columns(spark, "spark_catalog", shop, ["orders"])
    checked = {r["id"]: (r["found"], r["matches"]) for r in importer.verify_columns(items, columns).collect()}
    assert checked == {1: (True, True), 2: (True, True), 3: (False, False), 4: (False, False)}

    for row in importer.rollback_plan(items.where("id <= 2")).collect():
        spark.sql(row["statement"])
    comments = {f.name: f.metadata.get("comment") for f in spark.table("shop.orders").schema}
    assert comments["id"] == "old" and not comments["my col"]


def test_import_verify_and_roll_back_tables(spark, shop, tmp_path):
    items = make_items(spark, [(1, "orders", None, TRICKY, None), (2, "parts", "", "parts list", "before")])
    tables = catalog.catalog_tables(spark, "spark_catalog", shop)
    run = run_import(
        spark, items, tables, "table", AS_OF, is_dry_run=False, results_path=str(tmp_path / "results")
    )
    assert run.totals.first()["success_rate"] == 100.0
    now = catalog.catalog_tables(spark, "spark_catalog", shop)
    assert {r["id"]: r["matches"] for r in importer.verify_tables(items, now).collect()} == {1: True, 2: True}
    for row in importer.rollback_plan(items).collect():
        spark.sql(row["statement"])
    after = {r["table_name"]: r["description"] for r in catalog.catalog_tables(spark, "spark_catalog", shop).collect()}
    assert not after["orders"] and after["parts"] == "before"


def test_a_run_goes_on_where_it_stopped(spark, shop, tmp_path):
    items = make_items(spark, [(1, "orders", "id", "key", None), (2, "orders", "state", "state", None)])
    plan = importer.batched_plan(items, "column", 1)
    path, done = str(tmp_path / "results"), []
    first = importer.apply_plan(spark, plan.where("id = 1"), "column", False, path, "run-a")
    assert first.count() == 1
    spark.sql("ALTER TABLE shop.orders ALTER COLUMN id COMMENT 'changed meanwhile'")
    for _ in range(2):
        again = importer.apply_plan(spark, plan, "column", False, path, "run-a")
        done.append(sorted(r["id"] for r in again.collect()))
    assert done == [[1, 2], [1, 2]]
    columns = catalog.catalog_columns(spark, "spark_catalog", shop, ["orders"]).collect()
    # The recorded item was not run a second time.
    assert {r["column_name"]: r["comment"] for r in columns}["id"] == "changed meanwhile"
    other = importer.apply_plan(spark, plan, "column", False, path, "run-b")
    assert other.count() == 2


def test_an_empty_import_has_an_empty_result(spark, shop, tmp_path):
    items = make_items(spark, [(1, "gone", "id", "x", None)])
    tables = catalog.catalog_tables(spark, "spark_catalog", shop)
    run = run_import(
        spark, items, tables, "column", AS_OF, is_dry_run=False, results_path=str(tmp_path / "results")
    )
    assert run.results.count() == 0 and run.totals.first()["success_rate"] is None


def test_comments_written_with_the_data(spark, shop):
    catalog.save_with_comments(spark.range(2), {"id": "the key"}, "shop.made")
    columns = catalog.catalog_columns(spark, "spark_catalog", shop, ["made"]).collect()
    assert [r["comment"] for r in columns] == ["the key"]
