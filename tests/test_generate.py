import json
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalore.functions.clock import instant
from catalore.operators import prompts
from catalore.operators.generate import describe, describe_logged, logged_answers, with_fallback
from catalore.plans.generation import generate_column_items, generate_table_items

AS_OF = datetime(2024, 3, 10, 12, 0, 0)


def test_failed_rows_fall_back_and_keep_their_error(spark):
    def paid(batch):
        if (batch["column_name"] == "broken").any():
            raise RuntimeError("no answer")
        n = len(batch)
        return pd.DataFrame(
            {
                "description": [f" About {name} " for name in batch["column_name"]],
                "model": ["m"] * n,
                "tokens_used": [1000] * n,
                "prompt_tokens": [900] * n,
                "completion_tokens": [100] * n,
            }
        )

    rows = [("t", "good", "p"), ("t", "broken", "p"), ("t", "fine", "p")]
    asked = spark.createDataFrame(rows, "table_name string, column_name string, prompt string")
    done = with_fallback(describe(asked.coalesce(1), paid), instant(AS_OF)).collect()
    texts = {r["column_name"]: r["generated_value"] for r in done}
    assert texts == {
        "good": "About good",
        "broken": "Auto-generated description for broken",
        "fine": "About fine",
    }
    records = {r["column_name"]: json.loads(r["generation_metadata"]) for r in done}
    assert records["broken"] == {"error": "no answer"}
    assert abs(records["good"]["cost_estimate"] - 0.03) < 1e-12
    assert records["good"]["timestamp"] == "2024-03-10T12:00:00.000000"


def test_table_fallback_names_the_table(spark):
    rows = [("orders", None, "p")]
    asked = spark.createDataFrame(rows, "table_name string, column_name string, prompt string")

    def silent(batch):
        raise TimeoutError("late")

    done = with_fallback(describe(asked, silent, partitions=2), instant(AS_OF)).first()
    assert done["generated_value"] == "Auto-generated description for orders table"


def test_answers_are_asked_for_once(spark):
    def changing(batch):
        import uuid

        return pd.DataFrame({"description": [uuid.uuid4().hex for _ in range(len(batch))]})

    asked = spark.range(20).selectExpr("'t' AS table_name", "string(id) AS column_name", "'p' AS prompt")
    answers = describe(asked, changing, partitions=3)
    first = {r["column_name"]: r["description"] for r in answers.collect()}
    assert {r["column_name"]: r["description"] for r in answers.orderBy("prompt").collect()} == first
    assert len(set(first.values())) == 20


def test_a_restart_asks_only_for_what_has_no_answer(spark, tmp_path):
    calls, log = str(tmp_path / "calls"), str(tmp_path / "log")

    def describer(batch, fail):
        import os
        import uuid

        os.makedirs(calls, exist_ok=True)
        if (batch["column_name"] == fail).any():
            raise ValueError("no answer")
        for name in batch["column_name"]:
            open(f"{calls}/{name}-{uuid.uuid4().hex}", "w").close()
        return pd.DataFrame({"description": "about " + batch["column_name"]})

    def asked():
        found = sorted(int(f.name.split("-")[0]) for f in (tmp_path / "calls").iterdir())
        return found

    rows = spark.range(40).selectExpr("'t' AS table_name", "string(id) AS column_name", "'p' AS prompt", "id")
    # The first run gets as far as 25 prompts, one of which fails.
    first = describe_logged(rows.filter("id < 25"), log, lambda b: describer(b, "7"), 2, chunk_rows=10)
    assert {r["column_name"] for r in first.filter("error IS NOT NULL").collect()} == {"7"}
    assert asked() == [i for i in range(25) if i != 7]
    # The second one has all of them, one row twice.
    twice = rows.unionByName(rows.filter("id = 30"))
    done = describe_logged(twice, log, lambda b: describer(b, "none"), 2, chunk_rows=10)
    assert asked() == list(range(40))
    got = sorted((r["id"], r["description"], r["error"]) for r in done.collect())
    assert got == sorted((i, f"about {i}", None) for i in [*range(40), 30])
    # A third one asks nobody; an empty one neither.
    assert describe_logged(rows, log, lambda b: describer(b, "1")).count() == 40
    assert describe_logged(rows.limit(0), log, lambda b: describer(b, "1")).count() == 0
    assert asked() == list(range(40))


def test_a_killed_run_keeps_its_chunks(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.range(30).selectExpr("'t' AS table_name", "string(id) AS column_name", "'p' AS prompt")

    def dying(batch):
        import os

        if (batch["column_name"] == "11").any():
            os._exit(1)
        return pd.DataFrame({"description": "first " + batch["column_name"]})

    with pytest.raises(Exception):
        describe_logged(rows, log, dying, 1, chunk_rows=6)
    kept = {r["description"] for r in logged_answers(spark, log).collect()}

    def living(batch):
        return pd.DataFrame({"description": "second " + batch["column_name"]})

    done = {r["description"] for r in describe_logged(rows, log, living, 1, chunk_rows=6).collect()}
    assert len(done) == 30 and {d for d in done if d.startswith("first")} == kept


def test_prompt_switches(spark):
    inputs = spark.createDataFrame(
        [("t", "a", "int", ["1", "2", "3", "4"]), ("t", "b", "int", None)],
        "table_name string, column_name string, data_type string, samples array<string>",
    )
    with_samples = {r["column_name"]: r["prompt"] for r in prompts.column_prompts(inputs).collect()}
    assert "\nSample Values: 1, 2, 3\n" in with_samples["a"]
    assert "Sample Values" not in with_samples["b"]
    bare = prompts.column_prompts(inputs, include_sample=False).where("column_name = 'a'").first()
    assert "Sample Values" not in bare["prompt"]
    tables = spark.createDataFrame(
        [("t", 1234567, 1, "  - a (int)", ['{"a":"1"}', '{"a":"2"}', '{"a":"3"}']), ("e", 0, 0, "", None)],
        "table_name string, row_count long, column_count long, columns_text string, row_samples array<string>",
    )
    full = {r["table_name"]: r["prompt"] for r in prompts.table_prompts(tables).collect()}
    assert "\nApproximate Rows: 1,234,567\nColumns (1):\n  - a (int)\nSample Data:\nRow 1: " in full["t"]
    assert "Row 2: " in full["t"] and "Row 3: " not in full["t"]
    assert "Approximate Rows" not in full["e"] and "Sample Data" not in full["e"]
    plain = prompts.table_prompts(tables, False, False).where("table_name = 't'").first()["prompt"]
    assert "Columns (" not in plain and "Sample Data" not in plain


def test_generator_runs(spark):
    tables = {"orders": spark.range(4).withColumn("order_state", F.lit("N"))}
    columns = generate_column_items(spark, tables, "main", "shop", AS_OF, max_columns=1).collect()
    assert [(r["column_name"], r["status"], r["data_sample"]) for r in columns] == [
        ("id", "pending", '["0","1","2","3"]')
    ]
    unsampled = generate_column_items(spark, tables, "main", "shop", AS_OF, include_sample=False)
    assert {r["data_sample"] for r in unsampled.collect()} == {None}
    made = generate_table_items(spark, tables, {"orders": ["id"]}, "main", "shop", AS_OF).first()
    assert made["column_name"] is None and made["generation_method"] == "openai_template"
    assert json.loads(made["generation_metadata"])["row_count"] == 4
    assert len(json.loads(made["data_sample"])) == 3
