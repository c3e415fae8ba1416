from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from catalore.functions import ddl, genmeta, names, rules, text
from catalore.functions.clock import relative_time, relative_time_text

AS_OF = datetime(2024, 3, 10, 12, 0, 0)
c = None


@pytest.fixture(autouse=True)
def column(spark):
    """Columns need a session, so the one under test is made after it."""
    global c
    c = F.col("x")


def texts(one, values, column):
    return one([(v,) for v in values], "x string", column)


def test_truncation(one):
    long = "a" * 51
    assert texts(one, ["a" * 50, long, None], text.cell_text(c)) == ["a" * 50, "a" * 47 + "...", "NULL"]
    assert texts(one, ["b" * 101], text.truncate_text(c, 100)) == ["b" * 100 + "..."]
    assert texts(one, ["short"], text.truncate_text(c, 80, always=True)) == ["short..."]


def test_escape_round_trips_through_spark(spark, one):
    values = ["it's", "a\\b", "line\nbreak", "''", "\\'", "ü – 漢"]
    escaped = texts(one, values, ddl.escape_literal(c))
    assert [spark.sql(f"SELECT '{e}'").first()[0] for e in escaped] == values
    assert texts(one, [None], ddl.escape_literal(c)) == ["NULL"]
    assert texts(one, ["it's plain"], ddl.escape_literal(c)) == ["it''s plain"]


def test_identifiers(one):
    values = ["plain_name", "my col", "a-b", "tick`s"]
    assert texts(one, values, names.quote_identifier(c)) == [
        "plain_name", "`my col`", "`a-b`", "`tick``s`",
    ]


def test_sanitize_and_words_follow_python(one):
    values = [" <b>'x' & \"y\";\\ ", "", None, " wide　space\x85", "one", "  two\twords "]
    bad = set("<>&\"'\\;")
    expected = ["".join(ch for ch in (v or "") if ch not in bad).strip() for v in values]
    assert texts(one, values, text.sanitize(c)) == expected
    plain = [v for v in values if v is not None]
    assert texts(one, plain, text.word_count(c)) == [len(v.split()) for v in plain]
    for least in (1, 2, 3):
        assert texts(one, plain, text.has_words(c, least)) == [
            len(v.split()) >= least for v in plain
        ]


def test_word_rule_is_linear_on_texts_without_blanks(one):
    assert texts(one, ["x" * 200_000], text.has_words(c, 3)) == [False]


def test_labels_and_highlight(one):
    assert texts(one, ["approved", "import_failed"], text.title_label(c)) == [
        "Approved", "Import_Failed",
    ]
    rows = [("a", "a"), ("a", "b"), (None, None), (None, "b")]
    shown = one(rows, "x string, y string", text.highlight_changes(c, F.col("y")))
    assert shown == ["a", "~~a~~ → **b**", None, "~~None~~ → **b**"]


def test_name_filter(one):
    values = ["orders", "order_items", "Orders", "parts"]
    assert texts(one, values, text.name_matches(c, "order, art")) == [True, True, False, True]
    assert texts(one, values, text.name_matches(c, "art,")) == [False, False, False, True]
    assert texts(one, values, text.name_matches(c, " , ")) == [True] * 4
    assert texts(one, values, text.name_matches(c, None)) == [True] * 4
    rows = [("orders", "x, der,"), ("orders", ","), ("orders", None)]
    matched = one(rows, "x string, y string", text.name_matches_tokens(c, text.split_tokens(F.col("y"))))
    assert matched == [True, False, None]


def test_qualified_name_and_colors(spark):
    rows = spark.createDataFrame(
        [("c", "s", "t", "col", "approved"), ("c", "s", "t", None, "odd"), ("c", "s", "t", "", None)],
        "catalog_name string, schema_name string, table_name string, column_name string, status string",
    )
    found = rows.select(names.qualified_name(), names.status_color(F.col("status"))).collect()
    assert [tuple(r) for r in found] == [
        ("c.s.t.col", "#28a745"), ("c.s.t", "#6c757d"), ("c.s.t", "#6c757d"),
    ]


@pytest.mark.parametrize(
    "seconds, shown",
    [
        (0, "Just now"),
        (60, "Just now"),
        (61, "1 minutes ago"),
        (3600, "60 minutes ago"),
        (3601, "1 hours ago"),
        (86399, "23 hours ago"),
        (86400, "1 days ago"),
        (7 * 86400 + 23 * 3600, "7 days ago"),
        (8 * 86400, "2024-03-02 12:00"),
        (-600, "Just now"),
    ],
)
def test_relative_time(one, seconds, shown):
    then = AS_OF - timedelta(seconds=seconds)
    assert one([(then,)], "x timestamp_ntz", relative_time(c, AS_OF)) == [shown]
    as_text = then.isoformat(sep=" ")
    assert texts(one, [as_text], relative_time_text(c, AS_OF)) == [shown]


def test_relative_time_ignores_the_session_zone(spark, one):
    # The clocks go forward in New York between the two times.
    before, after = datetime(2024, 3, 10, 1, 30), datetime(2024, 3, 10, 4, 30)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one([(before,)], "x timestamp_ntz", relative_time(c, after)) == ["3 hours ago"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_relative_time_of_missing_and_unparseable(one):
    assert one([(None,)], "x timestamp_ntz", relative_time(c, AS_OF)) == ["Never"]
    assert texts(one, [None, "last week"], relative_time_text(c, AS_OF)) == ["Never", "last week"]


def test_rates_round_half_to_even(one):
    rows = [(0, 0), (0, 3), (1, 3), (3, 3), (1, 8), (49, 400)]
    found = one(rows, "x long, y long", names.percent(c, F.col("y")))
    assert found == [None, 0.0, 33.3, 100.0, 12.5, 12.2]


@pytest.mark.parametrize(
    "value, kind, message",
    [
        (None, "comment", "Comment cannot be empty"),
        ("  　", "description", "Description cannot be empty"),
        ("two words", "comment", "Comments should be more descriptive (at least 3 words)"),
        ("two words", "description", None),
        ("now three words", "comment", None),
        ("x" * 5000, "description", None),
        ("x" * 5001, "description", "Description is too long (max 5000 characters)"),
        ("x" * 5001, "comment", "Comment is too long (max 5000 characters)"),
    ],
)
def test_value_rules(one, value, kind, message):
    rule = rules.value_error(c, F.col("kind"))
    assert one([(value, kind)], "x string, kind string", rule) == [message]


def test_generation_metadata_never_fails(one):
    values = ['{"tokens_used": 5, "cost_estimate": 0.1}', "not json", None, "{}", '{"error": "e"}']
    parsed = texts(one, values, genmeta.parse_generation(c)["tokens_used"])
    assert parsed == [5, None, None, None, None]
