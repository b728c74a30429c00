"""JSON documents and responses of differing shape."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logspark.operators import inference
from logspark.sources.tables import state_of_documents

SCAN = "2024-01-02T03:04:05Z"
AT = datetime(2024, 1, 2, 3, 4, 5)


def read_state(spark, *texts):
    rows = state_of_documents(spark.createDataFrame([(t,) for t in texts], "value string"))
    return sorted(tuple(r) for r in rows.collect())


def test_entries_by_id_and_in_a_list(spark):
    entry = {"name": "web", "last_scan": SCAN, "log_cursor": "x", "new": {"field": [1]}}
    assert read_state(spark, json.dumps({"containers": {"a": entry}, "more": 1}),
                      json.dumps({"containers": [{"id": "b", **entry}, {"name": "no id"}]})) == [
        ("a", "web", AT, "x"), ("b", "web", AT, "x")]


@pytest.mark.parametrize("field,value,place", [
    ("name", 5, 1), ("name", None, 1), ("last_scan", 7, 2), ("last_scan", "soon", 2),
    ("last_scan", {"t": SCAN}, 2)])
def test_a_field_of_a_wrong_type_is_not_given(spark, field, value, place):
    entry = {"name": "web", "last_scan": SCAN, "log_cursor": "x", field: value}
    assert read_state(spark, json.dumps({"containers": {"a": entry}}))[0][place] is None


@pytest.mark.parametrize("text", [
    None, "", "{", "[]", "3", "null", "{}", '{"containers":null}', '{"containers":"a"}',
    '{"containers":{"a":null,"b":"x","c":[1]}}', '{"containers":[]}', '{"containers":[{"id":1}]}'])
def test_nothing_to_read(spark, text):
    assert read_state(spark, text) == []


def test_no_documents(spark):
    assert read_state(spark) == []


def unwrapped(spark, body):
    bodies = spark.createDataFrame([("r", body)], "request_id string, body string")
    row = inference.unwrap(bodies.select("request_id"), inference.responses_of(bodies)).first()
    return row["failure"], row["content"], row["usage_tokens"]


CHOICE = {"message": {"content": "yes"}}


@pytest.mark.parametrize("body,expected", [
    ({"choices": [CHOICE], "usage": {"total_tokens": 3}}, (None, "yes", 3)),
    ({"choices": [CHOICE], "usage": {"total_tokens": "3"}}, (None, "yes", 3)),
    ({"choices": [CHOICE], "usage": {"prompt_tokens": 1, "completion_tokens": 2}}, (None, "yes", 3)),
    ({"choices": [CHOICE], "usage": {"prompt_tokens": 1}}, (None, "yes", 0)),
    ({"choices": [CHOICE], "usage": {"total_tokens": False}}, (None, "yes", 0)),
    ({"choices": [CHOICE], "usage": 4, "error": None}, (None, "yes", 0)),
    ({"choices": [{"text": "old"}]}, (None, "old", 0)),
    ({"choices": [{"message": {"content": [{"text": "a"}, {"image": 1}, "b", {"text": "c"}]}}]},
     (None, "ac", 0)),
    ({"choices": [{"message": {"content": []}}]}, (None, "", 0)),
    ({"choices": [{"message": {"content": {"text": "a"}}}]}, (None, "", 0)),
    ({"choices": [{"message": None}]}, (None, "", 0)),
    ({"choices": [None, "x", CHOICE]}, (None, "yes", 0)),
    ({"choices": ["x"]}, (inference.NO_CHOICES, None, 0)),
    ({"choices": {"a": 1}}, (inference.NO_CHOICES, None, 0)),
    ({}, (inference.NO_CHOICES, None, 0)),
    ({"error": "down", "choices": [CHOICE]}, ("down", None, 0)),
    ({"error": {"message": "slow", "code": 429}}, ("429: slow", None, 0)),
    ({"error": {"reason": 1}}, ('{"reason":1}', None, 0)),
    ({"error": {}}, ("{}", None, 0)),
    ([CHOICE], (inference.UNREADABLE, None, 0)),
])
def test_shapes_of_responses(spark, body, expected):
    assert unwrapped(spark, json.dumps(body)) == expected


@pytest.mark.parametrize("text", [None, "", "{", "null", "503 Service Unavailable"])
def test_no_json(spark, text):
    assert unwrapped(spark, text) == (inference.UNREADABLE, None, 0)


def test_read_responses_are_as_typed_ones(spark):
    """The schema is that of responses made as columns, so both can be joined and appended."""
    bodies = spark.createDataFrame([("r", "{}")], "request_id string, body string")
    rows = inference.responses_of(bodies)
    assert rows.schema["choices"].dataType.simpleString() == (
        "array<struct<index:int,message:struct<role:string,content:string>,finish_reason:string>>")
    assert rows.select(F.to_json("choices"), "usage.total_tokens", "error.code").collect()
