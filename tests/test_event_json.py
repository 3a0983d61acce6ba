"""The event reader: both spellings, odd types, broken texts."""

import datetime

import pytest
from pyspark.sql import functions as F

from trailmark.functions.event_json import MALFORMED, NO_OBJECT, read_event

ID = "00000000-0000-4000-8000-00000000000A"


def read(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(read_event(F.col("t")).alias("e")).first().e
    return row and row.asDict(recursive=True)


@pytest.mark.parametrize("spelled", [lambda a, b: a, lambda a, b: b])
def test_all_fields_in_both_spellings(spark, spelled):
    s = spelled
    text = f"""{{"{s("EventId", "event_id")}":"{ID}","{s("EventType", "event_type")}":"User.Login","{s("StartDate", "start_date")}":"2024-01-01T02:00:00+02:00","{s("EndDate", "end_date")}":null,"{s("Duration", "duration")}":12,
      "{s("Success", "success")}":false,"{s("ErrorMessage", "error_message")}":"no","{s("Environment", "environment")}":{{"{s("UserName", "user_name")}":"u","{s("Culture", "culture")}":7}},
      "{s("Target", "target")}":{{"{s("Type", "type")}":"Order","{s("Old", "old")}":{{"a":1}},"{s("New", "new")}":null}},
      "{s("CustomFields", "custom_fields")}":{{"k":1,"f":1.5,"b":true,"n":null,"o":{{"x":[1]}},"{s("EntityType", "entity_type")}":"Order","{s("KeyValues", "key_values")}":{{"Id":5}},"{s("ChangedProperties", "changed_properties")}":["A","B"],"{s("OldValues", "old_values")}":"{{\\"A\\":1}}"}}}}"""
    e = read(spark, text)
    assert (e["event_id"], e["event_type"], e["start_date"], e["end_date"], e["duration"], e["success"], e["error_message"]) == (ID.lower(), "User.Login", datetime.datetime(2024, 1, 1), None, 12, False, "no")
    assert e["environment"] == {"user_name": "u", "machine_name": None, "domain_name": None, "calling_method_name": None, "assembly_name": None, "culture": "7"}
    assert e["target"] == {"type": "Order", "old": '{"a":1}', "new": None}
    assert {k: e["custom_fields"][k] for k in "kfbno"} == {"k": "1", "f": "1.5", "b": "true", "n": None, "o": '{"x":[1]}'}
    changes = e["entity_changes"]
    assert (changes["entity_type"], changes["entity_id"], changes["key_values"], changes["changed_properties"], changes["old_values"], changes["new_values"]) == ("Order", None, {"Id": "5"}, ["A", "B"], {"A": "1"}, None)


def test_wrong_types_spoil_no_other_field(spark):
    e = read(spark, '{"EventId":5,"event_id":"0000000000004000800000000000000b","EventType":{"a":1},"StartDate":"soon","start_date":"2024-02-03","Duration":"12","duration":7,"Success":"true","Environment":[1],"Target":"x","CustomFields":{},"entity_changes":{"entity_type":"T","entity_id":3}}')
    assert (e["event_id"], e["event_type"], e["duration"], e["success"], e["environment"], e["target"], e["custom_fields"]) == ("00000000-0000-4000-8000-00000000000b", '{"a":1}', 7, None, None, None, None)
    assert (e["entity_changes"]["entity_type"], e["entity_changes"]["entity_id"]) == ("T", "3")
    e = read(spark, '{"Duration":3000000000,"EventType":null,"event_type":"x","Success":1}')
    assert (e["duration"], e["event_type"], e["success"], e["entity_changes"], e["error_message"]) == (None, None, None, None, None)


def test_broken_and_odd_texts(spark):
    assert read(spark, None) is None and read(spark, "") is None
    for text, error in (("{", MALFORMED), ("nope", MALFORMED), ("[1]", NO_OBJECT), ("7", NO_OBJECT)):
        e = read(spark, text)
        assert e["error_message"] == error and e["event_type"] is e["custom_fields"] is e["entity_changes"] is None
