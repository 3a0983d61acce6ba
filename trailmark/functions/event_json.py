"""the stored JSON of an event as columns, by the variant type: each getter looks at the type of what it finds, so that one odd value spoils no other.

A field may have either of two spellings. A text takes the first spelling that is there, even if it is null; the other getters take the first spelling that holds
their type. Text fields give other values as JSON. Broken JSON, and JSON that is no object, give an error and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MALFORMED, NO_OBJECT = "Failed to parse audit data: Malformed JSON", "Failed to parse audit data: Parse error"
#: The fields of an environment, a target and of the changes of an entity, in both spellings.
ENVIRONMENT = {"UserName": "user_name", "MachineName": "machine_name", "DomainName": "domain_name", "CallingMethodName": "calling_method_name", "AssemblyName": "assembly_name", "Culture": "culture"}
TARGET = {"Type": "type", "Old": "old", "New": "new"}
CHANGE_TEXTS = {"EntityType": "entity_type", "EntityId": "entity_id", "Action": "action", "EntityState": "entity_state"}
CHANGE_MAPS = {"KeyValues": "key_values", "OldValues": "old_values", "NewValues": "new_values"}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _at(v: Column, name: str) -> Column:
    """The value of a key, which may be a null of JSON; null where there is no such key."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _text(v: Column, *names: str) -> Column:
    return _let(F.coalesce(*(_at(v, n) for n in names)), lambda found: F.when(~F.is_variant_null(found), F.try_variant_get(found, "$", "string")))


def _typed(v: Column, kind: str, to: str, *names: str) -> Column:
    return F.coalesce(*(_let(_at(v, n), lambda found: F.when(_kind(found) == kind, F.try_variant_get(found, "$", to))) for n in names))


def _guid(v: Column, *names: str) -> Column:
    dashed = lambda digits: F.concat_ws("-", *(F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    is_guid = lambda text: text.rlike("(?i)^([0-9a-f]{32}|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})$")
    return _let(_typed(v, "STRING", "string", *names), lambda text: F.when(is_guid(text), dashed(F.lower(F.regexp_replace(text, "-", "")))))


def _object(v: Column, *names: str) -> Column:
    """The first spelling that is there, if it is an object."""
    return _let(F.coalesce(*(_at(v, n) for n in names)), lambda found: F.when(_kind(found) == "OBJECT", found))


def _record(value: Column, fields: dict[str, str]) -> Column:
    return _let(value, lambda v: F.when(v.isNotNull(), F.struct(*(_text(v, *pair).alias(pair[1]) for pair in fields.items()))))


def _map(value: Column) -> Column:
    return _let(F.try_variant_get(value, "$", "map<string,string>"), lambda found: F.when(F.size(found) > 0, found))


def _opened(v: Column, *names: str) -> Column:
    """A value, or what the JSON of a text says it is."""
    return _let(F.coalesce(*(_at(v, n) for n in names)), lambda found: F.when(_kind(found) == "STRING", F.try_parse_json(F.try_variant_get(found, "$", "string"))).otherwise(found))


def _changes(own: Column, custom: Column) -> Column:
    """The changes of an entity as the response names them, or those that custom fields hold, if they name an entity type."""

    def read(v: Column, given: bool) -> Column:
        names = lambda p, s: (s,) if given else (p, s)
        texts = [(_text(v, s) if given else _typed(v, "STRING", "string", p, s)).alias(s) for p, s in CHANGE_TEXTS.items()]
        maps = [_map(_opened(v, *names(p, s))).alias(s) for p, s in CHANGE_MAPS.items()]
        listed = F.try_variant_get(_opened(v, *names("ChangedProperties", "changed_properties")), "$", "array<string>")
        return F.struct(*texts, listed.alias("changed_properties"), *maps)

    named = F.coalesce(_at(custom, "EntityType"), _at(custom, "entity_type")).isNotNull()
    return F.when(own.isNotNull(), read(own, True)).when(named, read(custom, False))


def read_event(text: Column) -> Column:
    """struct(event_id, event_type, start_date, end_date, duration, success, error_message, environment, target, custom_fields, entity_changes); null for a null or empty text."""
    return F.when(F.length(text) > 0, _let(F.try_parse_json(text), _event))


def _event(parsed: Column) -> Column:
    of_root = lambda root: _let(_object(root, "CustomFields", "custom_fields"), lambda custom: _fields(parsed, root, custom))
    return _let(F.when(_kind(parsed) == "OBJECT", parsed), of_root)


def _fields(parsed: Column, root: Column, custom: Column) -> Column:
    error = F.when(parsed.isNull(), MALFORMED).when(root.isNull(), NO_OBJECT).otherwise(_text(root, "ErrorMessage", "error_message"))
    when = lambda *names: F.try_to_timestamp(_typed(root, "STRING", "string", *names))
    return F.struct(
        _guid(root, "EventId", "event_id").alias("event_id"),
        _text(root, "EventType", "event_type").alias("event_type"),
        when("StartDate", "start_date").alias("start_date"),
        when("EndDate", "end_date").alias("end_date"),
        _typed(root, "BIGINT", "int", "Duration", "duration").alias("duration"),
        _typed(root, "BOOLEAN", "boolean", "Success", "success").alias("success"),
        error.alias("error_message"),
        _record(_object(root, "Environment", "environment"), ENVIRONMENT).alias("environment"),
        _record(_object(root, "Target", "target"), TARGET).alias("target"),
        _map(custom).alias("custom_fields"),
        _let(_object(root, "entity_changes"), lambda own: _changes(own, custom)).alias("entity_changes"),
    )
