"""Canonical JSON and what is computed over it (F2, F6, F8, F11): the four functions that need Python, as Arrow UDFs.

Canonical JSON: keys in ordinal order, texts in NFC, times with an offset in UTC with seven digits, numbers without superfluous zeros, no
white space. The writer escapes what the audit format escapes: control characters, the signs in ``ESCAPED`` and all beyond ASCII, as upper-case ``\\uXXXX``.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable
from datetime import datetime, timezone
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values.
ESCAPED = "\"&'<>+`"
SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r", "\\": "\\\\"}
_TIME = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,7})?(Z|[+-]\d\d:\d\d)")


def _text(value: str) -> str:
    out = []
    for c in unicodedata.normalize("NFC", value):
        if c in SHORT:
            out.append(SHORT[c])
        elif c < " " or c > "~" or c in ESCAPED:
            data = c.encode("utf-16-be", "surrogatepass")
            out += (f"\\u{data[k] << 8 | data[k + 1]:04X}" for k in range(0, len(data), 2))
        else:
            out.append(c)
    return '"' + "".join(out) + '"'


def _string(value: str) -> str:
    if _TIME.fullmatch(value):
        digits = (re.search(r"\.(\d+)", value) or [None, ""])[1].ljust(7, "0")
        try:
            whole = datetime.fromisoformat(re.sub(r"\.\d+", "", value).replace("Z", "+00:00")).astimezone(timezone.utc)
            return f'"{whole:%Y-%m-%dT%H:%M:%S}.{digits}Z"'
        except (ValueError, OverflowError):
            pass
    return _text(value)


def _number(value: Decimal | int) -> str:
    if isinstance(value, int):
        return str(value)
    text = f"{value:f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def _write(value: object) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{_text(k)}:{_write(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_write, value)) + "]"
    if isinstance(value, str):
        return _string(value)
    if isinstance(value, bool) or value is None:
        return {True: "true", False: "false", None: "null"}[value]
    return _number(value)


def _constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def _unique(pairs: list[tuple[str, object]]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("a key occurs twice")
    return dict(pairs)


def canonical(text: str | None, unique_keys: bool = False) -> str:
    """Null and blank are the empty text; what is not JSON raises ValueError."""
    if text is None or not text.strip():
        return ""
    return _write(json.loads(text, parse_float=Decimal, parse_constant=_constant, object_pairs_hook=_unique if unique_keys else None))


def _or_none(f: Callable[[str | None], str | None], value: str | None) -> str | None:
    try:
        return f(value)
    except (ValueError, RecursionError):
        return None


def _mapped(f: Callable[..., str | None]) -> Callable[..., Column]:
    @F.arrow_udf(StringType())
    def over(*columns: pa.Array) -> pa.Array:
        return pa.array([f(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], pa.string())

    return over


#: F2. Null where the text is not JSON.
canonical_json = _mapped(lambda t: _or_none(canonical, t))


def fingerprint(text: str | None) -> str:
    """F8: SHA-256, in hexadecimal, of the canonical form; subjects without repeats and in order. A key that occurs twice, and a lone surrogate, raise ValueError."""
    value = json.loads(text or "{}", parse_float=Decimal, parse_constant=_constant, object_pairs_hook=_unique)
    if isinstance(value, dict) and isinstance(value.get("subjects"), list):
        value["subjects"] = [json.loads(x, parse_float=Decimal) for x in sorted({_write(x) for x in value["subjects"]})]
    try:
        json.dumps(value, default=str, ensure_ascii=False).encode()
    except UnicodeEncodeError as error:
        raise ValueError("lone surrogate") from error
    return hashlib.sha256(_write(value).encode()).hexdigest()


envelope_fingerprint = _mapped(lambda t: _or_none(fingerprint, t))


ANONYMIZED = "ANONYMIZED"
#: Fixed value: what takes the place of a text that cannot be read.
NOT_ANONYMIZED = '{"_anonymization_error":"Failed to parse JSON for anonymization"}'


def anonymized(text: str | None, user_id: str) -> str | None:
    """values of top-level keys that name a user, email or name, and values that contain the user id; bad JSON becomes a placeholder."""
    if text is None or not text.strip():
        return text
    try:
        value = json.loads(text, parse_float=Decimal)
    except ValueError:
        return NOT_ANONYMIZED
    if not isinstance(value, dict):
        return NOT_ANONYMIZED
    hide = lambda k, v: re.search("user|email|name", k, re.I) or isinstance(v, str) and user_id and user_id.lower() in v.lower()
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{json.dumps(ANONYMIZED) if hide(k, v) else json.dumps(v, ensure_ascii=False, default=float, separators=(',', ':'))}" for k, v in value.items()) + "}"


anonymize_json = _mapped(anonymized)
