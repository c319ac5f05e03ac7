"""Replies of judging models: the JSON object in a text, and the label it gives."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VERDICTS = ("supported", "partially_supported", "unsupported")


def read_object(text: str | None) -> tuple[dict | None, str | None]:
    """The first JSON object of a text, whatever follows it; else the reason why there is none."""
    at = (text or "").find("{")
    if at < 0:
        return None, "no JSON in the reply"
    try:
        value, _ = json.JSONDecoder().raw_decode(text[at:])
    except json.JSONDecodeError:
        return None, "unreadable JSON in the reply"
    return (value, None) if isinstance(value, dict) else (None, "the reply is no object")


def verdict(reply: Column) -> Column:
    """``struct<verdict, claims, reason, error>`` of a judge's reply; an unknown verdict is an error, never an exception."""

    @F.pandas_udf("verdict string, claims array<string>, reason string, error string")
    def read(replies: pd.Series) -> pd.DataFrame:
        rows = []
        for text in replies:
            value, error = read_object(text)
            if value is not None and value.get("verdict") not in VERDICTS:
                value, error = None, f"unknown verdict: {value.get('verdict')!r}"
            if value is None:
                rows.append((None, [], "", error))
            else:
                claims = value.get("unsupported_claims", [])
                rows.append((value["verdict"], [str(c) for c in claims] if isinstance(claims, list) else [], str(value.get("reason", "")), None))
        return pd.DataFrame(rows, columns=["verdict", "claims", "reason", "error"])

    return read(reply)


def label(reply: Column, allowed: tuple[str, ...] = ("supported", "unsupported", "contradicted", "not a claim")) -> Column:
    """``struct<label, reason, error>`` of a reply that labels one claim."""

    @F.pandas_udf("label string, reason string, error string")
    def read(replies: pd.Series) -> pd.DataFrame:
        rows = []
        for text in replies:
            value, error = read_object(text)
            if value is not None and value.get("label") not in allowed:
                value, error = None, f"unknown label: {value.get('label')!r}"
            rows.append((None, None, error) if value is None else (value["label"], str(value.get("reason", "")), None))
        return pd.DataFrame(rows, columns=["label", "reason", "error"])

    return read(reply)
