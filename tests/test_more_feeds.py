"""Payloads of further sources, one each, and what is read from them."""

import json

import pytest

from jobquarry.sources import board_feeds, feeds, more_feeds  # noqa: F401  (rules are added by import)
from jobquarry.sources.fixtures import PAYLOADS as CASES

PAY = {
    "pinpoint": (10.0, None, "GBP", "hour"), "teamtailor": (5.0, 5.0, "NOK", "hour"), "applicantpro": (20.0, 25.5, "USD", "hour"), "usajobs": (50000.0, 60000.0, "USD", "year"), "adzuna": (10.0, None, "GBP", "year"),
    "personio": (4000.0, None, "EUR", "month"), "schemaorg": (50000.0, 60000.0, "USD", None),
}
PLACES = {
    "breezy": ("Ghent", "OVL", "Belgium", "Ghent, BE"), "bamboohr": ("Linz", "OÖ", None, "Linz, OÖ"), "teamtailor": ("Oslo", None, "NO", "Oslo, NO"), "rippling": ("Bern", None, "Switzerland", "Bern, Switzerland"),
    "paylocity": ("Reno", "NV", None, "Reno, NV"), "adzuna": (None, None, "UK", "Leeds"), "ukg": ("Reno", "NV", None, "Reno, NV"), "coveo": (None, None, None, "Pune, India"),
    "eightfold": ("Azusa", "CA", "US", "Azusa, CA, US"), "workable": ("Athens", None, "Greece", "Athens, Greece"), "taleo": (None, None, None, "Reno, Remote"),
    "workable_network": ("Athens", None, "Greece", "Athens, Greece"), "join": ("Berlin", None, "Germany", "Berlin, Germany"), "paycom": ("Reno", "NV", None, "HQ - Reno, NV 89501"), "apicapture": (None, None, None, "Rome, Italy"),
    "brassring": (None, None, None, "Remote site"), "pageup": (None, None, None, "Sydney, Remote"), "dayforce": ("Reno", "NV", None, "Reno, NV"), "schemaorg": ("Remote", None, "US", "Remote, US"), "ceipal": (None, None, None, "Reno"),
}


@pytest.mark.parametrize("source", CASES)
def test_source(spark, source):
    assert source in feeds.RULES
    payload, want = CASES[source]
    df = spark.createDataFrame([(1, json.dumps(payload), "Board"), (2, "{}", "Board"), (3, "[1]", "Board")], "ord long, payload string, company string")
    rows = {r.ord: r.asDict() for r in feeds.normalize(df, source).collect()}
    assert {k: rows[1][k] if rows[1][k] is None or isinstance(want[k], bool) else str(rows[1][k]) for k in want} == want
    if source in PAY:
        assert tuple(rows[1]["salary"]) == PAY[source]
    if source in PLACES:
        assert tuple(rows[1]["locations"][0])[:4] == PLACES[source]
    assert rows[2]["company"] == "Board"
    assert rows[2]["salary"] is None and rows[3]["locations"] == []


def test_amounts_in_cents_and_relative_days(spark):
    row = {"idParam": "1", "salaryAmountFrom": {"amount": 5000000, "currency": "EUR"}, "salaryAmountTo": {"amount": "6000000", "currency": "EUR"}, "salaryFrequency": "PER_YEAR"}
    yen = {"idParam": "2", "salaryAmountFrom": {"amount": 5000000, "currency": "JPY"}}
    df = spark.createDataFrame([(1, json.dumps(row)), (2, json.dumps(yen))], "ord long, payload string")
    got = {r.ord: tuple(r.salary) for r in feeds.normalize(df, "join").collect()}
    assert got == {1: (50000.0, 60000.0, "EUR", "year"), 2: (5000000.0, None, "JPY", None)}
    said = ["Posted Today", "Posted Yesterday", "Posted 30+ Days Ago", "Posted"]
    df = spark.createDataFrame([(k, json.dumps({"postedOn": x})) for k, x in enumerate(said)], "ord long, payload string")
    days = {r.ord: r.d for r in feeds.normalize(df, "workday").selectExpr("ord", "datediff(current_timestamp(), to_timestamp(posted_at)) AS d").collect()}
    assert days == {0: 0, 1: 1, 2: 30, 3: None}
