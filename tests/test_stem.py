"""Stems with known answers, and retrieval by them."""

from pyspark.sql import functions as F

from jobquarry.functions import stem
from jobquarry.plans.search import SearchQuery, matching

KNOWN = (
    "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss"
    " failing fail filing file happy happi sky sky relational relat conditional condit rational ration vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis"
    " hopefulness hope triplicate triplic formative form formalize formal electrical electr goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust"
    " defensible defens replacement replac adoption adopt communism commun activate activ homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll"
    " engineering engin engineers engin is is"
).split()


def test_stems():
    pairs = dict(zip(KNOWN[::2], KNOWN[1::2], strict=True))
    assert {w: stem.stem(w) for w in pairs} == pairs
    assert stem.words("Ingénieurs, ENGINEERING!") == ["ingenieur", "engin"] and stem.words(None) == []


def test_retrieval_by_stems(spark):
    from .test_engine import jobs

    df = jobs(spark, [{"id": "a", "title": "Data Engineers"}, {"id": "b", "title": "Data Engine"}, {"id": "c", "title": "Baker"}])
    q = SearchQuery(keywords="engineering data")
    assert [r.id for r in matching(df, q, "2024-01-01").collect()] == []
    assert sorted(r.id for r in matching(df, q, "2024-01-01", stemmed=True).collect()) == ["a", "b"]
    assert [r.x for r in spark.createDataFrame([("Nurses",)], "t string").select(stem.stems(F.col("t")).alias("x")).collect()] == [["nurs"]]
