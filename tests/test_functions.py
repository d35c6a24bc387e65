"""Keys, texts, vectors and extractors on hand-checked values."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobquarry.functions import extract, keys, text, vectors


def column(spark, values, expr, kind="string"):
    """Results of an expression over a column ``x`` of values, in order."""
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r.y for r in df.select("k", expr(F.col("x")).alias("y")).orderBy("k").collect()]


def test_company_and_role_keys(spark):
    names = ["Acme, Inc.", "ACME GmbH", "The Company", "A&B Holdings Ltd", "", None, "Straße AG 24"]
    assert column(spark, names, keys.company_key) == ["acme", "acme", "the company", "a and b", "", "", "stra e 24"]
    titles = ["Sr. Backend Engineer", "Senior  Backend Engineer", "Lead", "Engineer III"]
    assert column(spark, titles, keys.role_family) == ["backend engineer", "backend engineer", "lead", "engineer"]


@pytest.mark.parametrize("x", [0.0, 1.0, -2.5, 120000.0, 1e7, 12345678.9, 1e15, 1e16, 1.5e22, 0.001, 0.0001, 0.00001, 1.25e-7, 99999999.99, 123456789012345.6, -3e-5, 1e300])
def test_floats_print_as_python_prints_them(spark, x):
    assert column(spark, [x], keys.python_float, "double") == [str(x)]


def test_null_float_prints_none(spark):
    assert column(spark, [None], keys.python_float, "double") == ["None"]


def test_hashes(spark):
    salary = F.struct(F.lit(100000.0).alias("min_amount"), F.lit(None).cast("double").alias("max_amount"), F.lit("USD").alias("currency"), F.lit("year").alias("interval"))
    got = column(spark, ["Acme Inc"], lambda c: keys.content_hash(c, F.lit("Senior Nurse"), F.lit("senior"), F.lit("Berlin, DE"), salary))[0]
    assert got == hashlib.sha1(b"acme|nurse|senior|berlin, de|100000.0|None|USD").hexdigest()[:16]
    none = column(spark, ["Acme Inc"], lambda c: keys.content_hash(c, F.lit("Nurse"), F.lit("unknown"), F.lit(None).cast("string"), F.lit(None).cast("struct<min_amount:double,max_amount:double,currency:string>")))[0]
    assert none == hashlib.sha1(b"acme|nurse|unknown||").hexdigest()[:16]
    assert column(spark, ["lever"], lambda c: keys.posting_id(c, F.lit("42"))) == [hashlib.sha1(b"lever:42").hexdigest()[:16]]
    ids = column(spark, [["b", "a", "b"], []], keys.idset_hash, "array<string>")
    assert ids == [hashlib.sha1(b"a\0b\0").hexdigest(), hashlib.sha1(b"").hexdigest()]
    assert column(spark, ["join.com", "x.y"], lambda c: keys.sha1_mod(c, 19)) == [int(hashlib.sha1(v.encode()).hexdigest(), 16) % 19 for v in ("join.com", "x.y")]
    assert column(spark, ["AI/ML", None, "--", "Health & Care"], keys.sector_slug) == ["ai-ml", "unknown", "unknown", "health-care"]


def test_plain_text(spark):
    assert column(spark, ["<p>a<b>b</b>\n c</p>", "", None], text.strip_tags) == ["a b c", "", None]
    pairs = [("Text", "<p>x"), ("", "<p>Y  z</p>"), (None, None)]
    df = spark.createDataFrame(pairs, "t string, h string")
    rows = df.select(text.snippet(F.col("t"), F.col("h")).alias("s"), text.normalized_body(F.col("t"), F.col("h")).alias("n")).collect()
    assert [tuple(r) for r in rows] == [("Text", "text"), ("Y z", "y z"), (None, "")]


def test_hosts(spark):
    urls = ["https://user@Jobs.Acme.co.uk:8080/x?y", "http://a.b.example.com#f", "no url", None]
    assert column(spark, urls, text.host_of) == ["jobs.acme.co.uk", "a.b.example.com", "", None]
    hosts = ["a.b.acme.co.uk", "acme.co.uk", "x.example.com", "localhost", "t.wd5.tenant.com", "u@h.com:1"]
    assert column(spark, hosts, lambda c: text.registrable_domain(c, ("tenant.com",))) == ["acme.co.uk", "acme.co.uk", "example.com", "localhost", "t.wd5.tenant.com", "h.com"]
    assert column(spark, ["a.b.c"], text.domain_candidates) == [["a.b.c", "b.c"]]


def test_cue_windows(spark):
    filler = "x " * 400
    body = f"{filler}salary one {filler}{filler}experience two {filler}"
    got, short, plain = column(spark, [body, "short", "y" * 900], text.cue_windows)
    first, second = got.split(" … ")
    assert "salary" in first and "experience" in second and len(first) == 2 * 250 + len("salary")
    assert short == "short" and plain == "y" * 250
    close = column(spark, [filler + "salary and pay " + filler], text.cue_windows)[0]
    assert " … " not in close and len(close) == 250 + len("salary and pay") + 250


def test_salary_text(spark):
    kind = "struct<min_amount:double,max_amount:double,currency:string,interval:string>"
    values = [(100000.0, 150000.0, "USD", "year"), (50.0, 50.0, None, "hour"), (None, 3000.0, "EUR", None), (None, None, "USD", "year"), (1234.5, None, "", None)]
    assert column(spark, values, text.salary_text, kind) == ["USD 100,000–150,000/year", "50/hour", "EUR 3,000", "", "1,234"]


def test_vectors(spark):
    rng = np.random.default_rng(0)
    xs = [[float(v) for v in rng.standard_normal(12).astype(np.float32)] for _ in range(20)] + [[0.0] * 12]
    got = column(spark, xs, vectors.quantize, "array<float>")
    for x, q in zip(xs, got, strict=True):
        a = np.asarray(x, np.float32)
        scale = (float(np.abs(a).max()) / 127.0) or 1.0
        assert q.values if False else list(q["values"]) == np.clip(np.rint(a / np.float32(scale)), -127, 127).astype(int).tolist()
    cos = column(spark, xs, lambda c: vectors.cosine(c, F.array(*[F.lit(v) for v in xs[0]])), "array<float>")
    assert abs(cos[0] - 1) < 1e-9 and cos[-1] == 0.0


TITLES = {
    "Software Engineering Intern": "intern", "Werkstudent (m/w/d)": "intern", "Director of Sales": "director", "Head of Growth": "director", "VP Engineering": "executive", "CTO": "executive",
    "Manager, Data": "manager", "Senior Manager, Ops": "manager", "Engineering Manager": "manager", "Senior Product Manager": "senior", "Product Manager": "unknown", "Assistant Manager": "unknown",
    "Shift Supervisor": "manager", "Principal Scientist": "principal", "Technical Fellow": "principal", "Senior Member of Technical Staff": "senior", "Member of Technical Staff": "mid",
    "Staff Engineer": "staff", "Staff Nurse": "unknown", "Lead Designer": "lead", "Mid / Senior Dev": "mid", "Sr. Dev": "senior", "Jr Dev": "junior", "New Grad Engineer": "entry", "Associate, Markets": "entry",
    "SDR": "entry", "Assistant Professor": "entry", "Research Fellow": "junior", "Engineer I/II": "unknown", "Engineer L5": "senior", "Engineer IC7": "principal", "Analyst III": "senior", "Analyst VI": "principal",
    "Analyst V": "staff", "Technician 2": "mid", "Account Executive": "entry", "Enterprise Account Executive": "unknown", "Baker": "unknown", "": "unknown",
}


def test_levels(spark):
    got = column(spark, list(TITLES), extract.level_from_title)
    assert dict(zip(TITLES, got, strict=True)) == TITLES
    assert column(spark, ["Mid-Senior level", "Team Lead", "Entry level", "", None, "VP"], extract.level_from_stated) == ["senior", "lead", "entry", "unknown", "unknown", "executive"]
    assert column(spark, [0, 1, 4, 5, None], lambda c: extract.level_from_years(c, F.lit(None).cast("int")), "int") == ["entry", "entry", "mid", "senior", "unknown"]
    assert column(spark, ["A new-grad role", "summer intern", "senior leaders"], extract.level_from_text) == ["entry", "intern", "unknown"]


def test_sponsorship(spark):
    texts = {
        "We will sponsor visas.": True, "Visa sponsorship available": True, "We do not sponsor visas": False, "unable to offer visa sponsorship": False, "must not require sponsorship": False,
        "without sponsorship": False, "no visa sponsorship": False, "Sponsored by Acme": None, "nothing here": None,
    }
    assert dict(zip(texts, column(spark, list(texts), extract.sponsorship), strict=True)) == texts
    assert column(spark, [None], extract.sponsorship) == [None]


def test_skills_and_fit(spark):
    texts = ["Python, C++ and AWS.", "html only, xml", "to excel in sales", "Advanced Excel", "REST APIs with k8s", None]
    assert column(spark, texts, extract.skills) == [["aws", "c++", "python"], ["html"], [], ["excel"], ["kubernetes", "rest"], []]
    df = spark.createDataFrame([("python sql docker", "python aws sql")], "cv string, jd string")
    r = df.select(*[c.alias(k) for k, c in extract.fit(F.col("cv"), F.col("jd")).items()]).first()
    assert (r.matched, r.missing, r.extra, r.coverage) == (["python", "sql"], ["aws"], ["docker"], 0.67)


def test_language(spark):
    texts = ["we are the team and you will be with us", "wir sind das team und die stelle ist für sie mit uns", "nous sommes dans la ville et vous êtes chez nous pour le poste", "el equipo de la empresa busca para los clientes con experiencia", "", None]
    assert column(spark, texts, extract.language) == ["en", "de", "fr", "es", "en", "en"]


def test_amounts(spark):
    given = {"120,000": 120000.0, "120.000": 120000.0, "1.234,56": 1234.56, "1,234.56": 1234.56, "85k": 85000.0, "45 000": 45000.0, "1,5": 1.5, "0": None, "abc": None, "1.234.567": 1234567.0}
    assert dict(zip(given, column(spark, list(given), extract.amount), strict=True)) == given
    assert column(spark, [20.0, 5000.0, 90000.0], extract.infer_interval, "double") == ["hour", "year", "year"]
    assert column(spark, [20.0, 5.0], lambda c: extract.in_band(c, F.lit("hour")), "double") == [True, False]


def test_sector_words(spark):
    names = {"First National Bank": "Banking/Finance", "Educação Global": "Education", "Sunrise Real Estate": "RealEstate/PropTech", "Embankment Ltd": None, "Acme Renewable Energy": "Energy/Climate", "": None}
    assert dict(zip(names, column(spark, list(names), extract.sector_from_name), strict=True)) == names
    assert column(spark, ["Zażółć Ñandú e\u0301"], text.fold) == ["Zazołc Nandu e"]
