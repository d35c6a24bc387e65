"""Sectors of companies from their slugs and domains, inputs of the sector model, and the model's decision rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobquarry.functions import vectors

# Pieces of names, endings of domains, and words, each with its sector; the first that fits counts.
PIECES = (
    ("Biotech/Pharma", "biotech pharma genomic therapeut biosci molecular vaccine oncolog antibod peptide lifescience biolog protein crispr diagnostic"),
    ("Healthcare", "health medical dental clinic hospital patient caregiv medtech pharmacy wellness behavioral therapy nursing homecare telehealth orthod veterin physio"),
    ("Crypto/Web3", "crypto blockchain web3 defi onchain ledger bitcoin ethereum stablecoin tokeniz dao"),
    ("Cybersecurity", "cyber security infosec firewall appsec pentest threatintel endpoint_security zerotrust secureworks"),
    ("Semiconductors/Hardware", "semiconduct silicon microchip fpga wafer hardware electronics robotic sensors lidar photonic chipmaker"),
    ("Aerospace/Defense", "aerospace aviation satellite spacecraft rocket defense defence missile orbital avionic drones uav"),
    ("Automotive/Mobility", "automotiv vehicle mobility rideshare carshare fleet autonomous motors ev_charging escooter emobility"),
    ("Energy/Climate", "energy solar climate renewab battery cleantech geotherm carbon sustainab powergrid hydrogen windpower decarbon greentech"),
    ("Gaming", "games gaming esports gamestudio playstation videogame gamedev"),
    ("Fintech", "fintech payments paytech lending neobank remittance payroll bnpl wallet billing invoicing spend_management"),
    ("Banking/Finance", "banking bancorp capital securities asset_management equities financ investment brokerage hedge wealth tradingfirm fund_management venture"),
    ("Insurance", "insurance insurtech assurance underwrit reinsur actuar"),
    ("Logistics/SupplyChain", "logistic supplychain supply_chain freight shipping cargo warehous fulfillment lastmile courier trucking 3pl"),
    ("RealEstate/PropTech", "realestate real_estate proptech realty mortgage housing rental property_management homebuild brokerage_real"),
    ("Education", "education edtech learning academy university college tutor bootcamp elearning schooldistrict curriculum kindergarten"),
    ("Travel/Hospitality", "travel hospitality tourism airline booking resort vacation hotelier cruise"),
    ("Food/Beverage", "foods beverage restaurant coffee brewery brewing grocery kitchen winery distillery snacks bakery foodservice"),
    ("Telecom", "telecom wireless broadband fiber cellular telco 5gnetwork"),
    ("Media/Entertainment", "media entertainment music film podcast streaming publishing broadcast newsroom studios records"),
    ("E-commerce/Retail", "ecommerce e-commerce commerce retail shopify marketplace dropship merch storefront"),
    ("Consumer/Lifestyle", "beauty fashion fitness apparel cosmetic lifestyle skincare footwear sportswear jewelry wellness_brand"),
    ("Manufacturing/Industrial", "manufactur industrial factory machinery steelworks materials construction fabricat foundry toolmaker plastics welding"),
    ("Government/Public", "government cityof county municipal federal nonprofit publicsector ngo stategov"),
    ("Consulting/Services", "consult advisory staffing recruit outsourc managed_services systemsintegr professionalservices accountancy lawfirm legalservices"),
    ("AI/ML", "artificial_intelligence machine_learning deeplearning generative computer_vision neural datascience"),
    ("Software/SaaS", "software saas cloud platform devtools developer analytics database automation infrastructure techlabs appdev lowcode nocode crm erp"),
)
ENDINGS = {
    ".ai": "AI/ML", ".health": "Healthcare", ".care": "Healthcare", ".games": "Gaming", ".gg": "Gaming", ".finance": "Banking/Finance", ".capital": "Banking/Finance", ".bank": "Banking/Finance",
    ".insurance": "Insurance", ".energy": "Energy/Climate", ".eco": "Energy/Climate", ".auto": "Automotive/Mobility", ".cars": "Automotive/Mobility", ".realestate": "RealEstate/PropTech",
    ".estate": "RealEstate/PropTech", ".homes": "RealEstate/PropTech", ".travel": "Travel/Hospitality", ".media": "Media/Entertainment", ".fm": "Media/Entertainment", ".tv": "Media/Entertainment",
    ".shop": "E-commerce/Retail", ".store": "E-commerce/Retail", ".law": "Consulting/Services", ".legal": "Consulting/Services", ".edu": "Education", ".academy": "Education", ".dev": "Software/SaaS",
    ".app": "Software/SaaS", ".cloud": "Software/SaaS", ".software": "Software/SaaS", ".tech": "Software/SaaS", ".io": "Software/SaaS", ".so": "Software/SaaS",
}
WORDS = (
    ("AI/ML", r"(^|[ \-_.])ai($|[ \-_.])|\bml\b|\bllm\b|\bgpt\b"), ("Crypto/Web3", r"\bnft\b|\bcoin\b|\bdao\b"), ("Gaming", r"\bgame\b|\bplay\b"), ("Banking/Finance", r"\bbank\b|\bvc\b|\bfund\b"),
    ("Fintech", r"\bpay\b|\bfin\b"), ("Energy/Climate", r"\bgrid\b|\bwind\b|\bev\b"), ("Aerospace/Defense", r"\bspace\b|\baero\b"),
)
ENDING_GROUPS = {
    "education": (".edu", ".ac.uk", ".edu.au"), "finance": (".bank", ".finance", ".insurance"), "government": (".gov", ".mil", ".gov.uk"), "health": (".health", ".care"), "media": (".tv", ".fm", ".news"),
    "tech": (".ai", ".io", ".dev", ".app", ".tech"),
}
SECOND_LEVELS = ("co", "com", "ac", "gov", "edu")


def sector_from_slug(slug: Column, domain: Column) -> Column:
    """The sector that a company's slug and domain tell; null if nothing does."""
    d = F.lower(F.coalesce(domain, F.lit("")))
    joined = F.concat(F.lower(slug), d)
    spaced = F.translate(F.concat(F.lower(slug), F.lit(" "), d), "-_", "  ")
    found = []
    for sector, pieces in PIECES:
        pattern = F.lit("|".join(p.replace("_", " ") for p in pieces.split()))
        found.append(F.when(F.regexp_like(joined, pattern) | F.regexp_like(spaced, pattern), sector))
    found += [F.when(F.endswith(d, F.lit(e)), s) for e, s in ENDINGS.items()]
    found += [F.when(F.regexp_like(spaced, F.lit(p)), s) for s, p in WORDS]
    return F.coalesce(*found)


def domain_label(domain: Column) -> Column:
    """The label of a domain under its ending: ``careers.acme-bank.com`` gives ``acme-bank``."""
    host = F.split_part(F.lower(F.trim(domain)), F.lit("/"), F.lit(1))
    parts = F.filter(F.split(host, r"\."), lambda p: p != "")
    n = F.size(parts)
    deep = F.element_at(parts, -2).isin(*SECOND_LEVELS) & (n >= 3)
    return F.when(n >= 2, F.when(deep, F.element_at(parts, -3)).otherwise(F.element_at(parts, -2))).otherwise(F.get(parts, 0))


def model_text(name: Column, domain: Column, title: Column) -> Column:
    """What the sector model embeds: name, domain label and an example title, those that are there."""
    parts = [F.nullif(F.trim(c), F.lit("")) for c in (name, domain_label(domain), title)]
    return F.trim(F.regexp_replace(F.concat_ws(". ", *parts), r"\s+", " "))


def ending_features(domain: Column) -> Column:
    """One 1.0 for the first group of endings that fits, by name of the group; else zeros."""
    host = F.split_part(F.lower(F.trim(F.coalesce(domain, F.lit("")))), F.lit("/"), F.lit(1))
    nth = F.lit(-1)
    for k, endings in reversed(list(enumerate(ENDING_GROUPS.values()))):
        fits = F.lit(False)
        for e in endings:
            fits = fits | F.endswith(host, F.lit(e))
        nth = F.when(fits, k).otherwise(nth)
    return F.array(*[F.when(nth == k, 1.0).otherwise(0.0) for k in range(len(ENDING_GROUPS))])


def centred_unit(vector: Column, mean: list[float]) -> Column:
    """A vector less the mean, scaled to length 1; zeros stay."""
    centred = F.zip_with(vector, F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a.cast("double") - b)
    length = vectors.norm(centred)
    return F.transform(centred, lambda x: x / F.when(length > 0, length).otherwise(1.0))


def model_features(vector: Column, domain: Column, mean: list[float]) -> Column:
    return F.concat(centred_unit(vector, mean), ending_features(domain))


def decide(features: Column, model: dict) -> Column:
    """The model's sector (``label``, null where it abstains) and probability (``p``).

    ``model``: labels, weights (a row for each label), bias, a and b of the sigmoids that make scores probabilities, centroids,
    and three gates: the least probability, margin to the second, and cosine to the label's centroid."""
    row = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    raw = []
    for k, label in enumerate(model["labels"]):
        score = vectors.dot(features, row(model["weights"][k])) + float(model["bias"][k])
        calibrated = 1.0 / (1.0 + F.exp(-(float(model["a"][k]) * score + float(model["b"][k]))))
        raw.append(F.struct(calibrated.alias("p"), F.lit(-k).alias("order"), F.lit(label).alias("label"), vectors.cosine(features, row(model["centroids"][k])).alias("sim")))
    ranked = F.reverse(F.array_sort(F.array(*raw)))
    total = F.aggregate(ranked, F.lit(0.0), lambda s, x: s + x["p"])
    first, second = F.get(ranked, 0), F.coalesce(F.get(ranked, 1)["p"], F.lit(0.0))
    p = first["p"] / total
    sure = (p >= float(model["least_p"])) & (p - second / total >= float(model["least_margin"])) & (first["sim"] >= float(model["least_sim"]))
    return F.struct(F.when(sure, first["label"]).alias("label"), p.alias("p"))
