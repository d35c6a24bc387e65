"""Enrichment from text, as column expressions: language, level, sponsorship policy, skills, pay bands.

Patterns and word lists below are fixed values: results depend on them as they stand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobquarry.functions import keys
from jobquarry.functions.text import fold

# ---- language -------------------------------------------------------------------------------------------------------

# Frequent function words that belong to one language.
STOPWORDS = {
    "en": "the and of to in for with on is are we you our your will be that this as at by an or have has from but not all can its was were which who what if than then so such these those about",
    "de": "der die das und mit für von auf ist sind wir ihre ihr werden sein dass dies diese bei eine einer einen oder haben aber nicht alle kann waren welche wenn dann solche zum zur nach über"
    " unter durch auch noch sehr ohne sowie dabei unsere ihnen gerne bitte berufserfahrung erfahrung kenntnisse unternehmen mitarbeiter",
    "fr": "le la les et de des du une sont nous vous notre votre être que ce cette ces comme chez au aux ou avoir mais ne pas tout tous peut son sa ses étaient qui quoi donc dans sur par plus très"
    " vos expérience poste équipe entreprise",
    "es": "el la los las y de del una son nosotros usted nuestro nuestra su sus ser que este esta estos como al tener tiene pero todo todos puede eran quien si entonces para por con más muy empresa"
    " experiencia equipo trabajo buscamos",
}
SAMPLE, MARGIN = 500, 3


def language(text: Column) -> Column:
    """The language whose function words are most frequent in the head of a text, if it beats English by ``MARGIN``;
    of equal ones the first in order; else English. A limit to the head is the rule itself."""
    words = F.regexp_extract_all(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, SAMPLE)), F.lit(r"[\p{L}]+"), F.lit(0))
    hits = {lang: F.size(F.filter(words, _among(stop.split()))) for lang, stop in STOPWORDS.items()}
    others = F.greatest(hits["de"], hits["fr"], hits["es"])
    best = F.when(hits["de"] == others, "de").when(hits["fr"] == others, "fr").otherwise("es")
    return F.when(others - hits["en"] >= MARGIN, best).otherwise("en")


def _among(words: list[str]):
    return lambda w: w.isin(*words)


# ---- level ----------------------------------------------------------------------------------------------------------

# What titles say, in the order in which it counts; (?i) ignores case, patterns without it don't.
INTERN = r"(?i)\b(?:intern|internship|co-?op|apprentice|werk?student|werkstudent|praktikant|praktikum|v\.i\.e\.?|student\s+(?:assistant|worker|position|intern|trainee)|working\s+student)\b"
DIRECTOR = r"(?i)\b(?:director|head of|avp|assistant vice president)\b"
EXECUTIVE = r"(?i)\b(?:chief|c[etfoi]o|ciso|chro|cso|cro|cdo|cxo|cmo|cpo|svp|evp|vp|vice president|president)\b"
LEADING_MANAGER = r"(?i)^\s*(?:senior\s+|sr\.?\s+)?managers?\b"
MANAGER_WORD = r"(?i)\b(?:managers?|mgr|supervisors?|people lead)\b"
SUB_MANAGER = r"(?i)\b(?:assistant|associate)\s+managers?\b"
PEOPLE_MANAGER = (
    r"(?i)^\s*managers?\b|\b(?:people lead)\b|\b(?:engineering|software engineering|data engineering|data science|quality assurance|quality|regulatory affairs|district|payroll"
    r"|administration|design)\s+(?:managers?|mgr)\b"
)
IC_MANAGER = (
    r"(?i)\b(?:product marketing|customer success|technical success|client success|product|account|project|program|programme|marketing|community|channel|category|brand|growth|partner"
    r"|partnership|partnerships|sales|operations|success|delivery|implementation|launch|market|country|content|influencer|territory|field|revenue|deployment|engagement|activation|relationship"
    r"|portfolio|customer|client|supply|installation|pr|public relations|business development|case)\s+(?:managers?|mgr)\b"
)
PRINCIPAL = r"(?i)\b(?:principal|distinguished|princ)\b|\b(?:technical|distinguished|principal|senior)\s+fellow\b|\bfellow\s+engineer\b"
TECHNICAL_STAFF = r"(?i)\bmember of technical staff\b|\bmts\b"
STAFF = r"(?i)\bstaff\b"
RANK_AND_FILE = (
    r"(?i)\bstaff\s+(?:accountant|nurse|auditor|pharmacist|writer|assistant|clerk|bookkeeper|therapist|technician|attorney|paralegal|cpa|cashier|associate|receptionist|physician|dentist"
    r"|hygienist|teacher|editor|reporter)\b"
)
LEAD = r"(?i)\b(?:lead|tech lead|team lead)\b"
MID_SENIOR = r"(?i)\bmid\s*/\s*senior\b"
SENIOR = r"(?i)\b(?:senior|sr\.?|snr)\b"
JUNIOR = r"(?i)\b(?:junior|jr\.?|jnr)\b"
ENTRY = (
    r"(?i)\b(?:entry[- ]level|new ?grads?|graduate|trainee|early[- ]career|campus (?:hire|recruit(?:ing|ment)?))\b|^\s*associate,|\b(?:business |partner |sales )?development representative\b"
    r"|\bsales development\b|\b[bs]dr\b"
)
ACADEMIC = (
    (r"(?i)\bassistant professor\b", "entry"),
    (r"(?i)\bassociate professor\b", "mid"),
    (r"(?i)\b(?:post-?doctoral|post-?doc)\b", "junior"),
    (r"(?i)\b(?:research|postdoctoral|postdoc|teaching|clinical) fellow\b", "junior"),
)
ROMAN_RANGE = r"\b(?:I{1,3}|IV|V)\s*[/\-–]\s*(?:I{1,3}|IV|V)(?:\s*[/\-–]\s*(?:I{1,3}|IV|V))?\b"
TOKEN_EARLY, TOKEN_MID = r"(?i)\(\s*early\b|\bearly[- ]career\b", r"(?i)\(\s*mid\b|\bmid[- ]level\b"
LADDER = r"\b(?:IC|[LEP])-?([1-9])\b"
LADDER_LEVELS = ("entry", "entry", "mid", "mid", "senior", "staff", "principal", "principal", "principal")
ROMAN = ((r"\bVI\b", "principal"), (r"\bV\b", "staff"), (r"\b(?:III|IV)\b", "senior"), (r"\bII\b", "mid"), (r"\bI\b", "entry"))
ARABIC, ARABIC_LEVELS = r"\b([1-4])\b", ("entry", "mid", "senior", "senior")
ENTRY_RAMP = r"(?i)\b(?:account executive|sales consultant|financial advisor|insurance agent|leasing consultant)\b"
NOT_ENTRY_RAMP = r"(?i)\b(?:enterprise|strategic|majors?|named|key|national|global|commercial|mid[- ]?market|smb|experienced)\b"
TEXT_INTERN = r"(?i)\b(?:internship|summer intern|intern(?:ship)?\s+(?:program|position)|co-?op program)\b"
TEXT_ENTRY = (
    r"(?i)\b(?:new[- ]?grad(?:uate)?s?|recent (?:college )?graduates?|new college graduates?|entry[- ]level (?:role|position|opportunity|hire)?|early[- ]career|university graduate program"
    r"|campus (?:hire|recruit(?:ing)?)|no (?:prior |professional )?experience (?:is )?(?:required|necessary|needed))\b"
)
# Levels that applicant systems state, by words in them.
STATED_LEVELS = {
    "internship": "intern", "intern": "intern", "trainee": "intern", "entry level": "entry", "entry": "entry", "graduate": "entry", "junior": "junior", "associate": "junior",
    "mid senior level": "senior", "mid senior": "senior", "mid level": "mid", "mid": "mid", "intermediate": "mid", "experienced": "mid", "professional": "mid", "senior level": "senior",
    "senior": "senior", "staff": "staff", "principal": "principal", "lead": "lead", "team lead": "lead", "manager supervisor": "manager", "manager": "manager", "management": "manager",
    "director": "director", "vp": "executive", "executive": "executive",
}


def level_from_title(title: Column) -> Column:
    """Seniority from a title; the first rule that applies counts."""
    t = F.coalesce(title, F.lit(""))
    says = lambda p: F.regexp_like(t, F.lit(p))
    people = says(MANAGER_WORD) & ~says(SUB_MANAGER) & (says(PEOPLE_MANAGER) | ~says(IC_MANAGER))
    rules = [
        (says(INTERN), F.lit("intern")),
        (says(DIRECTOR), F.lit("director")),
        (says(EXECUTIVE), F.lit("executive")),
        (says(LEADING_MANAGER) | people, F.lit("manager")),
        (says(PRINCIPAL), F.lit("principal")),
        (says(TECHNICAL_STAFF), F.when(says(SENIOR), "senior").otherwise("mid")),
        (says(STAFF) & ~says(RANK_AND_FILE), F.lit("staff")),
        (says(LEAD), F.lit("lead")),
        (says(MID_SENIOR), F.lit("mid")),
        (says(SENIOR), F.lit("senior")),
        (says(JUNIOR), F.lit("junior")),
        (says(ENTRY), F.lit("entry")),
        *[(says(p), F.lit(v)) for p, v in ACADEMIC],
    ]
    token = level_from_token(t)
    ramp = F.when(says(ENTRY_RAMP) & ~says(NOT_ENTRY_RAMP), "entry").otherwise("unknown")
    out = F.coalesce(token, ramp)
    for test, value in reversed(rules):
        out = F.when(test, value).otherwise(out)
    return out


def level_from_token(title: Column) -> Column:
    """The level that a numeral or a ladder code in a title stands for, else null; a range stands for none."""
    t = F.replace(F.replace(title, F.lit("​"), F.lit("")), F.lit(" "), F.lit(" "))
    ladder, arabic = F.regexp_extract(title, LADDER, 1), F.regexp_extract(t, ARABIC, 1)
    pick = lambda found, levels: F.get(F.array(*[F.lit(x) for x in levels]), F.try_to_number(found, F.lit("9")).cast("int") - 1)
    out = F.when(arabic != "", pick(F.nullif(arabic, F.lit("")), ARABIC_LEVELS))
    for pattern, value in reversed(ROMAN):
        out = F.when(F.regexp_like(t, F.lit(pattern)), value).otherwise(out)
    out = F.when(ladder != "", pick(F.nullif(ladder, F.lit("")), LADDER_LEVELS)).otherwise(out)
    out = F.when(F.regexp_like(title, F.lit(TOKEN_EARLY)), "entry").when(F.regexp_like(title, F.lit(TOKEN_MID)), "mid").otherwise(out)
    return F.when(~F.regexp_like(title, F.lit(ROMAN_RANGE)), out)


def level_from_text(text: Column) -> Column:
    """Only what a description says plainly: internships and first jobs."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.regexp_like(t, F.lit(TEXT_INTERN)), "intern").when(F.regexp_like(t, F.lit(TEXT_ENTRY)), "entry").otherwise("unknown")


def level_from_years(low: Column, high: Column) -> Column:
    years = F.coalesce(low, high)
    return F.when(years <= 1, "entry").when(years <= 4, "mid").when(years.isNotNull(), "senior").otherwise("unknown")


def level_from_stated(value: Column) -> Column:
    """The level that an applicant system states; the longest of the known words decides."""
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[-/]", " "), r"\s+", " "))
    out = F.lit("unknown")
    for word in sorted(STATED_LEVELS, key=len):
        out = F.when(F.contains(norm, F.lit(word)), STATED_LEVELS[word]).otherwise(out)
    return out


# ---- sponsorship ----------------------------------------------------------------------------------------------------

# How postings refuse sponsorship, and how they offer it.
NO_SPONSOR = (
    r"(?i)(?:not?\s+(?:able|eligible|in\s+a\s+position)\s+to\s+(?:provide|offer|sponsor)"
    r"|unable\s+to\s+(?:provide|offer|sponsor)\w*[^.]{0,30}sponsor"
    r"|(?:do(?:es)?\s+not|don'?t|doesn'?t|cannot|can'?t|will\s+not|won'?t|are\s+not|is\s+not)\s+(?:be\s+)?(?:able\s+to\s+)?(?:provide|offer|sponsor)\w*[^.]{0,30}sponsor"
    r"|(?:do(?:es)?\s+not|don'?t|doesn'?t|cannot|can'?t|will\s+not|won'?t|are\s+not|is\s+not|unable\s+to|never)\s+(?:\w+\s+){0,3}sponsor\b"
    r"|no\s+(?:\w+\s+){0,2}sponsorship"
    r"|without\s+(?:requiring\s+|the\s+need\s+for\s+)?(?:visa\s+|work\s+|employer\s+|employment\s+)?sponsorship"
    r"|(?:must|should|can|will)\s+not\s+require\s+(?:visa\s+|work\s+)?sponsorship"
    r"|not\s+require\s+(?:visa\s+|work\s+)?sponsorship\s+(?:now|currently|at\s+this\s+time)"
    r"|(?:not|isn'?t|aren'?t)\s+(?:eligible\s+for|open\s+to|able\s+to\s+offer)\s+(?:visa\s+)?sponsorship"
    r"|sponsorship\s+(?:is|are|will)\s*(?:not|n'?t)\s+(?:be\s+)?(?:available|provided|offered)"
    r"|sponsorship\s+(?:\w+\s+){0,2}(?:is|are)\s+not\s+(?:available|provided|offered)"
    r"|not?\s+(?:able|eligible)\s+to\s+support\s+(?:\w+\s+){0,2}sponsor"
    r"|(?:authoriz|authoris)\w+\s+to\s+work[^.]{0,40}without[^.]{0,25}sponsor)"
)
SPONSOR = (
    r"(?i)(?:(?:visa\s+|work\s+|h-?1b\s+|employment\s+|green\s*card\s+)?sponsorship\s+(?:is\s+|are\s+)?(?:available|offered|provided|welcome|possible|considered|supported|an\s+option)"
    r"|(?:will|can|able\s+to|happy\s+to|open\s+to|willing\s+to|glad\s+to)\s+(?:provide\s+|offer\s+)?(?:visa\s+|work\s+|h-?1b\s+)?sponsor\w*"
    r"|(?:can\s+)?help(?:\s+you)?\s+(?:to\s+)?sponsor"
    r"|we\s+(?:will\s+|can\s+|do\s+)?sponsor\b"
    r"|(?:offer|provide)\s+(?:visa\s+|work\s+|h-?1b\s+)?sponsorship"
    r"|(?:visa\s+|work\s+|h-?1b\s+)?sponsorship\s+for\s+(?:qualified|highly|eligible|the\s+right|international|exceptional|select|candidates?|applicants?)"
    r"|sponsorship\s+support\b"
    r"|(?:h-?1b|visa)\s+sponsorship\s+(?:is\s+)?available"
    r"|sponsorship\s*[:\-]\s*yes"
    r"|(?:candidates?|applicants?)\s+(?:requiring|needing|who\s+require)\s+sponsorship[^.]{0,50}(?:welcome|encouraged|considered|ok|fine)"
    r"|open\s+to\s+(?:candidates?\s+requiring\s+)?sponsorship)"
)


def sponsorship(text: Column) -> Column:
    """Whether a posting offers sponsorship: true, false, or null if it doesn't say."""
    says = lambda p: F.regexp_like(text, F.lit(p))
    return F.when(~F.contains(F.lower(text), F.lit("sponsor")), F.lit(None)).when(says(NO_SPONSOR), False).when(says(SPONSOR), True).cast("boolean")


# ---- skills ---------------------------------------------------------------------------------------------------------

# Skills, and the forms that mean them.
SKILLS = {
    "python": ("python",),
    "javascript": ("javascript", "js",),
    "typescript": ("typescript", "ts",),
    "java": ("java",),
    "c++": ("c++",),
    "c#": ("c#", "csharp",),
    ".net": (".net", "dotnet",),
    "golang": ("golang", "go-lang",),
    "rust": ("rust",),
    "ruby": ("ruby",),
    "php": ("php",),
    "swift": ("swift",),
    "kotlin": ("kotlin",),
    "scala": ("scala",),
    "perl": ("perl",),
    "sql": ("sql",),
    "bash": ("bash", "shell scripting",),
    "matlab": ("matlab",),
    "react": ("react", "react.js", "reactjs",),
    "vue": ("vue", "vue.js",),
    "angular": ("angular",),
    "node.js": ("node.js", "nodejs", "node js",),
    "next.js": ("next.js", "nextjs",),
    "django": ("django",),
    "flask": ("flask",),
    "fastapi": ("fastapi",),
    "spring": ("spring boot", "spring",),
    "rails": ("ruby on rails", "rails",),
    "graphql": ("graphql",),
    "rest": ("rest api", "rest apis", "restful",),
    "html": ("html",),
    "css": ("css",),
    "tailwind": ("tailwind",),
    "aws": ("aws", "amazon web services",),
    "gcp": ("gcp", "google cloud",),
    "azure": ("azure",),
    "kubernetes": ("kubernetes", "k8s",),
    "docker": ("docker",),
    "terraform": ("terraform",),
    "ci/cd": ("ci/cd", "cicd", "continuous integration", "continuous delivery",),
    "jenkins": ("jenkins",),
    "ansible": ("ansible",),
    "linux": ("linux",),
    "git": ("git",),
    "kafka": ("kafka",),
    "rabbitmq": ("rabbitmq",),
    "microservices": ("microservices", "microservice",),
    "machine learning": ("machine learning", "ml",),
    "deep learning": ("deep learning",),
    "nlp": ("nlp", "natural language processing",),
    "computer vision": ("computer vision",),
    "pytorch": ("pytorch",),
    "tensorflow": ("tensorflow",),
    "scikit-learn": ("scikit-learn", "sklearn",),
    "pandas": ("pandas",),
    "numpy": ("numpy",),
    "spark": ("apache spark", "pyspark", "spark",),
    "hadoop": ("hadoop",),
    "airflow": ("airflow",),
    "dbt": ("dbt",),
    "tableau": ("tableau",),
    "power bi": ("power bi", "powerbi",),
    "looker": ("looker",),
    "snowflake": ("snowflake",),
    "data engineering": ("data engineering",),
    "etl": ("etl", "elt",),
    "llm": ("llm", "llms", "large language model", "large language models",),
    "postgresql": ("postgresql", "postgres",),
    "mysql": ("mysql",),
    "mongodb": ("mongodb", "mongo",),
    "redis": ("redis",),
    "elasticsearch": ("elasticsearch",),
    "dynamodb": ("dynamodb",),
    "cassandra": ("cassandra",),
    "bigquery": ("bigquery",),
    "agile": ("agile",),
    "scrum": ("scrum",),
    "kanban": ("kanban",),
    "jira": ("jira",),
    "tdd": ("tdd", "test-driven development",),
    "unit testing": ("unit testing",),
    "project management": ("project management",),
    "stakeholder management": ("stakeholder management",),
    "data analysis": ("data analysis", "data analytics",),
    "excel": ("excel",),
    "salesforce": ("salesforce",),
    "sap": ("sap",),
    "figma": ("figma",),
    "seo": ("seo",),
    "accounting": ("accounting",),
    "financial modeling": ("financial modeling", "financial modelling",),
    "crm": ("crm",),
    "powerpoint": ("powerpoint",),
    "microsoft office": ("microsoft office", "ms office", "office 365", "microsoft 365",),
    "microsoft word": ("microsoft word",),
    "github": ("github",),
    "gitlab": ("gitlab",),
    "hubspot": ("hubspot",),
    "devops": ("devops",),
    "google analytics": ("google analytics", "ga4",),
    "google ads": ("google ads", "google adwords", "adwords",),
    "google sheets": ("google sheets",),
    "photoshop": ("photoshop",),
    "illustrator": ("illustrator",),
    "after effects": ("after effects",),
    "databricks": ("databricks",),
    "clickhouse": ("clickhouse",),
    "redshift": ("redshift", "amazon redshift",),
    "ios": ("ios",),
    "android": ("android",),
    "erp": ("erp",),
    "cad": ("cad",),
    "revit": ("revit",),
    "sas": ("sas",),
}
#: The noun: not after "to", not before a word that makes it a verb.
EXCEL = r"(?<![a-z0-9+#])(?<!\bto\s)(?<!\bto)excel(?![a-z0-9+#])(?!\s+(?:at|in|across|ly|led|ling|s)\b)"


def _quoted(form: str) -> str:
    return "".join("\\" + c if c in ".+#/()[]" else c for c in form)


def skills(text: Column) -> Column:
    """The skills that a text names, sorted."""
    t = F.lower(F.coalesce(text, F.lit("")))
    found = []
    for name in sorted(SKILLS):
        pattern = EXCEL if name == "excel" else rf"(?<![a-z0-9+#])(?:{'|'.join(map(_quoted, SKILLS[name]))})(?![a-z0-9+#])"
        found.append(F.when(F.regexp_like(t, F.lit(pattern)), name))
    return F.array_compact(F.array(*found))


def fit(resume: Column, job: Column) -> dict[str, Column]:
    """What a resume covers of a job's skills: matched, missing, further ones (ten at most), and the share covered."""
    have, want = skills(resume), skills(job)
    matched = F.array_intersect(want, have)
    return {
        "matched": matched,
        "missing": F.array_except(want, have),
        "extra": F.slice(F.array_except(have, want), 1, 10),
        "coverage": F.when(F.size(want) > 0, F.bround(F.size(matched) / F.size(want), 2)),
    }


# ---- sector ---------------------------------------------------------------------------------------------------------

# Words of company names that belong to one sector, and names of companies whose sector no word tells.
SECTOR_WORDS = {
    "healthcare": "Healthcare",
    "health system": "Healthcare",
    "hospital": "Healthcare",
    "hospitals": "Healthcare",
    "clinic": "Healthcare",
    "clinics": "Healthcare",
    "medical center": "Healthcare",
    "eyecare": "Healthcare",
    "dental": "Healthcare",
    "dentistry": "Healthcare",
    "orthodontics": "Healthcare",
    "autism": "Healthcare",
    "hospice": "Healthcare",
    "home health": "Healthcare",
    "oncology": "Healthcare",
    "pediatrics": "Healthcare",
    "cardiology": "Healthcare",
    "physicians": "Healthcare",
    "pharma": "Biotech/Pharma",
    "pharmaceutical": "Biotech/Pharma",
    "pharmaceuticals": "Biotech/Pharma",
    "biopharma": "Biotech/Pharma",
    "therapeutics": "Biotech/Pharma",
    "biosciences": "Biotech/Pharma",
    "biologics": "Biotech/Pharma",
    "genomics": "Biotech/Pharma",
    "diagnostics": "Biotech/Pharma",
    "biotech": "Biotech/Pharma",
    "bank": "Banking/Finance",
    "bancorp": "Banking/Finance",
    "bancshares": "Banking/Finance",
    "credit union": "Banking/Finance",
    "asset management": "Banking/Finance",
    "securities": "Banking/Finance",
    "investments": "Banking/Finance",
    "capital markets": "Banking/Finance",
    "insurance": "Insurance",
    "reinsurance": "Insurance",
    "indemnity": "Insurance",
    "manufacturing": "Manufacturing/Industrial",
    "machining": "Manufacturing/Industrial",
    "fabrication": "Manufacturing/Industrial",
    "foundry": "Manufacturing/Industrial",
    "steel": "Manufacturing/Industrial",
    "chemicals": "Manufacturing/Industrial",
    "packaging": "Manufacturing/Industrial",
    "plastics": "Manufacturing/Industrial",
    "university": "Education",
    "college": "Education",
    "academy": "Education",
    "school": "Education",
    "schools": "Education",
    "education": "Education",
    "educacao": "Education",
    "educacion": "Education",
    "polytechnic": "Education",
    "hospitality": "Travel/Hospitality",
    "hotel": "Travel/Hospitality",
    "hotels": "Travel/Hospitality",
    "resort": "Travel/Hospitality",
    "resorts": "Travel/Hospitality",
    "cruises": "Travel/Hospitality",
    "aerospace": "Aerospace/Defense",
    "defense": "Aerospace/Defense",
    "defence": "Aerospace/Defense",
    "avionics": "Aerospace/Defense",
    "munitions": "Aerospace/Defense",
    "armaments": "Aerospace/Defense",
    "semiconductor": "Semiconductors/Hardware",
    "semiconductors": "Semiconductors/Hardware",
    "microelectronics": "Semiconductors/Hardware",
    "photonics": "Semiconductors/Hardware",
    "logistics": "Logistics/SupplyChain",
    "freight": "Logistics/SupplyChain",
    "warehousing": "Logistics/SupplyChain",
    "trucking": "Logistics/SupplyChain",
    "supply chain": "Logistics/SupplyChain",
    "realty": "RealEstate/PropTech",
    "real estate": "RealEstate/PropTech",
    "brewing": "Food/Beverage",
    "brewery": "Food/Beverage",
    "winery": "Food/Beverage",
    "distillery": "Food/Beverage",
    "bakery": "Food/Beverage",
    "telecom": "Telecom",
    "telecommunications": "Telecom",
    "broadband": "Telecom",
    "crypto": "Crypto/Web3",
    "blockchain": "Crypto/Web3",
    "web3": "Crypto/Web3",
    "cybersecurity": "Cybersecurity",
    "consulting": "Consulting/Services",
    "consultants": "Consulting/Services",
    "esports": "Gaming",
    "games": "Gaming",
    "gaming": "Gaming",
    "fintech": "Fintech",
    "energy": "Energy/Climate",
    "solar": "Energy/Climate",
    "renewables": "Energy/Climate",
    "renewable energy": "Energy/Climate",
}
SECTOR_BRANDS = {
    "Domino's": "Food/Beverage",
    "Red Bull": "Food/Beverage",
    "Greene King": "Food/Beverage",
    "Insomnia Cookies": "Food/Beverage",
    "Insomniacookies": "Food/Beverage",
    "Guzman y Gomez": "Food/Beverage",
    "CROSSMARK": "Consulting/Services",
    "Turner & Townsend": "Consulting/Services",
    "Securitas": "Consulting/Services",
    "Inetum": "Consulting/Services",
    "Devoteam": "Consulting/Services",
    "Ramboll": "Consulting/Services",
    "Capco": "Consulting/Services",
    "Deloitte": "Consulting/Services",
    "Dexterra": "Consulting/Services",
    "Veolia Environnement": "Energy/Climate",
    "Veolia": "Energy/Climate",
    "Home Instead": "Healthcare",
    "Vohra": "Healthcare",
    "Lifestance": "Healthcare",
    "LifeStance Health": "Healthcare",
    "AgeCare": "Healthcare",
    "albanymed": "Healthcare",
    "Eurofins": "Biotech/Pharma",
    "Anduril Industries": "Aerospace/Defense",
    "Anduril": "Aerospace/Defense",
    "Boxlunch": "E-commerce/Retail",
    "advanceauto": "E-commerce/Retail",
    "METRO/MAKRO": "E-commerce/Retail",
    "Sears": "E-commerce/Retail",
    "Frasers Group": "E-commerce/Retail",
    "Maersk": "Logistics/SupplyChain",
    "Equinox": "Consumer/Lifestyle",
    "Relais & Châteaux": "Travel/Hospitality",
    "Minor International": "Travel/Hospitality",
    "Sika": "Manufacturing/Industrial",
    "Sika AG": "Manufacturing/Industrial",
    "Smiths Group": "Manufacturing/Industrial",
    "Cornerstone Building Brands": "Manufacturing/Industrial",
    "KIPP": "Education",
    "SIXT": "Automotive/Mobility",
    "Monro, Inc.": "Automotive/Mobility",
    "NBCUniversal": "Media/Entertainment",
    "Dentsu Creative (MKTG)": "Media/Entertainment",
    "Talan": "Consulting/Services",
    "Nagarro": "Consulting/Services",
    "Sutherland": "Consulting/Services",
    "WNS Global Services": "Consulting/Services",
    "Wavestone": "Consulting/Services",
    "Egis Group": "Consulting/Services",
    "1komma5grad": "Energy/Climate",
    "alfalaval": "Manufacturing/Industrial",
    "airproducts": "Manufacturing/Industrial",
    "Mattel": "Consumer/Lifestyle",
    "POP MART Americas Inc.": "Consumer/Lifestyle",
    "Vuori, Inc": "Consumer/Lifestyle",
    "Family Resource Home Care": "Healthcare",
    "Dungarvin": "Healthcare",
    "Caring Senior Service": "Healthcare",
    "Ally Behavior Centers": "Healthcare",
    "ConvenientMD": "Healthcare",
    "All Care Therapies": "Healthcare",
    "altamed": "Healthcare",
    "Simonmed": "Healthcare",
    "Shieldai": "Aerospace/Defense",
    "Eataly North America": "Food/Beverage",
    "The Wonderful Company": "Food/Beverage",
    "Reitmans (Canada) Ltée/Ltd": "E-commerce/Retail",
    "BTG Pactual": "Banking/Finance",
    "Canonical": "Software/SaaS",
    "Linkedin": "Software/SaaS",
    "Ubisoft": "Gaming",
    "Starbucks": "Food/Beverage",
    "panerabread": "Food/Beverage",
    "jpmc": "Banking/Finance",
    "citi": "Banking/Finance",
    "pnc": "Banking/Finance",
    "hsbc": "Banking/Finance",
    "scotiabank": "Banking/Finance",
    "Goldman Sachs": "Banking/Finance",
    "morganstanley": "Banking/Finance",
    "tjx": "E-commerce/Retail",
    "lowes": "E-commerce/Retail",
    "abercrombie": "E-commerce/Retail",
    "petco": "E-commerce/Retail",
    "meijer": "E-commerce/Retail",
    "signetjewelers": "E-commerce/Retail",
    "H&M Group": "E-commerce/Retail",
    "hyatt": "Travel/Hospitality",
    "thermofisher": "Biotech/Pharma",
    "massgeneralbrigham": "Healthcare",
    "Mount Sinai": "Healthcare",
    "cvs shared services resources": "Healthcare",
    "thales": "Aerospace/Defense",
    "SpaceX": "Aerospace/Defense",
    "eaton": "Manufacturing/Industrial",
    "qualcomm": "Semiconductors/Hardware",
    "jll": "RealEstate/PropTech",
    "greystar": "RealEstate/PropTech",
    "Sopra Steria": "Consulting/Services",
    "Burns & McDonnell": "Consulting/Services",
    "City of New York": "Government/Public",
    "usbank": "Banking/Finance",
    "truist": "Banking/Finance",
    "fifththird": "Banking/Finance",
    "ocbc": "Banking/Finance",
    "tapestry": "E-commerce/Retail",
    "homedepot": "E-commerce/Retail",
    "michaels": "E-commerce/Retail",
    "sephora": "E-commerce/Retail",
    "jcrew": "E-commerce/Retail",
    "pfchangs": "Food/Beverage",
    "totalwine": "Food/Beverage",
    "geisinger": "Healthcare",
    "medtronic": "Healthcare",
    "houstonmethodist": "Healthcare",
    "avera": "Healthcare",
    "gehc": "Healthcare",
    "wellstar": "Healthcare",
    "msd": "Biotech/Pharma",
    "gsk": "Biotech/Pharma",
    "infineon": "Semiconductors/Hardware",
    "tranetechnologies": "Manufacturing/Industrial",
    "freudenberg": "Manufacturing/Industrial",
    "zeissgroup": "Manufacturing/Industrial",
    "lithia": "Automotive/Mobility",
    "motorolasolutions": "Telecom",
    "verizon": "Telecom",
    "rutgers": "Education",
    "Speechify": "Software/SaaS",
    "WPP Media": "Media/Entertainment",
    "dentsuaegis": "Media/Entertainment",
    "EPAM Systems": "Consulting/Services",
    "nttdata": "Consulting/Services",
    "CGI Technologies and Solutions, Inc.": "Consulting/Services",
    "arcadis": "Consulting/Services",
    "bechtel": "Consulting/Services",
}


def sector_from_brand(company: Column) -> Column:
    """The sector of a company that is known by its whole name, however that is written."""
    known = {keys.company_key_of(name): sector for name, sector in SECTOR_BRANDS.items()}
    return F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), keys.company_key(company))


def sector_from_name(company: Column) -> Column:
    """The sector that a word of a company's own name tells; null if none does. The first such word counts, the longest of
    those that start there."""
    pattern = r"\b(" + "|".join(sorted(SECTOR_WORDS, key=lambda w: (-len(w), w))) + r")\b"
    found = F.nullif(F.regexp_extract(F.lower(fold(company)), pattern, 1), F.lit(""))
    return F.element_at(F.create_map(*[F.lit(x) for kv in SECTOR_WORDS.items() for x in kv]), found)


# ---- pay ------------------------------------------------------------------------------------------------------------

# Amounts that are plausible for each interval.
BANDS = {"hour": (7.0, 300.0), "day": (56.0, 3000.0), "week": (280.0, 15000.0), "month": (1200.0, 60000.0), "year": (15000.0, 2000000.0)}


def amount(text: Column) -> Column:
    """A number as people write it: either separator may group or divide, spaces may group, ``k`` means thousand; null if
    it is none or not positive."""
    t = F.lower(F.regexp_replace(text, r"[\s\x{A0}\x{202F}']", ""))
    k = F.endswith(t, F.lit("k"))
    n = F.regexp_replace(t, "k$", "")
    dot, comma = F.locate(".", F.reverse(n)), F.locate(",", F.reverse(n))
    european = (comma > 0) & ((dot == 0) | (comma < dot))
    # A single separator before exactly three digits groups; otherwise the last separator divides.
    only = ((dot > 0) & (comma == 0) & (dot == 4)) | ((comma > 0) & (dot == 0) & (comma == 4))
    many = F.regexp_like(n, F.lit(r"^\d{1,3}(?:([.,])\d{3})(?:\1\d{3})*$"))
    plain = F.regexp_replace(n, "[.,]", "")
    divided = F.when(european, F.replace(F.replace(n, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(n, F.lit(","), F.lit("")))
    value = F.when(only | many, plain).otherwise(divided)
    x = F.when(F.regexp_like(value, F.lit(r"^\d+(?:\.\d+)?$")), value.cast("double")) * F.when(k, 1000.0).otherwise(1.0)
    return F.when(x > 0, x)


def in_band(value: Column, interval: Column) -> Column:
    out = F.lit(False)
    for name, (low, high) in BANDS.items():
        out = F.when(interval == name, value.between(low, high)).otherwise(out)
    return out


def infer_interval(value: Column, lang: Column | None = None) -> Column:
    """The interval that a bare amount speaks of."""
    german = F.lit(False) if lang is None else (lang == "de") & value.between(1000.0, 20000.0)
    return F.when(german, "month").when(value >= 1000.0, "year").otherwise("hour")


def candidate_score(is_range: Column, has_currency: Column, has_cue: Column, has_interval: Column) -> Column:
    """How much speaks for an amount being pay."""
    return is_range.cast("int") * 4 + has_currency.cast("int") * 3 + has_cue.cast("int") * 2 + has_interval.cast("int")


# ---- all together ---------------------------------------------------------------------------------------------------


def enrich(postings):
    """Postings with level and sponsorship filled where they are missing; nothing that is there is overwritten. The
    title decides about the level, then plain words of the description, then years of experience."""
    known = lambda c: F.nullif(c, F.lit("unknown"))
    level = F.coalesce(
        known(F.col("level")),
        known(level_from_title(F.col("title"))),
        known(level_from_text(F.col("description_text"))),
        level_from_years(F.col("years_experience_min"), F.col("years_experience_max")),
    )
    return postings.withColumns({"level": level, "sponsorship_offered": F.coalesce("sponsorship_offered", sponsorship(F.col("description_text")))})
