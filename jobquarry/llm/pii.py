"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select redactions.

Everything on the main path is a DataFrame expression over one row, so there is no shuffle and a document is
scanned whole where it stands. Base kinds (email, ip, card, phone) are exact: their pattern's leftmost matches, less
those that fail the validator, always stay. On top of them, high-recall generators propose overlapping spans
of further kinds (secrets, local phone numbers, identity numbers, bank accounts, spoken e-mail addresses). Each has a
fixed set of boolean format and context features. Gradient-boosted trees over these score them; the trees become
one nested CASE expression. Of overlapping proposals the best score stays, none that overlaps a base span.

There is no labelled personal data, so the trees learn from snippets that ``training_snippets`` generates from
format rules, with look-alikes as negatives. Equal feature vectors are counted first, so what reaches the driver
is bounded by the number of vectors. Thresholds are set on the half of the snippets that the trees did not see.

Patterns are written so that the engine neither recurses nor rescans: possessive repeats, and starts only where
a run of the first class begins or the previous match ended (``\\G``). Offsets come from the lengths of the pieces
between matches, added up in blocks, so a document with n matches costs about n^1.5 steps.

States: null and empty texts have no spans; a null id is kept; repeated rows are scored alike; extra columns
don't matter (``redact`` keeps them); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobquarry.llm.common import PREFIX

SPAN = "struct<kind:string,start:int,end:int>"
SPANS = f"array<{SPAN}>"

# The base kinds in order, each with its pattern and the cheap test that precedes it.
BASE = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}

# Generators of further kinds, (kind, pattern, characters one of which must occur).
GENERATORS = (
    ("secret", r"(?<=(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[\x20]{0,2}[=:][\x20]{0,2}[\"']?)[A-Za-z0-9_/+.~!@#$%^&*-]{6,}+", "=:"),
    ("secret", r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+-]{0,40}+[0-9])[A-Za-z0-9_/+-]{16,}+={0,2}+", "0123456789"),
    ("phone_local", r"(?<![0-9+(.-])(?<![0-9+] )\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", "0123456789"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "0123456789"),
    ("email_spoken", r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,64}\x20?[\[(]\x20?(?i:at)\x20?[\])]\x20?[A-Za-z0-9-]{2,63}\x20?[\[(]\x20?(?i:dot)\x20?[\])]\x20?[A-Za-z]{2,10}", "[("),
)
KINDS = tuple(dict.fromkeys(k for k, _, _ in GENERATORS))

# Words before a span that speak for it.
CUES = {
    "cue_secret": r"(?:pass|pwd|token|secret|key|auth|credential)",
    "cue_contact": r"(?:call|tel|phone|fax|mobile|contact|dial)",
    "cue_identity": r"(?:ssn|social|security|iban|account|bank|tax)",
    "cue_number": r"(?:isbn|version|order|part|model|serial|room|page|commit|sha|build|ticket)",
}
BEFORE = 24


def prefix_sums(lengths: Column) -> Column:
    """For each element the sum of those before it, in blocks of about the square root of their number."""
    n = F.size(lengths)
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), n - 1, step), lambda s: F.slice(lengths, s + 1, step))
    total = lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)
    start = lambda at: F.struct(at.alias("t"), F.array().cast("array<int>").alias("out"))
    run = lambda xs, at, by: F.aggregate(xs, start(at), lambda a, x: F.struct((a["t"] + by(x)).alias("t"), F.concat(a["out"], F.array(a["t"])).alias("out")), lambda a: a["out"])
    sums = let(blocks, lambda bs: F.flatten(F.zip_with(bs, run(bs, F.lit(0), total), lambda b, at: run(b, at, lambda x: x))))
    return F.when(n > 0, sums).otherwise(F.array().cast("array<int>"))


def let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` evaluated once however often it occurs there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def located(text: Column, pattern: str, need: Column) -> Column:
    """All matches as an array of (value, start, end) in code points; empty unless ``need`` holds."""

    def spans(pieces: Column, found: Column) -> Column:
        lengths = F.zip_with(pieces, found, lambda p, m: F.length(p) + F.length(m))
        starts = let(lengths, lambda xs: F.zip_with(prefix_sums(xs), pieces, lambda s, p: s + F.length(p)))
        return F.zip_with(found, starts, lambda m, s: F.struct(m.alias("value"), s.alias("start"), (s + F.length(m)).alias("end")))

    def split(found: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        return let(pieces, lambda p: spans(p, found))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), split)
    return F.when(need & F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast("array<struct<value:string,start:int,end:int>>"))


def digits_of(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    back = F.reverse(digits)
    worth = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), lambda i: F.substr(back, i + 1, F.lit(1)).cast("int") * (1 + i % 2))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def mod97(v: Column) -> Column:
    """Whether an account number passes the ISO 7064 check."""
    flat = F.regexp_replace(v, " ", "")
    turned = F.concat(F.substr(flat, F.lit(5)), F.substr(flat, F.lit(1), F.lit(4)))
    code = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    chars = F.split(turned, "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(code(c) > 9, 100).otherwise(10) + code(c)) % 97)) == 1


def valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(v, r"\."), lambda p: F.when(F.length(part(p)) <= 3, part(p).cast("int") <= 255).otherwise(F.lit(False)))
    if kind == "card":
        return luhn(digits_of(v))
    if kind == "phone":
        return F.length(digits_of(v)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """For each base kind an array of (kind, start, end), by start."""
    return {kind: _base(text, kind, *rule) for kind, rule in BASE.items()}


def _base(text: Column, kind: str, pattern: str, char: str | None) -> Column:
    need = F.contains(text, F.lit(char)) if char else F.regexp_like(text, F.lit("[0-9]"))
    if kind == "ip":
        need = F.regexp_like(text, F.lit(r"[0-9]\.[0-9]"))
    kept = F.filter(located(text, pattern, need), lambda m: valid(kind, m["value"]))
    return F.transform(kept, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def features(kind: Column, v: Column, before: Column) -> dict[str, Column]:
    """Boolean format and context features of a proposed span; ``before`` is the lower-cased text in front."""
    digits = F.length(digits_of(v))
    out = {f"is_{k}": kind == k for k in KINDS}
    out |= {name: F.regexp_like(before, F.lit(cue)) for name, cue in CUES.items()}
    out |= {
        "assigned": F.regexp_like(before, F.lit(r"[=:][\x20]?[\"']?$")),
        "known_head": F.regexp_like(v, F.lit(r"^(?:AKIA|ASIA|ghp_|gho_|sk-|xox[bp]-)")),
        "hex": F.regexp_like(v, F.lit(r"^[0-9a-fA-F]+$")),
        "long": F.length(v) >= 20,
        "very_long": F.length(v) >= 32,
        "digits_4": digits >= 4,
        "digits_only": digits == F.length(v),
        "upper_and_digit": F.regexp_like(v, F.lit(r"^[A-Z0-9]+$")) & (digits > 0),
        "both_cases": F.regexp_like(v, F.lit(r"[a-z].*[A-Z]|[A-Z].*[a-z]")),
        "separated": F.regexp_like(v, F.lit(r"[A-Za-z]{4,}[_/+-][A-Za-z]{3,}")),
        "ssn_range": (kind == "ssn") & ~F.regexp_like(v, F.lit(r"^(?:000|666|9)|-00-|-0000$")),
        "checksum": F.when(kind == "iban", mod97(v)).otherwise(F.lit(False)),
        "parentheses": F.startswith(v, F.lit("(")),
    }
    return out


FEATURES = (*[f"is_{k}" for k in KINDS], *CUES, "assigned", "known_head", "hex", "long", "very_long", "digits_4", "digits_only", "upper_and_digit", "both_cases", "separated", "ssn_range", "checksum", "parentheses")


def proposals(text: Column) -> Column:
    """Spans of all generators, as an array of (kind, start, end, value, before)."""
    return F.concat(*[_proposed(text, *g) for g in GENERATORS])


def _proposed(text: Column, kind: str, pattern: str, chars: str) -> Column:
    need = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in chars]) if len(chars) < 3 else F.regexp_like(text, F.lit("[0-9]"))
    return F.transform(
        located(text, pattern, need),
        lambda m: F.struct(
            F.lit(kind).alias("kind"),
            m["start"].alias("start"),
            m["end"].alias("end"),
            m["value"].alias("value"),
            F.lower(F.substr(text, F.greatest(m["start"] - BEFORE, F.lit(0)) + 1, F.least(m["start"], F.lit(BEFORE)))).alias("before"),
        ),
    )


@dataclass(frozen=True)
class Model:
    """Boosted trees of depth two over boolean features, and a threshold for each kind."""

    base: float
    trees: tuple[tuple[str, str, str, tuple[float, float, float, float]], ...]
    thresholds: dict[str, float]

    def score(self, f: dict[str, Column]) -> Column:
        leaf = lambda c, yes, no: F.when(c, F.lit(yes)).otherwise(F.lit(no))
        total = F.lit(self.base)
        for a, b, c, (w11, w10, w01, w00) in self.trees:
            total = total + F.when(f[a], leaf(f[b], w11, w10)).otherwise(leaf(f[c], w01, w00))
        return total

    def value(self, row: dict[str, bool]) -> float:
        return self.base + sum((w[0] if row[b] else w[1]) if row[a] else (w[2] if row[c] else w[3]) for a, b, c, w in self.trees)


def training_snippets(spark: SparkSession, n: int) -> DataFrame:
    """``text`` and ``label`` of generated snippets; the span to judge is what the generators find in them."""
    h = lambda salt: F.md5(F.concat(F.lit(salt), F.col("id").cast("string")))
    num = lambda salt, lo, hi: (F.conv(F.substring(h(salt), 1, 7), 16, 10).cast("long") % (hi - lo) + lo).cast("string")
    caps = lambda salt, k: F.upper(F.substring(F.translate(F.base64(F.unhex(h(salt))), "+/=abcdefghijklm", "XYZ0123456789JQV"), 1, k))
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.conv(F.substring(h("pick"), 1, 6), 16, 10).cast("long") % len(xs) + 1).cast("int"))
    c = F.concat
    local = c(num("a", 201, 999), F.lit("-"), num("b", 200, 999), F.lit("-"), num("c", 1000, 9999))
    made = [
        (1, c(pick("token", "secret", "api_key"), F.lit(' = "'), F.substring(c(h("x"), h("y")), 1, 40), F.lit('"'))),
        (1, c(pick("password=", "pwd: ", "password = "), F.substring(h("x"), 1, 18))),
        (1, c(pick("", "the ", "use "), F.lit("AKIA"), caps("x", 16))),
        (1, c(pick("", "see ", "was "), F.lit("ghp_"), F.substring(c(h("x"), h("y")), 1, 36))),
        (0, c(pick("commit ", "sha ", "build "), F.substring(c(h("x"), h("y")), 1, 40))),
        (0, c(pick("chapter2introduction_final", "figure_3_overview_table", "a1-road-from-north-to-south"), F.lit("_"), num("x", 1, 99))),
        (0, c(pick("page ", "item ", "", "no "), num("x", 10**7, 10**8), num("y", 10**7, 10**8), num("z", 10, 99))),
        (0, c(pick("order ", "serial ", "part "), caps("x", 18))),
        (1, c(pick("call ", "phone ", "tel. "), F.lit("("), num("a", 201, 999), F.lit(") "), num("b", 200, 999), F.lit("-"), num("c", 1000, 9999))),
        (1, c(pick("call ", "fax ", "contact me at "), local)),
        (0, c(pick("isbn ", "part ", "model ", "ticket "), local)),
        (1, c(pick("ssn ", "social security ", "tax id "), num("a", 100, 600), F.lit("-"), num("b", 10, 99), F.lit("-"), num("c", 1000, 9999))),
        (0, c(pick("part ", "serial ", "order "), num("a", 100, 600), F.lit("-"), num("b", 10, 99), F.lit("-"), num("c", 1000, 9999))),
        (0, c(pick("ssn ", "code "), F.lit("000-"), num("b", 10, 99), F.lit("-"), num("c", 1000, 9999))),
        (None, c(pick("iban ", "account ", ""), F.lit("GB"), num("a", 10, 99), F.lit("WEST"), num("b", 10**6, 10**7), num("c", 10**6, 10**7))),
        (1, c(pick("write to ", "", "mail "), pick("ann", "bob.lee", "info"), F.lit(" [at] "), pick("mail", "post"), F.lit(" [dot] com"))),
    ]
    rows = spark.range(n)
    kind = (F.col("id") % len(made)).cast("int")
    text = F.element_at(F.array(*[t for _, t in made]), kind + 1)
    label = F.element_at(F.array(*[F.lit(y).cast("int") for y, _ in made]), kind + 1)
    return rows.select("id", F.concat(F.lit("and the "), text, F.lit(" of it")).alias("text"), label.alias("label"))


def fit(spark: SparkSession, snippets: int = 32_000, trees: int = 24, rate: float = 0.5, precision: float = 0.98) -> Model:
    """Trees on the counts of equal feature vectors; ``snippets`` bounds the generated rows."""
    found = training_snippets(spark, snippets).select("id", "label", F.explode(proposals(F.col("text"))).alias("s"))
    f = features(F.col("s.kind"), F.col("s.value"), F.col("s.before"))
    rows = found.select((F.floor(F.col("id") / 16) % 2).alias("half"), "label", *[f[k].alias(k) for k in FEATURES])
    rows = rows.withColumn("label", F.coalesce("label", F.col("checksum").cast("int")))
    counts = rows.groupBy("half", "label", *FEATURES).count().collect()
    learn = [(r.asDict(), r["label"], r["count"]) for r in counts if r["half"] == 0]
    held = [(r.asDict(), r["label"], r["count"]) for r in counts if r["half"] == 1]
    positive, total = sum(n for _, y, n in learn if y), sum(n for _, _, n in learn)
    base = math.log(positive / (total - positive))
    model = Model(base, (), {})
    for _ in range(trees):
        graded = []
        for x, y, n in learn:
            p = 1 / (1 + math.exp(-model.value(x)))
            graded.append((x, n * (y - p), n * max(p * (1 - p), 1e-6)))
        a, left, right = best_stump(graded)
        b, b_yes, b_no = best_stump(left)
        c, c_yes, c_no = best_stump(right)
        leaves = tuple(rate * step(s) for s in (b_yes, b_no, c_yes, c_no))
        model = Model(base, (*model.trees, (a, b, c, leaves)), {})
    thresholds = {}
    for kind in KINDS:
        scored = sorted(((model.value(x), y, n) for x, y, n in held if x[f"is_{kind}"]), reverse=True)
        right = seen = 0
        thresholds[kind] = math.inf
        for k, (score, y, n) in enumerate(scored):
            right, seen = right + y * n, seen + n
            if (k + 1 == len(scored) or scored[k + 1][0] < score) and right >= precision * seen:
                thresholds[kind] = score - 1e-9
    return Model(base, model.trees, thresholds)


def step(rows) -> float:
    return sum(g for _, g, _ in rows) / (sum(h for _, _, h in rows) + 1.0)


def best_stump(rows):
    """The feature whose split gains most, and the rows on either side."""
    sums = defaultdict(lambda: [0.0, 0.0])
    g_all, h_all = sum(g for _, g, _ in rows), sum(h for _, _, h in rows)
    for x, g, h in rows:
        for k in FEATURES:
            if x[k]:
                sums[k][0] += g
                sums[k][1] += h
    gain = lambda k: sums[k][0] ** 2 / (sums[k][1] + 1) + (g_all - sums[k][0]) ** 2 / (h_all - sums[k][1] + 1)
    best = max(FEATURES, key=lambda k: (round(gain(k), 9), -FEATURES.index(k)))
    return best, [r for r in rows if r[0][best]], [r for r in rows if not r[0][best]]


def added_spans(text: Column, base: Column, model: Model) -> Column:
    """Proposals over their kind's threshold: none that overlaps a base span or a better proposal."""
    scored = F.transform(
        proposals(text),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _score(s, model).alias("score")),
    )
    limit = F.create_map(*[F.lit(x) for kv in model.thresholds.items() for x in kv])
    strong = F.filter(scored, lambda s: s["score"] >= F.element_at(limit, s["kind"]))
    overlaps = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    rank = lambda s: F.struct(s["score"], s["end"] - s["start"], -s["start"], s["kind"])
    free = let(strong, lambda all: F.filter(all, lambda s: ~F.exists(base, lambda b: overlaps(s, b)) & ~F.exists(all, lambda d: overlaps(s, d) & (rank(d) > rank(s)))))
    return F.array_sort(
        F.array_distinct(F.transform(free, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))),
        lambda a, b: F.when(_order(a) < _order(b), -1).when(_order(a) > _order(b), 1).otherwise(0),
    )


def _score(s: Column, model: Model) -> Column:
    vector = F.struct(*[c.alias(k) for k, c in features(s["kind"], s["value"], s["before"]).items()])
    return let(vector, lambda f: model.score({k: f[k] for k in FEATURES}))


def _order(s: Column) -> Column:
    return F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]), s["start"], s["end"])


def find_spans(docs: DataFrame, text_col: str = "text", model: Model | None = None, base: str = "pii_base", added: str = "pii_added") -> DataFrame:
    """``docs`` with two columns: ``base``, a struct with an array of spans for each base kind, and ``added``, an array of
    further spans. A span is (kind, start, end) in code points, end exclusive; arrays are in order of start."""
    model = model or fit(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.withColumn(base, F.struct(*[v.cast(SPANS).alias(k) for k, v in base_spans(text).items()]))
    together = F.concat(*[F.col(f"{base}.{k}") for k in BASE])
    return found.withColumn(added, added_spans(text, together, model).cast(SPANS))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None, model: Model | None = None) -> DataFrame:
    """The rows and columns of ``docs`` with each span of personal data replaced by its kind in brackets; overlapping
    spans become one, named by the first. ``length_col``, if given, is set to the new length of changed texts."""
    base, added, cut = (PREFIX + c for c in ("base", "added", "spans"))
    found = find_spans(docs, text_col, model, base, added)
    spans = F.concat(*[F.col(f"{base}.{k}") for k in BASE], F.col(added))
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    merged = F.aggregate(
        by_start,
        F.array().cast("array<struct<start:int,end:int,kind:string>>"),
        lambda a, s: F.when(
            (F.size(a) > 0) & (s["start"] < F.element_at(a, F.greatest(F.size(a), F.lit(1)))["end"]),
            F.concat(
                F.slice(a, F.lit(1), F.size(a) - 1),
                F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end"), F.element_at(a, -1)["kind"].alias("kind"))),
            ),
        ).otherwise(F.concat(a, F.array(s))),
    )
    found = found.withColumn(cut, F.when(F.size(spans) > 0, merged))
    text = F.col(text_col)
    before = F.transform(cut, lambda s, i: F.when(i > 0, F.get(cut, i - 1)["end"]).otherwise(F.lit(0)))
    pieces = F.zip_with(F.col(cut), before, lambda s, b: F.concat(F.substr(text, b + 1, s["start"] - b), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    tail = F.substr(text, F.element_at(cut, -1)["end"] + 1)
    new = F.when(F.col(cut).isNotNull(), F.concat(F.array_join(pieces, ""), tail)).otherwise(text)
    out = found.withColumn(text_col, new)
    if length_col:
        changed = F.when(F.col(cut).isNotNull(), F.length(text_col).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col))
        out = out.withColumn(length_col, changed)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
