"""A quality classifier from weak labels.

Heuristic labellers vote on each text: good, bad, or nothing. They overlap and err. Their accuracies are estimated by
expectation maximisation under a model in which votes are independent given the true label: the vote patterns of ALL
documents are counted first (there are at most 3^labellers patterns, whatever the corpus), so one pass of the corpus
serves every iteration. The posterior of each pattern then labels a bounded sample of different texts, on which a linear
scorer over hashed shapes of words is trained; it scores every document, also where no labeller votes.
Texts are read once: their votes and hashed features are written, counted, sampled and scored from there.

Shapes keep what quality shows in and drop the vocabulary: runs of lower-case letters, capitals and digits
collapse, other characters stay ("moron###" becomes "a###"), and each shape comes with the shape before it and
with whether the word repeats its predecessor.

States: null and empty texts are scored as empty (they get a bad vote for length); null ids are kept, and their texts are
sampled like others; repeated rows are rows and count in the patterns, but a text enters the sample once; if all texts vote
alike, they have one posterior, which the scores approach; words and texts of any length are read whole; extra columns are
dropped; an empty table gives an empty result.
"""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobquarry.llm.common import Workspace

#: Different texts of the sample that the scorer is trained on, at most (by hash order).
SAMPLE_ROWS = 6_000
#: Buckets of hashed features.
BUCKETS = 1 << 12

SHAPE = [(re.compile(p), r) for p, r in ((r"[^\W\d_A-ZÀ-ÖØ-Þ]+", "a"), (r"[A-ZÀ-ÖØ-Þ]+", "A"), (r"\d+", "9"))]
SENTENCE = re.compile(r"[.!?]+(?=\s|$)")


LABELLERS = ("letters", "symbols", "repeats", "capitals", "exclamation", "shapes", "sentences", "lines", "prose")


def votes(text: str, words: list[str], shapes: list[str]) -> str:
    """One character per labeller: + good, - bad, 0 no vote. Labellers of a defect don't vote where it is absent:
    that a text has no capitals in excess says nothing about its other defects."""
    n = len(words)
    if not n:
        return "-" + "0" * (len(LABELLERS) - 1)
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    odd = sum(map(text.count, "#$%&*|@^~<>{}\\=_"))
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    sentences = max(1, len(SENTENCE.findall(text)))
    plain = sum(s in ("a", "Aa", "a.", "a,", "Aa.", "Aa,", "A") for s in shapes)
    lines = [x for x in text.split("\n") if x.strip()]
    bad = (
        letters == 0,
        odd > 0.15 * n,
        repeats > 0.1 * n and n > 5,
        upper > 0.4 * max(1, letters) and n > 3,
        text.count("!") > 0.1 * n and n > 3,
        plain < 0.7 * n,
        n > 150 * sentences or n < 1.2 * sentences and n > 5,
        len(lines) > 3 and len(set(lines)) < 0.5 * len(lines) or not 2 * n <= letters <= 14 * n,
    )
    prose = letters and odd <= 0.02 * n and repeats <= 0.03 * n and upper <= max(1, 0.2 * letters) and (n < 10 or 2 * sentences <= n <= 60 * sentences)
    return "".join("-" if b else "0" for b in bad) + ("+" if prose else "0")


def read(text: str) -> tuple[list[str], list[str]]:
    shaped = text
    for pattern, by in SHAPE:
        shaped = pattern.sub(by, shaped)
    return text.split(), shaped.split()


_bucket: dict[str, int] = {}


def bucket(name: str) -> int:
    at = _bucket.get(name)
    if at is None:
        if len(_bucket) > 200_000:
            _bucket.clear()
        at = _bucket[name] = zlib.crc32(name.encode()) % BUCKETS
    return at


def hashed(words: list[str], shapes: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text: relative frequencies of shapes, pairs of shapes and repeats."""
    n = max(1, len(words))
    counts = Counter(shapes)
    values: dict[int, float] = {bucket("#long"): math.log1p(n) / 10}
    for s, c in counts.items():
        at = bucket(s)
        values[at] = values.get(at, 0.0) + c / n
    for (a, b), c in Counter(zip(shapes, shapes[1:], strict=False)).items():
        at = bucket(f"{a} {b}")
        values[at] = values.get(at, 0.0) + c / n
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    values[bucket("#same")] = same * 3
    return np.fromiter(values, np.int64, len(values)), np.fromiter(values.values(), float, len(values))


def featured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of each row the id, ``h`` (a hash of the text), ``votes``, and its hashed features: ``at`` (uint16), ``x`` (float32)."""

    def each(batches):
        for batch in batches:
            marks, places, values = [], [], []
            for t in batch.column("text"):
                text = t.as_py()
                words, shapes = read(text)
                at, x = hashed(words, shapes)
                marks.append(votes(text, words, shapes))
                places.append(at.astype(np.uint16).tobytes())
                values.append(x.astype(np.float32).tobytes())
            columns = [batch.column("id"), batch.column("h"), pa.array(marks, pa.string()), pa.array(places, pa.binary()), pa.array(values, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "h", "votes", "at", "x"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return rows.mapInArrow(each, "id long, h long, votes string, at binary, x binary")


def sampled(rows: DataFrame, total: int, sample_rows: int) -> list[tuple[bytes, bytes, str]]:
    """Features and votes of at most ``sample_rows`` different texts. Hashes below a share of their range are looked at, so
    about that many rows are, however large the table is; where copies leave too few, so they do."""
    limit = (1 << 63) - 1 if total <= sample_rows else int((2 * sample_rows / total - 1) * (1 << 63))
    some = rows.where(F.col("h") <= F.lit(limit)).groupBy("h").agg(*[F.first(c).alias(c) for c in ("at", "x", "votes")])
    return [(r["at"], r["x"], r["votes"]) for r in some.orderBy("h").limit(sample_rows).collect()]


def label_model(patterns: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """The posterior of "good" for each pattern, by expectation maximisation from the majority vote."""
    names = sorted(patterns)
    if not names:
        return {}
    n = np.array([patterns[p] for p in names], float)
    v = np.array([["0+-".index(c) for c in p] for p in names])
    q = np.clip(0.7 + 0.2 * (v == 1).sum(1) - 0.4 * (v == 2).sum(1), 0.05, 0.95)
    for _ in range(rounds):
        prior = (n @ q + 1) / (n.sum() + 2)
        log_good, log_bad = np.full(len(names), math.log(prior)), np.full(len(names), math.log(1 - prior))
        for k in range(v.shape[1]):
            for value in range(3):
                here = v[:, k] == value
                good = ((n * q)[here].sum() + 0.5) / ((n * q).sum() + 1.5)
                bad = ((n * (1 - q))[here].sum() + 0.5) / ((n * (1 - q)).sum() + 1.5)
                log_good[here] += math.log(good)
                log_bad[here] += math.log(bad)
        new = 1 / (1 + np.exp(np.clip(log_bad - log_good, -30, 30)))
        if np.abs(new - q).max() < 1e-6:
            break
        q = new
    return dict(zip(names, q.tolist(), strict=True))


def train(sample: list[tuple[bytes, bytes, str]], posterior: dict[str, float], epochs: int = 12, rate: float = 0.5) -> tuple[float, np.ndarray]:
    """Weights of the linear scorer: logistic loss against posteriors, adaptive steps."""
    rows = [(np.frombuffer(at, np.uint16).astype(np.int64), np.frombuffer(x, np.float32).astype(float), posterior.get(v, 0.5)) for at, x, v in sample]
    w, b, grads, bias_grad = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-3), 1e-3
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, x, y = rows[k]
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, b + w[at] @ x)))) - y
            step = g * x + 1e-5 * w[at]
            grads[at] += step * step
            bias_grad += g * g
            w[at] -= rate * step / np.sqrt(grads[at])
            b -= rate * g / math.sqrt(bias_grad)
    return b, w


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: the id, ``score`` (0 to 1, higher is better), ``kept``, ``votes``, ``posterior``."""
    rows = Workspace(docs.sparkSession, "quality").write(featured(docs, id_col, text_col))
    patterns = {r["votes"]: r["n"] for r in rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    posterior = label_model(patterns)
    bias, weights = train(sampled(rows, sum(patterns.values()), sample_rows), posterior)

    def each(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at, x = ([np.frombuffer(v.as_py(), kind) for v in batch.column(c)] for c, kind in (("at", np.uint16), ("x", np.float32)))
            starts = np.concatenate([[0], np.cumsum([len(v) for v in at])[:-1]])
            raw = bias + np.add.reduceat(weights[np.concatenate(at).astype(np.int64)] * np.concatenate(x), starts)
            scores = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
            beliefs = [posterior[v.as_py()] for v in batch.column("votes")]
            columns = [pa.array(scores), pa.array(scores >= threshold), batch.column("votes"), pa.array(beliefs, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "score", "kept", "votes", "posterior"])

    return rows.mapInArrow(each, "id long, score double, kept boolean, votes string, posterior double").withColumnRenamed("id", id_col)
