"""Toxicity by a weighted finite-state grammar over clauses.

A text is read as words, quotation marks and clause ends. A lexicon transducer turns each word into symbols: insult (with a
weight), violence, intention, target, negation, report. Five small transducers read these symbols from left to right:

* target, negation and report are open for some words after their symbol;
* quotation is open between two marks;
* threat wants an intention, then violence, then a target, each within some words of the one before.

They are composed into one machine over the product of their states, built as far as texts reach it. Where an insult
or a completed threat is read, the machine emits it under the state of the others: negated ones count nothing, reported and
quoted ones an eighth, those aimed at a target half as much again (``FACTORS``). A report that follows ("..., she said")
turns what its clause has emitted so far into reported speech. A clause scores the sum of what it emits; a document's score is
a logistic function of its clauses' scores: their sum, the heaviest one, how many score, and their sum by the root of the text length.

Learned from a bounded sample of labelled rows are the insults of the lexicon and the logistic function. An entry is a whole
word, by the log odds of standing in toxic and other documents, or a word beginning under which at least ``VARIETY``
different words occur, by how much more of them toxic texts hold than their length lets expect; it is kept only if a test
over all candidates allows less than half a chance find, and if the words before it vary, so that copies of one document
teach nothing. The
logistic function is fitted on halves of the sample scored by the lexicon of the other half. A short list of English insults
stands in the lexicon from the start; what a state makes of a match is fixed.

States: null and empty texts match nothing and get the lowest score; null labels and labels without a document are
ignored; repeated label rows count once each; without ten labels of either kind the built-in list and weights are used; a
null id is scored like any other; texts of any length are read whole; extra columns are dropped; an empty table gives an
empty result.
"""

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the model is fitted on at most (by hash order of their ids).
TRAIN_ROWS = 6_000
#: Longer texts (in characters) are not learned from, which bounds what the driver holds; they are scored whole.
TRAIN_CHARS = 100_000
#: Lengths of word beginnings that may become entries, and different words that must occur under one.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
VARIETY = 4
#: Different words under one beginning that one text counts for.
PER_TEXT = 4

# Words of the built-in grammar.
INSULTS = frozenset("idiot idiots stupid moron morons worthless pathetic disgusting loser losers scum trash filth vermin imbecile dumb clown retard".split())
VIOLENCE = frozenset("kill hurt destroy burn stab shoot beat strangle töte töten umbringen tuer tuerai frapper matar mataré golpear".split())
TARGETS = frozenset("you your yours u ya he she they him them these those du dich dein ihr euch tu te toi vous votre vos tú ti usted ustedes vosotros".split())
INTENTIONS = frozenset("will gonna going shall should must ll deserve deserves werde wirst vais va allons voy vamos".split())
NEGATIONS = frozenset("not no never neither nor isn aren wasn weren don doesn didn won nicht kein keine keiner nie niemals ne pas jamais aucun nunca jamás ningún tampoco".split())
REPORTS = frozenset("said says say called calls wrote writes told quoted claimed reported sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())
RESERVED = VIOLENCE | TARGETS | INTENTIONS | NEGATIONS | REPORTS

#: Symbols, as bits: a token may be several at once.
WORD, END, MARK, INSULT, HURT, WILL, TARGET, NOT, SAID = (1 << k for k in range(9))
LISTS = ((VIOLENCE, HURT), (INTENTIONS, WILL), (TARGETS, TARGET), (NEGATIONS, NOT), (REPORTS, SAID))
TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n\"“„«»”]")
FIXED = dict.fromkeys(".!?;\n", END) | dict.fromkeys("\"“„«»”", MARK)
LETTERS = re.compile(r"[^\W\d_]+")

#: What a match counts under the state in which it is read.
FACTORS = {"plain": 1.0, "aimed": 1.5, "reported": 0.125, "negated": 0.0}
#: Weight of a completed threat, and of a built-in insult before anything is learned.
SEED = 3.0
#: Bias and weights of the features before anything is learned.
BUILT_IN = (-4.0, (2.0, 0.5, 0.4, 0.0))


@dataclass(frozen=True)
class Window:
    """A transducer that is open for ``span`` words after a symbol of ``opener``; a clause end closes it."""

    opener: int
    span: int

    def step(self, state: int, symbols: int) -> int:
        if symbols & END:
            return 0
        if symbols & self.opener:
            return self.span
        return max(0, state - 1) if symbols & WORD else state


class Quotation:
    """Open from one quotation mark to the next; a clause end closes it."""

    def step(self, state: int, symbols: int) -> int:
        return 0 if symbols & END else state ^ 1 if symbols & MARK else state


AIMED, NEGATED, REPORTED, INTENDED, QUOTED = Window(TARGET, 4), Window(NOT, 3), Window(SAID, 8), Window(WILL, 4), Quotation()
#: After violence with an intention the threat transducer waits so many words for its target.
PENDING = 3


class Machine:
    """The composition: states are tuples of the transducers' states, numbered as they are reached."""

    def __init__(self) -> None:
        self.numbers, self.states = {(0, 0, 0, 0, 0, 0): 0}, [(0, 0, 0, 0, 0, 0)]
        self.moves: list[dict[int, tuple[int, str, str]]] = [{}]

    def move(self, number: int, symbols: int) -> tuple[int, str, str]:
        """(next state, what is emitted: "", "insult", "threat" or "retract", the state that it is emitted under)."""
        aimed, negated, reported, intended, quoted, pending = self.states[number]
        under = "negated" if negated else "reported" if reported or quoted else "aimed" if aimed else "plain"
        threat = symbols & TARGET and pending
        waits = PENDING if symbols & HURT and intended and not negated else 0 if symbols & END or threat else max(0, pending - 1) if symbols & WORD else pending
        after = (AIMED.step(aimed, symbols), NEGATED.step(negated, symbols), REPORTED.step(reported, symbols), INTENDED.step(intended, symbols), QUOTED.step(quoted, symbols), waits)
        if after not in self.numbers:
            self.numbers[after] = len(self.states)
            self.states.append(after)
            self.moves.append({})
        emitted = "insult" if symbols & INSULT else "threat" if threat else "retract" if symbols & SAID else ""
        if emitted == "threat" and under == "plain":
            under = "aimed"
        found = self.moves[number][symbols] = (self.numbers[after], emitted, under)
        return found


@dataclass(frozen=True)
class Grammar:
    """Lexicon entries (text, whole word or beginning, weight), and the weights of the document features."""

    entries: tuple[tuple[str, bool, float], ...]
    bias: float
    weights: tuple[float, ...]

    def reader(self) -> "Reader":
        return Reader(self.entries)

    def score(self, x: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.bias + float(x @ np.array(self.weights))))))


class Reader:
    """Runs the machine over texts with the lexicon of ``entries``."""

    def __init__(self, entries):
        self.whole = {t: w for t, whole, w in entries if whole}
        self.begins = {t: w for t, whole, w in entries if not whole}
        self.sizes = sorted({len(t) for t in self.begins}, reverse=True)
        self.known: dict[str, tuple[int, float]] = {t: (s, 0.0) for t, s in FIXED.items()}
        #: Words that are known to be neither insults nor violence.
        self.calm: set[str] = set()
        self.machine = Machine()

    def symbols(self, word: str) -> tuple[int, float]:
        """The lexicon transducer: the symbols of a word and its weight as an insult."""
        found = WORD
        for names, symbol in LISTS:
            if word in names:
                found |= symbol
        weight = self.whole.get(word, 0.0)
        for k in self.sizes:
            if not weight and len(word) > k:
                weight = self.begins.get(word[:k], 0.0)
        if len(self.known) > 500_000:
            self.known = {t: (s, 0.0) for t, s in FIXED.items()}
        self.known[word] = found = (found | INSULT if weight else found, weight)
        return found

    def clauses(self, text: str | None) -> tuple[list[list[tuple[float, str]]], int]:
        """What each clause with a match emits, as (weight, state), and the number of words."""
        low = (text or "").lower()
        words = LETTERS.findall(low)
        # Without an insult or a word of violence nothing is ever emitted; most texts are done here.
        new = set(words) - self.calm
        loud = {w for w in new if (self.known.get(w) or self.symbols(w))[0] & (INSULT | HURT)}
        if len(self.calm) > 500_000:
            self.calm = set()
        self.calm |= new - loud
        if not loud:
            return [], len(words)
        known, moves, machine = self.known, self.machine.moves, self.machine
        out, clause, state = [], [], 0
        for token in TOKEN.findall(low):
            symbols, weight = known.get(token) or self.symbols(token)
            if state == 0 and symbols == WORD:
                continue
            if symbols == END:
                if clause:
                    out.append(clause)
                    clause = []
                state = 0
                continue
            known = self.known
            state, emitted, under = moves[state].get(symbols) or machine.move(state, symbols)
            if emitted == "retract":
                clause = [(w, u if u == "negated" else "reported") for w, u in clause]
            elif emitted:
                clause.append((weight or SEED, under))
        if clause:
            out.append(clause)
        return out, len(words)

    def features(self, text: str | None) -> tuple[np.ndarray, int]:
        """Of a whole text: log of the clauses' summed scores, the heaviest clause, log of the number of clauses that
        score, the sum by the root of the length; and the number of matches."""
        clauses, words = self.clauses(text)
        scores = [x for x in (sum(w * FACTORS[u] for w, u in c) for c in clauses) if x > 0]
        total = sum(scores)
        x = np.array([math.log1p(total), min(20.0, max(scores, default=0.0)), math.log1p(len(scores)), total / math.sqrt(words + 400)])
        return x, sum(map(len, clauses))


def learn_lexicon(rows: list[tuple[str, int]]) -> list[tuple[str, bool, float]]:
    """Entries by log odds. ``rows``: (lower-cased text, label)."""
    toxic, sizes, seen = sum(y for _, y in rows), [1, 1], (Counter(), Counter())
    rate = toxic / max(1, len(rows))
    if not 0 < rate < 1:
        return []
    for text, y in rows:
        words = LETTERS.findall(text)
        sizes[y] += len(words)
        seen[y].update(set(words))
    # Of each beginning: different words under it, the texts of the one in most texts, and of all in toxic and clean ones.
    variety, top, hits, clean = Counter(), defaultdict(int), Counter(), Counter()
    for word, n in seen[1].items():
        for b in beginnings(word):
            variety[b] += 1
            hits[b] += n
            top[b] = max(top[b], n)
    varied = {b for b, n in variety.items() if n >= VARIETY and b not in RESERVED}
    for word, n in seen[0].items():
        for b in beginnings(word):
            if b in varied:
                clean[b] += n
    words = [w for w, n in seen[1].items() if n >= 4 and w not in RESERVED]
    limit = math.log(0.5 / max(1, len(words) + len(varied)))

    def excess(b: str, n: int) -> float:
        """Log odds of a beginning by ``n`` hits other than the top word's, or 0 if they may be chance."""
        usual, others = (clean[b] + 0.5) / sizes[0] * sizes[1], n - top[b]
        weight = math.log((max(0, others) + 0.5) / (usual + 0.5))
        return weight if weight > 1.5 and others - usual - others * math.log(others / usual) < limit else 0.0

    kept: dict[tuple[str, bool], float] = {}
    for w in words:
        p, n = seen[1][w], seen[0][w]
        weight = math.log((p + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (len(rows) - toxic + 1))
        if weight > 1.5 and tail(p, p + n, rate) < limit:
            kept[w, True] = weight
    kept |= {(b, False): 1.0 for b in varied if excess(b, hits[b])}
    # Once more over the toxic texts, for the few that are left: texts, hits with a bound for each text, and contexts as bits.
    texts, bounded, contexts = Counter(), Counter(), defaultdict(int)
    for text, y in rows:
        if y:
            own, before = defaultdict(set), 0
            for word in LETTERS.findall(text):
                bit = 1 << (zlib.crc32(word.encode()) & 63)
                if (word, True) in kept:
                    contexts[word, True] |= before
                    own[word, True].add(word)
                for b in beginnings(word):
                    if (b, False) in kept:
                        contexts[b, False] |= bit
                        own[b, False].add(word)
                before = bit
            for f, under in own.items():
                texts[f] += 1
                bounded[f] += min(len(under), PER_TEXT)
    for f in list(kept):
        if not f[1]:
            kept[f] = excess(f[0], bounded[f]) / 2
        if contexts[f].bit_count() < VARIETY or texts[f] < 3 or not kept[f]:
            del kept[f]
    # A beginning gives way to a longer one or a word that nearly all of its texts hold; words under one that stays go.
    for b in sorted((f for f in kept if not f[1]), key=lambda f: (len(f[0]), f)):
        if any(f != b and f[0].startswith(b[0]) and texts[f] >= 0.9 * texts[b] for f in kept):
            del kept[b]
    chosen = {f: w for f, w in kept.items() if not any((b, False) in kept for b in beginnings(f[0]))}
    return sorted((t, whole, round(w, 6)) for (t, whole), w in chosen.items())


def beginnings(word: str) -> list[str]:
    return [word[:k] for k in BEGINNINGS if k < len(word)]


def tail(p: int, n: int, rate: float) -> float:
    """Log of a bound on the chance of ``p`` or more toxic documents among ``n`` (Chernoff)."""
    q = p / n
    if q <= rate:
        return 0.0
    return -n * (q * math.log(q / rate) + ((1 - q) * math.log((1 - q) / (1 - rate)) if q < 1 else 0))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, np.ndarray]:
    """A logistic model with slopes that are not negative: features whose slope would be are left out, one by one."""
    active = list(range(x.shape[1]))
    while True:
        w = _newton(np.hstack([np.ones((len(x), 1)), x[:, active]]), y, ridge)
        if not len(active) or w[1:].min() >= 0:
            out = np.zeros(x.shape[1])
            out[active] = w[1:]
            return float(w[0]), out
        active.pop(int(np.argmin(w[1:])))


def _newton(z: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Newton steps, halved until the penalised loss falls."""
    penalty = np.array([0.0] + [ridge] * (z.shape[1] - 1))
    loss = lambda w: float(np.logaddexp(0, z @ w).sum() - y @ (z @ w) + 0.5 * (penalty * w * w).sum())
    w = np.zeros(z.shape[1])
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        grad = z.T @ (p - y) + penalty * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-8)
        move, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and loss(w - size * move) > now:
            size /= 2
        w = w - size * move
        before, now = now, loss(w)
        if before - now < 1e-9 * max(1.0, abs(now)):
            break
    return w


def fit(rows: list[tuple[str, int]]) -> Grammar:
    """A grammar from labelled texts; the built-in one if they hold fewer than ten of either label."""
    rows = [((t or "").lower(), int(y)) for t, y in rows]
    toxic = sum(y for _, y in rows)
    if toxic < 10 or len(rows) - toxic < 10:
        return Grammar(tuple((t, True, SEED) for t in sorted(INSULTS)), *BUILT_IN)
    # A built-in word that no clean text has weighs as much as the heavy half of what was learned; others are light.
    common = {w for t, y in rows if not y for w in INSULTS.intersection(LETTERS.findall(t))}

    def with_seeds(entries):
        words = sorted(w for _, whole, w in entries if whole)
        heavy, own = words[len(words) // 2] if words else SEED, {t for t, whole, _ in entries if whole}
        return (*entries, *((t, True, 1.0 if t in common else heavy) for t in sorted(INSULTS - own)))

    halves = [sorted(rows, key=lambda r: zlib.crc32(r[0].encode()))[k::2] for k in (0, 1)]
    xs, ys = [], []
    for own, other in (halves, halves[::-1]):
        reader = Reader(with_seeds(learn_lexicon(own)))
        xs += [reader.features(t)[0] for t, _ in other]
        ys += [y for _, y in other]
    bias, weights = logistic(np.array(xs), np.array(ys, float))
    return Grammar(with_seeds(learn_lexicon(rows)), bias, tuple(weights.tolist()))


def held_out(id_col: Column) -> Column:
    """The rows whose labels are never learned: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int = TRAIN_ROWS) -> list[tuple[str, int]]:
    """At most ``limit`` labelled texts; that many ids are broadcast, so documents are not shuffled."""
    own = F.col(id_col)
    some = (
        labels.where(F.col(label_col).isNotNull() & own.isNotNull() & ~held_out(own))
        .select(own.cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id", "label")
        .limit(limit)
    )
    texts = docs.select(own.cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.where(F.coalesce(F.length("text"), F.lit(0)) <= TRAIN_CHARS).join(F.broadcast(some), "id").select("id", "text", "label").toArrow()
    rows = sorted(zip(*(found.column(c).to_pylist() for c in ("id", "label", "text")), strict=True), key=lambda r: (r[0], r[1], r[2] or ""))
    return [(t, y) for _, y, t in rows]


def score_documents(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, ``score``, ``n_matches`` and the columns ``keep`` of every row."""
    kept = docs.select(F.col(id_col), *[F.col(f"`{c}`") for c in keep if c != id_col], F.col(text_col).cast("string").alias("__jq_text"))
    schema = kept.drop("__jq_text").schema.add("score", "double").add("n_matches", "integer")

    def each(batches):
        reader = grammar.reader()
        for batch in batches:
            rows = [reader.features(t.as_py()) for t in batch.column("__jq_text")]
            scores = [grammar.score(x) for x, _ in rows]
            counts = [n for _, n in rows]
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scores, pa.float64()), pa.array(counts, pa.int32())], [*names, "score", "n_matches"])

    return kept.mapInArrow(each, schema)


def drop_toxic(docs: DataFrame, grammar: Grammar, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` whose texts score below ``threshold``; only texts leave the JVM."""

    @F.pandas_udf("boolean")
    def fine(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = grammar.reader()
        for batch in texts:
            yield pd.Series([grammar.score(reader.features(t)[0]) < threshold for t in batch], dtype=bool)

    return docs.where(fine(F.col(text_col).cast("string")))
