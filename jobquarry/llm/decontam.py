"""Benchmark decontamination: BM25 over test items with block-max WAND, then verified overlap.

The inverted index holds the test items, which are few next to the corpus; it is built and broadcast in parts of
``PART_ITEMS`` items, so what is broadcast has a fixed bound and more items mean more passes. A posting's impact is its
BM25 contribution (without query frequency), divided by its item's threshold, so one bound serves all items: a document
retrieves every item whose impacts add up to 1. The threshold is the item's own score less the heaviest impacts of as
many terms as shingles may be missing at an overlap of ``similarity``: while one shingle is held, each missing term has
a missing shingle of its own, so nothing that could pass verification is lost.

Every training document is searched by the distinct terms of its whole text, as verification is on the whole text:
the parts of an item may stand any distance apart. The pruning is that of block-max WAND, in the same order: the sum of
the largest impacts of a document's terms must reach 1 (the pivot test); then the sum of their block maxima must
reach 1 in some block of items, which is tested for all blocks in one array operation instead of cursor by cursor;
only the postings in blocks that pass are added up.

Retrieved pairs are verified on whole documents: the share of the item's five-word shingles that the document holds
must reach ``similarity``, and so must the share of the words of its question and of its answer (all sentences but
the last, and the last; items of one sentence are judged as a whole).

States: null and empty texts hold nothing; items without words are ignored; repeated items are reported once each;
items shorter than five words have one shingle, the whole item; null ids are kept; repeated documents are rows;
extra columns don't matter; an empty corpus or benchmark gives no pairs.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that are indexed and broadcast at a time.
PART_ITEMS = 2_000
SHINGLE = 5
K1, B = 1.2, 0.75
#: Items of a block.
BLOCK = 8
#: Rounding that sums of impacts are allowed.
ENOUGH = 1 - 1e-9

WORDS = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?:])\s+|\n+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased words without punctuation, so that layout and quotation don't hide an item."""
    return WORDS.findall((text or "").lower())


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)}


def parts_of(text: str) -> list[set]:
    """The item's shingles, and the words of its question and of its answer."""
    sentences = [w for w in map(words_of, SENTENCE.split(text)) if w]
    parts = [shingles(words_of(text))]
    if len(sentences) > 1:
        parts += [{w for s in sentences[:-1] for w in s}, set(sentences[-1])]
    return parts


class Index:
    """An inverted index over items: postings in item order with impacts divided by the item's threshold, their
    maxima by block of items, and the largest impact of each term."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float):
        rows = [(i, t, w) for i, t in rows if (w := words_of(t))]
        n, mean = len(rows), sum(len(w) for *_, w in rows) / max(1, len(rows))
        df = Counter(t for *_, w in rows for t in set(w))
        self.ids, self.parts = [i for i, _, _ in rows], [parts_of(t) for _, t, _ in rows]
        self.terms = {t: k for k, t in enumerate(sorted(df))}
        self.items: list[list[int]] = [[] for _ in self.terms]
        self.impacts: list[list[float]] = [[] for _ in self.terms]
        self.maxima = np.zeros((len(self.terms), -(-n // BLOCK)))
        for at, (_, _, w) in enumerate(rows):
            tf = Counter(w)
            norm = K1 * (1 - B + B * len(w) / mean)
            own = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in tf.items()}
            # At an overlap of ``similarity`` so many shingles are missing at most, and terms not more than shingles.
            missed = int((1 - similarity) * len(self.parts[at][0]) + 1e-9)
            light = sorted(own.values())
            threshold = sum(light[: max(1, len(light) - missed)])
            for t, x in own.items():
                k = self.terms[t]
                self.items[k].append(at)
                self.impacts[k].append(x / threshold)
                self.maxima[k, at // BLOCK] = max(self.maxima[k, at // BLOCK], x / threshold)
        self.top = self.maxima.max(axis=1, initial=0.0)
        self.items, self.impacts = [np.array(x) for x in self.items], [np.array(x) for x in self.impacts]

    def search(self, terms: np.ndarray) -> np.ndarray:
        """All items whose impacts over the distinct ``terms`` add up to 1 or more."""
        if self.top[terms].sum() < ENOUGH:
            return terms[:0]
        blocks = self.maxima[terms].sum(axis=0) >= ENOUGH
        if not blocks.any():
            return terms[:0]
        items = np.concatenate([self.items[t] for t in terms])
        impacts = np.concatenate([self.impacts[t] for t in terms])
        passed = blocks[items // BLOCK]
        scores = np.bincount(items[passed], impacts[passed], minlength=len(self.ids))
        return np.flatnonzero(scores >= ENOUGH)

    def overlaps(self, words: list[str], terms: np.ndarray, found: list[int], similarity: float) -> list[tuple[int, float]]:
        """(item, share of its shingles) of the verified items; ``terms`` are the words' numbers, or -1."""
        single, known = set(words), np.concatenate([[0], np.cumsum(terms >= 0)])
        held = set()
        for n in {len(next(iter(self.parts[i][0]))) for i in found}:
            # Only runs of the index's terms can be shingles of items.
            held |= {tuple(words[k : k + n]) for k in np.flatnonzero(known[n:] - known[:-n] == n).tolist()}
        out = []
        for i in found:
            whole, *rest = self.parts[i]
            share = len(whole & held) / len(whole)
            if share >= similarity and all(len(p & single) >= similarity * len(p) for p in rest):
                out.append((self.ids[i], share))
        return out

    def leaks(self, text: str | None, similarity: float) -> list[tuple[int, float]]:
        words, known = words_of(text), self.terms.get
        terms = np.fromiter((known(w, -1) for w in words), np.int64, len(words))
        found = self.search(np.unique(terms[terms >= 0])).tolist()
        return self.overlaps(words, terms, found, similarity) if found else []


def index_parts(benchmark: DataFrame, item_col: str, text_col: str, similarity: float, part_items: int = PART_ITEMS):
    """Indexes over parts of the items. The driver reads them as a stream and holds one part at a time."""
    rows = benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull())
    held = []
    for item, text in rows.distinct().sort(item_col, text_col).toLocalIterator():
        held.append((item, text))
        if len(held) >= part_items:
            yield Index(held, similarity)
            held = []
    if held:
        yield Index(held, similarity)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = 0.8) -> DataFrame:
    """A row for each document and item that it holds: the two ids and ``overlap`` (share of the item's shingles)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def scan(index):
        def each(batches):
            for batch in batches:
                out = [(one.as_py(), *leak) for one, text in zip(batch.column("id"), batch.column("text"), strict=True) for leak in index.leaks(text.as_py(), similarity)]
                columns = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["id", "item", "overlap"])

        return rows.mapInArrow(each, "id long, item long, overlap double")

    found = docs.sparkSession.createDataFrame([], "id long, item long, overlap double")
    for index in index_parts(benchmark, item_col, item_text, similarity):
        found = found.unionAll(scan(index))
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "overlap")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = 0.8) -> DataFrame:
    """The rows and columns of ``docs`` that hold no item; only texts leave the JVM for the test."""

    def clean(index):
        @F.pandas_udf("boolean")
        def test(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in texts:
                yield pd.Series([not index.leaks(t, similarity) for t in batch], dtype=bool)

        return test(F.col(text_col).cast("string"))

    for index in index_parts(benchmark, item_col, item_text, similarity):
        docs = docs.where(clean(index))
    return docs
