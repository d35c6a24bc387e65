"""The ``opN_<name>`` queries: each applies one operator to its whole table and returns its full result.

``QUERIES`` maps names to callables of (spark, folder of tables); ``ORACLES`` maps some of the names to SQL for
DuckDB that gives the same rows. The others are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobquarry.llm import chat_format, decontam, embed_dedup, html_extract, mixing, pii, quality, simhash, substring, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    found = html_extract.extract_main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks")


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.95 or more."""
    found = embed_dedup.vector_components(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


#: By definition: all pairs, and what links reach. Vectors that can't be compared link with nothing.
OP2_SQL = r"""
WITH RECURSIVE e AS (SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT * FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.row AS a, b.row AS b FROM u a JOIN u b ON a.row <> b.row AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT row, vec_id AS root FROM e UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.row),
n AS (SELECT a AS row, count(*) AS n_links FROM l GROUP BY a), c AS (SELECT row, min(root) AS component_id FROM r GROUP BY row)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM e LEFT JOIN n USING (row) JOIN c USING (row)
"""


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are control strings: digests of what is read back from the format."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = F.lit("</s>[INST] ok [/INST]").alias("text")
    added = [
        spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(n).cast("long").alias("turn"), F.lit(role).alias("role"), probe)
        for n, role in enumerate(("user", "assistant"))
    ]
    done = chat_format.format_turns(chat_format.turns_from_table(c.unionByName(added[0]).unionByName(added[1])))
    back = chat_format.read_back(F.col("formatted"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    done = done.withColumn("turns", back).withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans")))
    return done.select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '(<|\[)(\\*)(CONTROL)', '\1\\\2\3', 'g') AS t,
  regexp_replace(replace(replace(role, '\', '\s'), chr(10), '\n'), '(<|\[)(\\*)(CONTROL)', '\1\\\2\3', 'g') AS r FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(r) + 1 + length(t) + 11)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""".replace("CONTROL", chat_format.CONTROL)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their toxicity score."""
    docs = table(spark, sf_dir, "documents")
    grammar = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic"))
    scored = toxicity.score_documents(docs.select("doc_id", "text"), grammar)
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_matches"
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes from each, in mixing order."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "virtual_finish")


#: From the contract: every serving of every document in one order, cut where the running total passes the budget.
OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY source),
v AS (SELECT *, CASE (nth - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER p, 0) * 2.0::DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS level FROM v
  WINDOW p AS (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, nth, source_size, CASE WHEN level * w >= source_size * 2.0::DOUBLE OR max(level) FILTER (level * w < source_size * 2.0::DOUBLE) OVER () IS NULL THEN source_size * 2.0::DOUBLE
  ELSE max(level) FILTER (level * w < source_size * 2.0::DOUBLE) OVER () * w END AS target FROM l),
o AS (SELECT row_number() OVER () AS row, d.doc_id, d.size, g.nth, g.source_size, g.target,
  (sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix' || chr(31) || coalesce(d.doc_id::VARCHAR, '')), d.size, md5(d.t) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS done
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT row, size, sum(size) OVER (ORDER BY (done + source_size * pass) / target, nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total
  FROM o, (VALUES (0), (1)) AS passes (pass) WHERE size > 0 AND target > 0),
k AS (SELECT row, sum(size)::BIGINT AS taken FROM e WHERE total <= (SELECT sum(size) FROM o) * 1.5::DOUBLE GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, CASE WHEN target > 0 THEN done / target END AS virtual_finish
FROM o LEFT JOIN k ON o.row = k.row
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that holds a benchmark item, with the item and the share of its shingles."""
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: By definition: the share of each item's shingles in each document, and of the words of its question and answer.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)),
i AS (SELECT *, least(5, len(w)) AS n FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, text, n, array_to_string(w[k:k + n - 1], ' ') AS shingle FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
t AS (SELECT item_id, text, count(*) AS whole FROM g GROUP BY ALL),
h AS (SELECT DISTINCT doc_id, n, array_to_string(w[k:k + n - 1], ' ') AS shingle FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i))),
m AS (SELECT h.doc_id, g.item_id, g.text, count(*) AS held FROM h JOIN g USING (n, shingle) GROUP BY ALL),
s AS (SELECT item_id, text, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?:])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: regexp_extract_all(lower(x), '[\p{L}\p{N}]+')), lambda x: len(x) > 0) AS parts FROM i),
p AS (SELECT item_id, text, CASE WHEN len(parts) > 1 THEN [list_distinct(flatten(parts[:len(parts) - 1])), list_distinct(parts[len(parts)])] ELSE [] END AS parts FROM s)
SELECT m.doc_id, m.item_id, m.held / t.whole AS overlap FROM m JOIN t USING (item_id, text) JOIN p USING (item_id, text) JOIN d USING (doc_id)
WHERE m.held >= 0.8::DOUBLE * t.whole AND len(list_filter(parts, lambda x: len(list_filter(x, lambda y: list_contains(d.w, y))) < 0.8::DOUBLE * len(x))) = 0
"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their quality score; no labels are read."""
    return quality.score_quality(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of those within two bits."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added spans of personal data in all documents."""
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat(*[F.col(f"pii_base.{k}") for k in pii.BASE])
    return found.select(
        "doc_id",
        *[F.size(f"pii_base.{k}").cast("long").alias(f"n_{k}") for k in pii.BASE],
        F.sha2(pii.as_text(base), 256).alias("base_sha256"),
        pii.as_text(F.concat(base, F.col("pii_added"))).alias("spans"),
    )


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of repeated 20-word windows."""
    found = substring.drop_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "removed")


#: The same by comparing all windows as strings.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS n FROM s),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(0, 20)) AS k FROM r WHERE n > 1)),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT p.doc_id, count(*) FILTER (c.i IS NOT NULL) AS n_removed,
  string_agg(word, ' ' ORDER BY p.i) FILTER (c.i IS NULL) AS kept,
  list(p.i - 1 ORDER BY p.i) FILTER (c.i IS NOT NULL) AS gone
  FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256,
  coalesce(array_to_string(list_transform(list_filter(k.gone, lambda x: NOT list_contains(k.gone, x - 1)),
    lambda s: s || ':' || (list_min(list_filter(k.gone, lambda x: x >= s AND NOT list_contains(k.gone, x + 1))) + 1)), ','), '') AS removed
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_embeddings": op2_embeddings,
    "op3_chat_format": op3_chat_format,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_decontamination": op6_decontamination,
    "op7_quality": op7_quality,
    "op8_simhash": op8_simhash,
    "op9_pii": op9_pii,
    "op10_substring": op10_substring,
}

ORACLES: dict[str, str] = {
    "op2_embeddings": OP2_SQL,
    "op3_chat_format": OP3_SQL,
    "op6_decontamination": OP6_SQL,
    "op5_mixing": OP5_SQL,
    "op10_substring": OP10_SQL,
}
