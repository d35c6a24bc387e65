"""SimHash, near copies, repeated passages and vectors, each against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from jobquarry.llm import common, embed_dedup, simhash, substring

from .helpers import documents, prose, words

W = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text, k=3):
    t = W.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(t[i : i + k]) for i in range(len(t) - k + 1)] or ([" ".join(t)] if t else [])
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


TEXTS = [prose(k, 60) for k in range(6)]
ROWS = (
    [(k, t, "s") for k, t in enumerate(TEXTS)]
    + [(10 + k, TEXTS[0].replace(".", " ."), "s") for k in range(3)]  # repeated texts
    + [(20, TEXTS[1].upper(), "s"), (21, None, "s"), (22, "", "s"), (23, "  \n ", None), (24, "one two", "s"), (25, "One  TWO", "s"), (26, "É é", "s"), (26, "É é", "s")]
    + [(30 + k, " ".join(TEXTS[2].split()[:-1] + [f"w{k}"]), "s") for k in range(4)]  # one word differs
    + [(40 + k, prose(40, 9_000) + " end" * k, "s") for k in range(3)]  # long ones
)


@pytest.mark.parametrize("extra", [False, True])
def test_simhash_against_brute_force(spark, extra):
    got = simhash.simhash_components(documents(spark, ROWS, extra)).collect()
    assert len(got) == len(ROWS)
    want = {i: fingerprint(t) for i, t, _ in ROWS}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in want.items()}
    ids = list(want)
    links = [(a, b) for a in ids for b in ids if a < b and bin(want[a] ^ want[b]).count("1") <= 2]
    assert {r.doc_id: r.component_id for r in got} == components(ids, links)


def test_simhash_null_ids_and_empty_table(spark):
    got = simhash.simhash_components(documents(spark, [(None, "a b c d", "s"), (5, "a b c d", None), (None, "x y z w v", "s")])).collect()
    assert sorted((r.doc_id is None, r.component_id is None) for r in got) == [(False, False), (True, False), (True, True)]
    assert simhash.simhash_components(documents(spark, [])).collect() == []


@pytest.mark.parametrize("sample_rows", [20_000, 300])
def test_tree_finds_all_pairs_in_many_shards(spark, sample_rows):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near]))
    ws = common.Workspace(spark, "test")
    distinct = ws.write(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"))
    got = {r.fp: r.root for r in simhash.hamming_components(ws, distinct, 2, shard_rows=100, sample_rows=sample_rows).collect()}
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    signed = fps.view(np.int64)
    want = components([int(x) for x in signed], [(int(signed[a]), int(signed[b])) for a, b in zip(i, j, strict=True) if a < b])
    assert got == {k: v for k, v in want.items() if k in got} and set(got) == {k for k in want if sum(v == want[k] for v in want.values()) > 1}


def test_components_of_a_long_chain(spark):
    ws = common.Workspace(spark, "chain")
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(500, 501), (501, 500), (7, 7), (None, 3)], "a long, b long"))
    got = {r.id: r.root for r in common.connected_components(ws, edges, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}
    assert common.connected_components(ws, edges.limit(0), "a", "b").collect() == []


@pytest.mark.parametrize("extra", [False, True])
def test_near_copies_leave_one(spark, extra):
    copies = [(100 + k, " ".join(w if j != 7 * k else "changed" for j, w in enumerate(words(1, 300))), "s") for k in range(5)]
    alone = [(200 + k, " ".join(words(50 + k, 300)), "s") for k in range(5)]
    docs = documents(spark, copies + alone + [(300, None, "s"), (301, "", "s"), (302, "a b", "s"), (302, "a b", "s"), (None, "a b", None)], extra)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [100, 200, 201, 202, 203, 204, 300, 302]
    assert simhash.drop_near_duplicates(documents(spark, [])).collect() == []


def similarity(a, b):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_have_the_similarity(spark):
    texts = []
    for k in range(60):  # similarities of 0.65 to 0.9, one pair or chain of three each
        w = words(7000 + k, 200)
        for n in (0, 3, 5)[: 2 + k % 2]:
            copy = [f"new{n}" if n and (j + k) % (200 // (n + k % 3)) == 9 else x for j, x in enumerate(w)]
            texts.append(" ".join(copy))
    for k in range(120):  # 6 to 10 words and one more or another one
        w = words(9000 + k, 6 + k % 5)
        texts += [" ".join(w), " ".join([*w, "more"]), " ".join([*w[:-1], "other"])]
    links = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if abs(a - b) < 3 and similarity(texts[a], texts[b]) >= 0.8]
    between = [s for a in range(150) for b in range(a + 1, a + 3) if 0.7 <= (s := similarity(texts[a], texts[b])) < 0.9]
    assert len(between) > 50 and len(links) > 50
    kept = {r.doc_id for r in simhash.drop_near_duplicates(documents(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect()}
    assert kept == set(components(range(len(texts)), links).values())


def test_only_doubtful_rows_are_moved(spark):
    """Texts that stay are not shuffled: exchanges with texts get the copies and what shares their marks."""
    rows = [(k, " ".join(words(4000 + k, 12)), "s") for k in range(400)]
    rows += [(500 + k, rows[k][1], "s") for k in range(6)] + [rows[7]] * 2
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        kept = simhash.drop_near_duplicates(documents(spark, rows, True))
        assert sorted(r.doc_id for r in kept.collect()) == list(range(400))
        todo, moved = [kept._jdf.queryExecution().executedPlan()], []
        while todo:
            p = todo.pop()
            if p.nodeName() == "Exchange" and "text#" in p.output().mkString(","):
                moved.append(p.metrics().apply("shuffleRecordsWritten").value())
            todo += [p.children().apply(k) for k in range(p.children().size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert moved and 9 <= max(moved) < 100


def test_marks_hold_all_keys(spark):
    r = np.random.default_rng(4).integers(-(2**63), 2**63, 4000)
    ws = common.Workspace(spark, "marks")
    rows = ws.write(spark.createDataFrame([(int(x), k < 500) for k, x in enumerate(r)] + [(-1, True), (63, True), (-(2**63), True)], "key long, own boolean"))
    keys = ws.write(rows.where("own").select("key"))
    got = rows.withColumn("may", common.among(keys, "key")(F.col("key"))).collect()
    assert all(x.may for x in got if x.own) and sum(x.may for x in got if not x.own) < 300
    assert not any(x.may for x in rows.select(common.among(keys.limit(0), "key")(F.col("key")).alias("may")).collect())


def test_large_shards_get_larger_blocks_instead_of_more_copies(spark):
    rows = spark.range(1000).select("id", (F.col("id") > 969).cast("int").alias("shard"))
    grid = common.block_grid(rows, ["shard"], "id", 10, 200, 4).collect()
    copies = {k: sum(x.id == k for x in grid) for k in (0, 500, 970, 999)}
    assert copies == {0: 5, 500: 5, 970: 3, 999: 3}
    meet = {}
    for x in grid:
        meet.setdefault((x.shard, x.bi, x.bj), []).append(x)
    pairs = sorted((a.id, b.id) for g in meet.values() for a in g for b in g if a.id < b.id and (a.bi == a.bj or a.blk != b.blk) and a.shard)
    assert pairs == [(a, b) for a in range(970, 1000) for b in range(a + 1, 1000)]


@pytest.mark.parametrize("blocks", [1, 5])
def test_sets_link_in_blocks_as_by_brute_force(blocks):
    r = np.random.default_rng(5)
    sets = sorted((np.unique(np.concatenate([base, r.integers(0, 99, r.integers(0, 6))])) for base in (np.arange(99, 105 + 3 * (k % 9)) for k in range(80))), key=len)
    size, blk, labels = np.array([len(x) for x in sets]), np.arange(80) % blocks, simhash.Labels(80)
    for i in range(blocks):
        for j in range(i, blocks):
            at = np.flatnonzero((blk == i) | (blk == j))
            own = simhash.Labels(len(at))
            simhash.link_sets(np.concatenate([sets[k] for k in at]), size[at], None if i == j else blk[at], 0.8, own)
            labels.link(at, at[own.of])
    links = [(a, b) for a in range(80) for b in range(a + 1, 80) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))]
    assert dict(enumerate(labels.of.tolist())) == components(range(80), links) and len(set(labels.of.tolist())) > 3


def kept_words(rows, window):
    """By definition: a word goes if a window over it starts earlier elsewhere."""
    texts = {}
    for i, t, _ in rows:
        texts[i] = W.findall(t or "")
    first = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - window + 1):
            first.setdefault(tuple(texts[i][k : k + window]), (i, k))
    out = {}
    for i, w in texts.items():
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] != (i, k) for j in range(k, k + window)}
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("group_rows", [3, 50, 60_000])
def test_repeats_against_brute_force(spark, group_rows):
    passage = words(3, 30)
    rows = [(k, " ".join(words(10 + k, 40) + passage + words(90 + k, 10)), "s") for k in range(6)]
    rows += [(20, "  ".join(passage * 3), "s"), (21, " ".join(["the"] * 70), "s"), (22, None, "s"), (23, "", "s"), (24, "short text", "s"), (25, rows[2][1], "s"), (26, " ".join(["the"] * 25), "s")]
    rows += [(30, " ".join(words(700, 3_000)), "s"), (31, " ".join(words(700, 3_000)[1_000:] + passage + words(700, 900)), "s")]
    got = substring.drop_repeats(documents(spark, rows, True), window=20, group_rows=group_rows).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == kept_words(rows, 20)
    assert {r.doc_id: r.removed for r in got}[1] == "40:70"


def test_repeats_of_equal_rows_null_ids_and_huge_words(spark):
    text = " ".join(words(5, 30))
    huge = "x" * (substring._STEP + 5)
    rows = [(1, text, "s"), (1, text, "s"), (None, text, "s"), (4, f"{huge} {text}", "s"), (5, f"{huge} y {huge}", "s")]
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring.drop_repeats(documents(spark, rows)).collect())
    assert got == [(0, 30), (1, 0), (1, 0), (4, 30), (5, 0)]
    assert substring.drop_repeats(documents(spark, [])).collect() == []


def test_word_hashes_do_not_depend_on_the_step():
    text = (" ".join(words(8, 400_000)) + " ").encode()
    starts, ends, whole = substring.tokens(text)
    assert len(text) > substring._STEP and len(whole) == 400_000 and text[starts[7] : ends[7]] == text.split()[7]
    assert (whole[:3] == substring.tokens(b"\n ".join(text.split(b" ", 4)[:3]))[2]).all()
    assert (whole[-3:] == substring.tokens(b" ".join(text.split()[-3:]))[2]).all()


def test_words_of_one_number_are_equal(monkeypatch):
    text = "a bb a ccc bb é a".encode()
    assert substring.numbered(text).tolist() == [substring.numbered(text).tolist()[k] for k in (0, 1, 0, 3, 1, 5, 0)]
    real = substring.tokens
    monkeypatch.setattr(substring, "tokens", lambda t: (*real(t)[:2], real(t)[2] % np.uint64(2)))  # hashes that collide
    long = b"x" * 30 + b" " + b"x" * 29 + b"y " + b"x" * 30 + b" " + b"x" * 8 + b" " + b"x" * 8
    assert substring.numbered(long).tolist() == [0, 1, 0, 2, 2]
    assert len(set(substring.numbered(b"a b c d e f")) - {0}) == 5 and substring.numbered(b"aa b aa c").tolist() == [0, 1, 0, 2]


@pytest.mark.parametrize("window", [2, 3, 5, 20])
def test_trees_give_the_windows_that_start_earlier(window):
    rng = np.random.default_rng(window)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(0, 90))) for _ in range(30)]
    texts += [texts[3] + " " + texts[4], "x " * 70]
    sent, data, want, seen = [], [], set(), set()
    own = substring.Suffixes([(k, 7, t.encode()) for k, t in enumerate(texts)], window)
    for one, p, f, u in zip(own.doc.tolist(), own.pos.tolist(), own.first.tolist(), own.last.tolist(), strict=True):
        sent.append((one, 7, p - own.word[one], p - f, u + window - p))
        data.append(own.text[own.starts[f] : own.ends[u + window - 1]])
    for one, text in enumerate(texts):
        w = text.split()
        for k in range(len(w) - window + 1):
            if tuple(w[k : k + window]) in seen:
                want.add((one, k))
            seen.add(tuple(w[k : k + window]))
    found = substring.repeats(np.array(sent, substring._SENT), substring.numbered(b" ".join(data)), window)
    assert {(int(m["id"]), k) for m in found for k in range(m["s"], m["e"])} == want and len(want) > 20
    assert sum(int(m["e"]) - int(m["s"]) for m in found) == len(want)


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 16))
    near = base[:100] + 0.12 * rng.standard_normal((100, 16))
    x = np.concatenate([base, near, base[:3], 7 * base[3:5]]).astype(np.float32)
    rows = [(k, [float(v) for v in r], k % 3) for k, r in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] + [1.0] * 15, 0), (903, [float("inf")] * 16, 0), (904, [None] + [1.0] * 15, 1), (905, [1.0] * 4, 1)]
    other = [(906, [2.0, 2.0, 2.0, 2.1], 1), (None, [1.0, 0.0, 0.0, 0.0], 1), (907, [1.0, 0.0, 0.0], 1), (0, [-1.0, 0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows + odd + other, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(1)).withColumn("n", F.lit("n"))
    rows = embed_dedup.vector_components(df).collect()
    assert len(rows) == len(x) + 10 and {(r.n_links, r.component_id) for r in rows if r.vec_id is None} == {(0, None)}
    assert sorted((r.n_links, r.component_id) for r in rows if r.vec_id == 0)[0] == (0, 0)
    got = {r.vec_id: (r.n_links, r.component_id) for r in sorted(rows, key=lambda r: r.n_links) if r.vec_id is not None}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    linked = (u @ u.T) >= 0.95
    np.fill_diagonal(linked, False)
    comp = components(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(linked), strict=True)])
    want = {k: (int(linked[k].sum()), comp[k]) for k in range(len(x))} | {k: (0, k) for k, _, _ in odd} | {905: (1, 905), 906: (1, 905), 907: (0, 907)}
    assert sum(n for n, _ in want.values()) > 100
    found = sum(n for n, _ in got.values()) / sum(n for n, _ in want.values())
    assert found >= 0.99 and all(got[k][0] <= want[k][0] for k in want) and set(got) == set(want)
    assert found < 1 or got == want


def test_vectors_just_at_the_threshold(spark):
    """Cosines within the band of 32-bit rounding are settled in double precision."""
    rng, rows = np.random.default_rng(3), []
    for k in range(200):
        a = rng.standard_normal(24)
        a /= np.linalg.norm(a)
        n = rng.standard_normal(24)
        n -= (n @ a) * a
        c = 0.95 + (k - 99.5) * 2e-9
        rows += [a, c * a + np.sqrt(1 - c * c) * n / np.linalg.norm(n)]
    x = np.array(rows)
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    u = embed_dedup.unit(x)
    got = {r.vec_id: r.n_links for r in embed_dedup.vector_components(df).collect()}
    assert got == {k: int((u @ u[k] >= 0.95).sum()) - 1 for k in range(len(x))} and 150 < sum(got.values()) < 250


def test_vectors_empty_and_all_unusable(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert embed_dedup.vector_components(spark.createDataFrame([], kind)).collect() == []
    got = embed_dedup.vector_components(spark.createDataFrame([(1, None, 0), (None, [0.0], 0)], kind)).collect()
    assert sorted((r.vec_id or 0, r.n_links) for r in got) == [(0, 0), (1, 0)]


def test_walk_is_the_sorted_grid():
    rng = np.random.default_rng(2)
    d1, d2 = rng.random((5, 7)), rng.random((5, 7))
    got = embed_dedup.walk(d1, d2, 20)
    want = np.argsort((d1[:, :, None] + d2[:, None, :]).reshape(5, -1), axis=1)[:, :20]
    assert (got == want).all()


def test_digest_of_the_query_is_of_the_kept_text(spark):
    rows = [(1, "a  b\nc", "s")]
    r = substring.drop_repeats(documents(spark, rows)).select(F.sha2("kept", 256).alias("d")).first()
    assert r.d == hashlib.sha256(b"a b c").hexdigest()
