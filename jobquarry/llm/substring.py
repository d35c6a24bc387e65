"""Removal of repeated word sequences with prefix-partitioned suffix trees.

A window of ``window`` words repeats if its words start earlier as well. Suffixes are kept at anchors only: the anchor of a
window is, of the runs of ``PREFIX_WORDS`` words in it, the one with the least hash (the first of equals). It follows from the
window's words alone, so equal windows have their anchors at the same place, and windows that lie side by side mostly share
one: about one word in ten starts a suffix.

1. A suffix carries the words of its windows: those after its anchor, which the tree is over, and those before it, which a
   second tree is over, read backwards. Its prefix, the anchor's words, selects its group. A census counts the suffixes by
   group; the number of groups grows with the text. Groups that a very common prefix makes too large get longer prefixes: each
   window is a suffix of its own there, and all its words are the prefix.
2. A map task reads a few megabytes of text at a time. Equal suffixes of one task are contracted to the earliest, so a passage
   that a third of all documents carry reaches its group once for each task, not once for each document.
3. A group sorts its suffixes by their words, forwards and backwards. Common prefixes of neighbours give the internal nodes of
   both trees at any depth. Windows are equal if their anchors lie at the same place and they hang below one node of depth
   ``window`` less that place forwards and of that depth backwards: such nodes are the repeats. All windows of a node but the
   earliest are marked.
4. Marks are ranges of starts, gathered by document; a document's marks are its own, so this is bounded by its length.

Words are numbered within a group by 64-bit hashes, and all words of one number are compared byte by byte, so equal numbers
are equal words; what hashes decide besides is only where suffixes go.

States: null text counts as no words; shorter documents than the window keep all; a null id counts as the
largest id; repeated rows (same id and text) have the same starts, none of which is earlier, so they don't
remove each other; rows with one id but different texts are one document for the order of starts; extra
columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobquarry.llm.common import Workspace

#: Words of an anchor, which are the shortest prefix that splits suffixes.
PREFIX_WORDS = 3
#: Suffixes that a group should hold (some 300 bytes each); one of twice as many is split by longer prefixes.
GROUP_ROWS = 60_000
#: Bytes of text that a suffix stands for, about.
SUFFIX_BYTES = 60
#: Groups at least, so that small tables are several tasks.
GROUPS = 16
#: Bytes of text that a map task turns into suffixes at a time.
CHUNK = 8 << 20

_RNG = np.random.default_rng(20)
_BYTES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (int(_RNG.integers(0, 1 << 61)) << 2) | 3
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_STEP = 1 << 20
_POWERS = np.cumprod(np.full(_STEP, _BASE, np.uint64))
_INVERSE = np.cumprod(np.full(_STEP, pow(_BASE, -1, 1 << 64), np.uint64))
#: What a suffix is sent with: order and tag of its document, word of its anchor, words before and from the anchor on.
_SENT = np.dtype([("id", "<i8"), ("tag", "<u4"), ("pos", "<u4"), ("left", "<u4"), ("right", "<u4")])
_MARK = np.dtype([("id", "<i8"), ("tag", "<u4"), ("s", "<u4"), ("e", "<u4")])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def tokens(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and 64-bit hash of each word, whatever the text's length. Hashes are made in steps of bytes; a
    word beyond a step is hashed alone."""
    piece = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[piece], [True]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + _STEP, "right")))
        one = piece[starts[at] : ends[upto - 1]]
        if len(one) > _STEP:
            out[at] = xxhash.xxh64_intdigest(one.tobytes())
        else:
            s, e = starts[at:upto] - starts[at], ends[at:upto] - starts[at]
            sums = np.zeros(len(one) + 1, np.uint64)
            np.cumsum(_BYTES[one] * _POWERS[: len(one)], out=sums[1:])
            out[at:upto] = mix((sums[e] - sums[s]) * _INVERSE[s])
        at = upto
    return starts, ends, out


def numbered(text: bytes) -> np.ndarray:
    """A number for each word of ``text``; numbers are equal exactly where words are."""
    starts, ends, hashes = tokens(text)
    _, first, numbers = np.unique(hashes, return_index=True, return_inverse=True)
    size, same = ends - starts, starts[first[numbers]]
    if (size == size[first[numbers]]).all():
        # Words are compared with the first one of their number by eight bytes at a time.
        padded = np.frombuffer(text + bytes(8), np.uint8)
        eight = np.ndarray(len(padded) - 7, "<u8", padded, 0, (1,))
        at, left, equal = starts, size, True
        while equal and len(at):
            shift = (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64)) % np.uint64(64)
            equal = bool(((eight[at] << shift) == (eight[same] << shift)).all())
            more = left > 8
            at, same, left = at[more] + 8, same[more] + 8, left[more] - 8
        if equal:
            return numbers.astype(np.int32)
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(text[s:e], len(known)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.int32)


def runs_hashed(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each ``size`` words in a row, put together from those of half as many."""
    if size == 1:
        return words
    half = size // 2
    left, right = runs_hashed(words, half), runs_hashed(words, size - half)
    n = max(0, len(words) - size + 1)
    return mix(left[:n] * np.uint64(0x9E3779B97F4A7C15) + right[half : half + n] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(size))


def least_of(h: np.ndarray, size: int) -> np.ndarray:
    """For each ``size`` neighbours the position of the least, the first of equals."""
    low, at, width = h, np.arange(len(h)), 1
    while width < size:
        by = min(width, size - width)
        n = len(low) - by
        other = low[by:] < low[:n]
        low, at, width = np.where(other, low[by:], low[:n]), np.where(other, at[by:], at[:n]), width + by
    return at


def chunks(batches):
    """Yields lists of (id, tag, text) of a few megabytes, in the order of ids."""
    held, size = [], 0
    for batch in batches:
        for one, tag, text in zip(*(batch.column(c) for c in ("id", "tag", "text")), strict=True):
            data = (text.as_py() or "").encode()
            held.append((one.as_py(), tag.as_py(), data))
            size += len(data)
            if size >= CHUNK:
                yield sorted(held, key=lambda d: d[0])
                held, size = [], 0
    if held:
        yield sorted(held, key=lambda d: d[0])


class Suffixes:
    """The suffixes of some documents (id, tag, text), in their order: the document of each, its anchor, first and last
    start of its windows (as words of all documents together), and hashes of its prefix and of all its words."""

    def __init__(self, docs: list, window: int):
        self.text = b" ".join(text for _, _, text in docs)
        self.starts, self.ends, words = tokens(self.text)
        offsets = np.cumsum([0] + [len(text) + 1 for _, _, text in docs])
        #: The first word of each document, and one after the last.
        self.word = np.searchsorted(self.starts, offsets)
        short, n = min(PREFIX_WORDS, window), max(0, len(words) - window + 1)
        h, self.windows = runs_hashed(words, short), runs_hashed(words, window)
        doc = np.repeat(np.arange(len(docs)), np.diff(self.word))
        starts = np.flatnonzero(doc[:n] == doc[window - 1 : window - 1 + n])
        at = least_of(h, window - short + 1)[starts] if n else starts
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]) if len(starts) else np.zeros(0, bool)
        self.first, self.last = starts[new], starts[np.concatenate([new[1:], [True]])] if len(starts) else starts
        self.pos, self.doc = at[new], doc[self.first]
        self.prefix = mix(h[self.pos] + np.uint64(0x9E3779B97F4A7C15))
        self.whole = mix(self.windows[self.first] * np.uint64(3) + self.windows[self.last])


def census(rows: DataFrame, window: int, groups: int, group_rows: int) -> dict[int, int]:
    """Groups with over ``2 * group_rows`` suffixes and how many windows they hold. Equal suffixes of a chunk count once,
    as they are sent once. Counts of all groups stay in the cluster."""

    def count(batches):
        for docs in chunks(batches):
            seen = Suffixes(docs, window)
            size = seen.last - seen.first + 1
            one = np.unique(seen.whole, return_index=True)[1]
            own, at = np.unique(seen.prefix[one] % np.uint64(groups), return_inverse=True)
            columns = [own.astype(np.int64), np.bincount(at, minlength=len(own)), np.bincount(at, size[one], len(own)).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["grp", "n", "windows"])

    found = rows.mapInArrow(count, "grp long, n long, windows long").groupBy("grp").agg(F.sum("n").alias("n"), F.sum("windows").alias("windows"))
    return {r["grp"]: r["windows"] for r in found.where(F.col("n") > 2 * group_rows).collect()}


def earliest(h: np.ndarray, order: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Of leaves below nodes ``h`` those that are later than the earliest (``order``, ``pos``) of their node."""
    by = np.argsort(h, kind="stable")
    if not len(by):
        return by
    new = np.concatenate([[True], h[by][1:] != h[by][:-1]])
    node = np.cumsum(new) - 1
    shared = np.flatnonzero(np.bincount(node)[node] > 1)
    part = by[shared]
    by[shared] = part[np.lexsort((pos[part], order[part], node[shared]))]
    first = by[new][node]
    return by[(order[by] != order[first]) | (pos[by] != pos[first])]


class Tree:
    """Rows of numbers, sorted, with the lengths of the prefixes that neighbours share."""

    def __init__(self, rows: np.ndarray):
        self.by = np.lexsort(rows.T[::-1]) if rows.shape[1] else np.arange(len(rows))
        kept = rows[self.by]
        self.shared = np.logical_and.accumulate(kept[1:] == kept[:-1], axis=1).sum(axis=1)

    def nodes(self, depth: int) -> np.ndarray:
        """For each row the number of the node at ``depth`` above it."""
        out = np.empty(len(self.by), np.int64)
        out[self.by] = np.concatenate([[0], np.cumsum(self.shared < depth)])
        return out


def repeats(sent: np.ndarray, numbers: np.ndarray, window: int) -> np.ndarray:
    """Marks for the windows of the suffixes ``sent`` that are equal to an earlier one; ``numbers`` are their words."""
    n, left, right = len(sent), sent["left"].astype(np.int64), sent["right"].astype(np.int64)
    anchor = np.cumsum(left + right) - right
    ahead, back = np.full((n, window), -1, np.int32), np.full((n, int(left.max(initial=0))), -1, np.int32)
    for d in range(window):
        ok = right > d
        ahead[ok, d] = numbers[anchor[ok] + d]
    for d in range(back.shape[1]):
        ok = left > d
        back[ok, d] = numbers[anchor[ok] - 1 - d]
    forwards, backwards = Tree(ahead), Tree(back)
    rows, starts = [], []
    for o in range(back.shape[1] + 1):
        own = np.flatnonzero((left >= o) & (window - right <= o))
        if len(own):
            start = sent["pos"][own].astype(np.int64) - o
            later = earliest(forwards.nodes(window - o)[own] * n + backwards.nodes(o)[own], sent["id"][own], start)
            rows.append(own[later])
            starts.append(start[later])
    row, start = np.concatenate(rows), np.concatenate(starts)
    return ranges(sent["id"][row], sent["tag"][row], start)


def ranges(ids: np.ndarray, tags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Starts as ranges of neighbours."""
    by = np.lexsort((starts, tags, ids))
    ids, tags, starts = ids[by], tags[by], starts[by]
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]) | (starts[1:] > starts[:-1] + 1)]) if len(by) else np.zeros(0, bool)
    out = np.empty(int(new.sum()), _MARK)
    out["id"], out["tag"], out["s"] = ids[new], tags[new], starts[new]
    out["e"] = starts[np.concatenate([new[1:], [True]])] + 1 if len(by) else 0
    return out


def repeated_starts(rows: DataFrame, window: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``id``, ``tag``, ``s``, ``e``: ranges of starts of windows that occur earlier; ``rows`` has ``id``, ``tag`` and ``text``."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(GROUPS, size // (SUFFIX_BYTES * group_rows) + 1)
    large = census(rows, window, groups, group_rows)
    common, spread = np.array(sorted(large), np.int64), max(1, sum(large.values()) // group_rows)

    def send(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for docs in chunks(batches):
            own = Suffixes(docs, window)
            group = (own.prefix % np.uint64(groups)).astype(np.int64)
            pos, first, last, doc = own.pos, own.first, own.last, own.doc
            split = np.isin(group, common)
            if split.any():
                count = (last - first + 1)[split]
                single = np.repeat(first[split] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
                group = np.concatenate([group[~split], groups + (own.windows[single] % np.uint64(spread)).astype(np.int64)])
                pos, first, last = np.concatenate([pos[~split], single]), np.concatenate([first[~split], single]), np.concatenate([last[~split], single])
                doc = np.concatenate([doc[~split], np.repeat(doc[split], count)])
                by = np.argsort(first, kind="stable")
                group, pos, first, last, doc = (x[by] for x in (group, pos, first, last, doc))
            text, base = own.text, own.word[doc]
            begin, end = own.starts[first].tolist(), own.ends[last + window - 1].tolist()
            known: dict[tuple, tuple] = {}
            sent: dict[int, list] = {}
            marks: list[list] = []
            for g, d, p, f, u, b, e in zip(group.tolist(), doc.tolist(), (pos - base).tolist(), (first - base).tolist(), (last - base).tolist(), begin, end, strict=True):
                one, tag, _ = docs[d]
                words = text[b:e]
                at = known.setdefault((words, p - f), (one, p))
                if at[0] == one and at[1] == p:
                    sent.setdefault(g, []).append(((one, tag, p, p - f, u + window - p), words))
                elif marks and marks[-1][0] == one and marks[-1][1] == tag and marks[-1][3] == f:
                    marks[-1][3] = u + 1
                else:
                    marks.append([one, tag, f, u + 1])
            if marks:
                found = np.array(list(map(tuple, marks)), _MARK)
                where = mix(found["id"].astype(np.uint64)) % np.uint64(groups)
                for g in np.unique(where).tolist():
                    sent[-1 - g] = found[where == g]
            out = [(g, pack(x.tobytes()) if g < 0 else packed(x, pack)) for g, x in sent.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["grp", "data"])

    def nodes(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        parts = [unpack(x.as_py()) for x in table.column("data")]
        if table.column("grp")[0].as_py() < 0:
            found = np.frombuffer(b"".join(parts), _MARK)
        else:
            heads, texts = zip(*map(parted, parts), strict=True)
            found = repeats(np.concatenate(heads), numbered(b" ".join(texts)), window)
        return pa.table({c: found[c].astype(np.int64) for c in ("id", "tag", "s", "e")})

    sent = rows.mapInArrow(send, "grp long, data binary")
    return sent.groupBy("grp").applyInArrow(nodes, "id long, tag long, s long, e long")


def packed(suffixes: list, pack) -> bytes:
    head = np.array([about for about, _ in suffixes], _SENT)
    return pack(struct.pack("<I", len(head)) + head.tobytes() + b" ".join(words for _, words in suffixes))


def parted(data: bytes) -> tuple[np.ndarray, bytes]:
    (n,) = struct.unpack_from("<I", data)
    upto = 4 + n * _SENT.itemsize
    return np.frombuffer(data[4:upto], _SENT), data[upto:]


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_words``, ``n_removed``, ``kept`` (the remaining words joined by one
    space) and ``removed`` (the maximal removed runs as [start, end) in words, joined by commas)."""
    keyed = docs.select(
        F.col(id_col).cast("long").alias("own"),
        F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"),
        F.coalesce(F.crc32(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("tag"),
        F.col(text_col).cast("string").alias("text"),
    )
    marks = repeated_starts(keyed.select("id", "tag", "text"), window, group_rows)
    marks = Workspace(docs.sparkSession, "substring").write(marks)
    marks = marks.groupBy("id", "tag").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))

    def cut(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            n_words, n_removed, kept, removed = [], [], [], []
            for text, *edges in zip(*(batch.column(c) for c in ("text", "s", "e")), strict=True):
                words = unpack(text.as_py()).split()
                gone = np.zeros(len(words) + 1, np.int32)
                if edges[0].is_valid:
                    s, e = (x.values.to_numpy() for x in edges)
                    np.add.at(gone, s, 1)
                    np.add.at(gone, e - 1 + window, -1)
                covered = np.cumsum(gone)[:-1] > 0
                n_words.append(len(words))
                n_removed.append(int(covered.sum()))
                kept.append(b" ".join([words[k] for k in np.flatnonzero(~covered)] if n_removed[-1] else words).decode())
                edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                removed.append(",".join(f"{s}:{e}" for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(removed, pa.string())], ["id", "n_words", "n_removed", "kept", "removed"])

    def small(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = pa.array([pack((t.as_py() or "").encode()) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("own", "id", "tag")), texts], ["own", "id", "tag", "text"])

    texts = keyed.mapInArrow(small, "own long, id long, tag long, text binary")
    joined = texts.join(marks, ["id", "tag"], "left").select("own", "text", "s", "e")
    return joined.mapInArrow(cut, "id long, n_words long, n_removed long, kept string, removed string").withColumnRenamed("id", id_col)
