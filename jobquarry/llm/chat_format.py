"""Chat formatting: heterogeneous prompt, instruction and message layouts become canonical turns and training text.

A record's layout is known by a fingerprint: the hash of its nested field paths, sorted, as far as any mapping
uses them. For typed tables the paths come from the schema when the plan is made; for JSON strings every row's
fingerprint is computed from the paths it holds. The fingerprint selects a declarative mapping (``MAPPINGS``) that
says where roles and texts are. Other fields don't matter, whatever their names.

Canonical turns are rows (id, position, role, text), so long conversations are formatted turn by turn; offsets
are running sums along a conversation. The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Control
strings of this and other templates inside a text get a backslash after their first character, those that
have backslashes there get one more, so no text can open or close a turn and every text can be restored. In roles
backslashes and line ends are written as ``\\s`` and ``\\n`` first. Only DataFrame functions are used.

States: null texts and roles count as empty; a null id is one conversation; turns with a null position come
first, ties go by role and text, repeated rows stay; a record without any known layout has no turns and is
returned by ``unmapped``; an empty table gives an empty result. A conversation's text is one value of the result,
so it must fit the memory of a task.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Control strings of public chat templates, without their first character < or [.
CONTROL = r"\|[A-Za-z0-9_]*\|>|/?s>|/?SYS>>|/?INST\]|(?:bos|eos|pad|unk)>|(?:start|end)_of_turn>"
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>\n"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: ``rows`` (one turn per row: id, position, role, text columns), ``items``
    (a list field with role and text fields) or ``fields`` (fixed fields, each of them a turn; fields of the
    same role that follow each other are joined by a blank line). ``optional`` fields may be missing."""

    name: str
    rows: tuple[str, ...] = ()
    items: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()

    def paths(self) -> set[str]:
        if self.items:
            return {f"{self.items[0]}[].{x}" for x in self.items[1:]} | set(self.optional)
        return set(self.rows) | {p for p, _ in self.fields}

    def fingerprints(self) -> list[int]:
        needed = self.paths() - set(self.optional)
        return [fingerprint(needed | set(some)) for n in range(len(self.optional) + 1) for some in combinations(self.optional, n)]


def fingerprint(paths: set[str]) -> int:
    """The hash of a set of field paths; the same as Spark's xxhash64 of the sorted, joined paths."""
    h = xxhash.xxh64_intdigest("|".join(sorted(paths)).encode(), 42)
    return h - (1 << 64) if h >> 63 else h


MAPPINGS = (
    Mapping("turn rows", rows=("conv_id", "turn", "role", "text")),
    Mapping("messages", items=("messages", "role", "content"), optional=("system",)),
    Mapping("conversations", items=("conversations", "from", "value"), optional=("system",)),
    Mapping("instruction", fields=(("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")), optional=("system", "input")),
    Mapping("prompt", fields=(("system", "system"), ("prompt", "user"), ("completion", "assistant")), optional=("system",)),
    Mapping("response", fields=(("system", "system"), ("prompt", "user"), ("response", "assistant")), optional=("system",)),
    Mapping("question", fields=(("system", "system"), ("question", "user"), ("answer", "assistant")), optional=("system",)),
)
KNOWN = sorted(set().union(*(m.paths() for m in MAPPINGS)))

# Names of roles in public data sets and their canonical ones; others stay as they are.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant", "model": "assistant"}


def schema_paths(schema: T.StructType) -> set[str]:
    """Nested field paths of a table's schema; lists add ``[]``."""
    out: set[str] = set()

    def walk(kind, path):
        if isinstance(kind, T.ArrayType):
            walk(kind.elementType, f"{path}[]")
        elif isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}" if path else f.name)
        else:
            out.add(path)

    walk(schema, "")
    return out


def select_mapping(schema: T.StructType, mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping:
    """The mapping that a typed table's field paths select; fields that no mapping uses don't count."""
    paths = schema_paths(schema)
    present = fingerprint(paths & set(KNOWN))
    for m in mappings:
        if present in m.fingerprints():
            return m
    for m in mappings:  # fields of several layouts: the first mapping that has all it needs
        if m.paths() - set(m.optional) <= paths:
            return m
    raise ValueError(f"no mapping for the fields {sorted(paths)}")


def plain(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _turns_of(m: Mapping, get, items) -> Column:
    """An array of (role, text) for a record of mapping ``m``."""
    role = lambda r: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), F.lower(r)), r)
    turn = lambda r, t: F.struct(plain(r).alias("role"), plain(t).alias("text"))
    if m.items:
        rest = F.transform(items(m), lambda x: turn(role(plain(x["role"])), x["text"]))
        head = F.when(get("system").isNotNull(), F.array(turn(F.lit("system"), get("system")))) if m.optional else F.lit(None)
        empty = F.array().cast("array<struct<role:string,text:string>>")
        return F.concat(F.coalesce(head, empty), F.coalesce(rest, empty))
    joined: list[tuple[str, list[Column]]] = []
    for path, who in m.fields:
        if joined and joined[-1][0] == who:
            joined[-1][1].append(F.nullif(get(path), F.lit("")))
        else:
            joined.append((who, [get(path)]))
    made = [F.when(F.coalesce(*x).isNotNull() | F.lit(who != "system"), turn(F.lit(who), F.concat_ws("\n\n", *x))) for who, x in joined]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def turns_from_table(df: DataFrame, id_col: str | None = None, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Canonical turns (``id``, ``pos``, ``role``, ``text``) of a typed table; its schema selects the mapping."""
    m = select_mapping(df.schema, mappings)
    if m.rows:
        one, at, who, what = m.rows
        return df.select(F.col(one).alias("id"), F.col(at).alias("pos"), plain(F.col(who)).alias("role"), plain(F.col(what)).alias("text"))
    names = set(schema_paths(df.schema))
    get = lambda p: F.col(p).cast("string") if p in names else F.lit(None).cast("string")
    items = lambda m: F.transform(F.col(m.items[0]), lambda x: F.struct(x[m.items[1]].cast("string").alias("role"), x[m.items[2]].cast("string").alias("text")))
    turns = df.select(F.col(id_col).alias("id"), F.posexplode(_turns_of(m, get, items)).alias("pos", "turn"))
    return turns.select("id", "pos", "turn.role", "turn.text")


def _json_layout(json: Column) -> tuple[Column, Column]:
    """The parsed record and its fingerprint."""
    v = F.try_parse_json(json)
    has = lambda p: F.try_variant_get(v, "$." + p.replace("[]", "[0]"), "variant").isNotNull()
    return v, F.xxhash64(F.concat_ws("|", *[F.when(has(p), F.lit(p)) for p in KNOWN]))


def turns_from_json(df: DataFrame, id_col: str, json_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Canonical turns of records in JSON, each in a layout of its own."""
    v, print_ = _json_layout(F.col(json_col))
    get = lambda p: F.try_variant_get(v, f"$.{p}", "string")

    def items(m: Mapping) -> Column:
        listed = F.try_variant_get(v, f"$.{m.items[0]}", "array<variant>")
        return F.transform(listed, lambda x: F.struct(F.try_variant_get(x, f"$.{m.items[1]}", "string").alias("role"), F.try_variant_get(x, f"$.{m.items[2]}", "string").alias("text")))

    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for m in reversed([m for m in mappings if not m.rows]):
        turns = F.when(print_.isin(m.fingerprints()), _turns_of(m, get, items)).otherwise(turns)
    found = df.select(F.col(id_col).alias("id"), F.posexplode(turns).alias("pos", "turn"))
    return found.select("id", "pos", "turn.role", "turn.text")


def unmapped(df: DataFrame, id_col: str, json_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(``id``, ``fingerprint``) of the JSON records whose layout no mapping knows."""
    _, print_ = _json_layout(F.col(json_col))
    known = [x for m in mappings if not m.rows for x in m.fingerprints()]
    return df.select(F.col(id_col).alias("id"), print_.alias("fingerprint")).where(~F.col("fingerprint").isin(known))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(<|\[)(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(<|\[)\\(\\*)({CONTROL})", "$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def format_turns(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation: ``id``, ``formatted`` and ``loss_spans`` (where the texts of role ``learn`` are, as
    [start, end) in code points of ``formatted``, escapes included)."""
    along = Window.partitionBy("id").orderBy("pos", "role", "text")
    head = F.concat(F.lit(TURN_START), escape_role(F.col("role")), F.lit("\n"))
    pieces = turns.select("id", "pos", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    pieces = pieces.withColumn("piece", F.concat("head", "body", F.lit(TURN_END)))
    pieces = pieces.withColumn("nth", F.row_number().over(along)).withColumn(
        "at", F.sum(F.length("piece")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.length("piece") + F.length("head")
    )
    span = F.when(F.col("role") == learn, F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end")))
    one = F.struct("nth", "piece", span.alias("span"))
    listed = F.sort_array(F.collect_list(one)).alias("turns")
    return pieces.groupBy("id").agg(listed).select(
        "id",
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns, as an array of (role, text), restored from formatted text."""
    pieces = F.split(formatted, TURN_END.replace("|", r"\|"), -1)
    bodies = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.substr(p, F.lit(len(TURN_START) + 1)))
    return F.transform(
        bodies,
        lambda b: F.struct(
            unescape_role(F.substring_index(b, "\n", 1)).alias("role"), unescape(F.substr(b, F.locate("\n", b) + 1)).alias("text")
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
