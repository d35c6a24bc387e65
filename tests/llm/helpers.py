"""Small tables with everything that operators must bear: nulls, empty and long texts, ties, repeated rows, extra columns."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ("id", "key", "fp", "fp2", "size", "tag", "own", "group", "node", "score", "taken", "target", "starts", "kept", "v", "w", "order", "cum", "base", "range", "leaf", "shard", "pii_base")


def documents(spark, rows, extra=False):
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if extra else df


def words(seed, n):
    """``n`` made-up words, the same for the same seed."""
    import random

    r = random.Random(seed)
    return [r.choice("bcdfgklmnprst") + r.choice("aeiou") + r.choice("bcdfgklmnprst") + r.choice("aeiou") + str(r.randrange(40)) for _ in range(n)]


def prose(seed, n):
    import random

    r = random.Random(seed)
    w = ["".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.randrange(3, 9))) for _ in range(n)]
    return ". ".join(" ".join(w[k : k + 9]).capitalize() for k in range(0, n, 9)) + "."


def nodes(df):
    """Names of the nodes of a plan."""
    todo, out = [df._jdf.queryExecution().sparkPlan()], []
    while todo:
        p = todo.pop()
        out.append(p.nodeName())
        kids = p.children()
        todo += [kids.apply(k) for k in range(kids.size())]
    return " ".join(out)
