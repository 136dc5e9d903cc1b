"""Secret scans in DataFrame functions only: pattern spans, and sliding-window Shannon entropy over candidate strings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns, in the order of their kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
MIN_VALUE = 6

#: Character classes of the entropy scan: candidate runs, alphabet, window, bits a character that a window must reach.
CLASSES = {
    "entropy_hex": (r"[0-9A-Fa-f]{16,}", "0123456789abcdefABCDEF", 16, 2.75),
    "entropy_base64": (r"[0-9A-Za-z+/_-]{16,}", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-", 16, 3.4),
}
#: Forms that are no secrets, each matched as a whole: UUIDs, counting alphabets, words and short numbers joined as in paths
#: and slugs, keys of manuals; and candidates of the second class that belong to the first.
ALLOWED = r"^(?:[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|(?:[A-Za-z]*)0123456789(?:abcdef(?:ghijklmnopqrstuvwxyz)?|ABCDEF(?:GHIJKLMNOPQRSTUVWXYZ)?)|[+/_-]*(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[+/_-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[+/_-]*|[0-9A-Za-z+/]*EXAMPLE(?:KEY)?)$"
ONLY_HEX = r"^[0-9A-Fa-f]+$"

_BLOCK = 256


def _running(lengths: Column) -> Column:
    """Running sums of an array of ints, in blocks, so that no long array is copied for each of its items."""
    n = F.size(lengths)
    zero = F.expr("cast(array() as array<int>)")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda k: F.slice(lengths, k * _BLOCK + 1, _BLOCK))
    add = lambda first, items: F.aggregate(items, first, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    bases = add(F.array(F.lit(0)), F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x)))
    sums = F.flatten(F.zip_with(blocks, F.slice(bases, F.lit(1), F.size(blocks)), lambda b, first: F.slice(add(F.array(first), b), F.lit(2), F.size(b))))
    return F.when(n > 0, sums).otherwise(zero)


def _with_spans(df: DataFrame, kind: str, pattern: str, keep_values: bool = False) -> DataFrame:
    """Adds array column ``kind`` of (start, kind number, end) of the matches, in code points, and ``kind_m`` with the matched strings.

    Gaps and matches alternate, so their running lengths give every place; texts without a match are told by one search.
    """
    p, none = F.lit(pattern), F.expr("cast(array() as array<string>)")
    hit = F.col("text").rlike(pattern)
    df = df.withColumn("_hit", hit)
    df = df.withColumn("_m", F.when(F.col("_hit"), F.regexp_extract_all("text", p, F.lit(0))).otherwise(none))
    df = df.withColumn("_g", F.when(F.col("_hit"), F.split("text", pattern)).otherwise(none))
    if keep_values:
        df = df.withColumn("_v", F.when(F.col("_hit"), F.regexp_extract_all("text", p, F.lit(1))).otherwise(none))
    df = df.withColumn("_l", F.zip_with("_g", "_m", lambda g, m: F.coalesce(F.length(g), F.lit(0)) + F.coalesce(F.length(m), F.lit(0))))
    df = df.withColumn("_e", _running(F.col("_l")))
    spans = F.zip_with("_m", F.slice("_e", F.lit(1), F.size("_m")), lambda m, e: F.struct((e - F.length(m)).alias("start"), F.lit(KINDS.index(kind) if kind in KINDS else -1).alias("k"), e.alias("end")))
    if keep_values:
        spans = F.transform(F.filter(F.zip_with(spans, "_v", lambda s, v: F.struct(s.alias("s"), v.alias("v"))), lambda x: F.length(x["v"]) >= MIN_VALUE), lambda x: x["s"])
    return df.withColumn(kind, spans).withColumn(f"{kind}_m", F.col("_m")).drop("_hit", "_g", "_l", "_e", "_v", "_m")


def hot_runs(candidate: Column, alphabet: str, window: int, bits: float) -> Column:
    """(first, last) of each run of characters of ``candidate`` that windows of at least ``bits`` Shannon entropy cover without a gap.

    One pass keeps the count of every character of the window, as a character of a string: the entering character's count
    grows and the leaving one's falls, no other place is touched, and the sum of c * log2(c) changes by those two alone, as
    H = log2(window) - sum / window.
    """
    table = F.array(*[F.lit(0.0)] + [F.lit(c * math.log2(c)) for c in range(1, window + 1)])
    most = window * (math.log2(window) - bits) + 1e-9
    chars = F.transform(F.split(candidate, ""), lambda ch: F.instr(F.lit(alphabet), ch) + 1)
    none = F.expr("cast(array() as array<struct<first:int,last:int>>)")
    start = F.struct(F.lit("0" * (len(alphabet) + 1)).alias("c"), F.lit(0.0).alias("s"), F.lit(0).alias("i"), none.alias("runs"))
    count = lambda c, at: F.ascii(F.substring(c, at, F.lit(1))) - 48
    put = lambda c, at, n: F.overlay(c, F.char(n + 48), at, F.lit(1))

    def enter(acc, move):
        n = count(acc["c"], move["in"])
        return F.struct(put(acc["c"], move["in"], n + 1).alias("c"), (acc["s"] + F.get(table, n + 1) - F.get(table, n)).alias("s"), acc["i"].alias("i"), acc["runs"].alias("runs"))

    def leave(acc, move):
        n = count(acc["c"], move["out"])
        full = move["out"] > 0
        c = F.when(full, put(acc["c"], move["out"], n - 1)).otherwise(acc["c"])
        s = F.when(full, acc["s"] + F.get(table, n - 1) - F.get(table, n)).otherwise(acc["s"])
        return F.struct(c.alias("c"), s.alias("s"), acc["i"].alias("i"), acc["runs"].alias("runs"))

    def mark(acc):
        i, runs = acc["i"], acc["runs"]
        first = i - (window - 1)
        joins = (F.size(runs) > 0) & (F.element_at(runs, -1)["last"] >= first - 1)
        longer = F.concat(F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))), F.array(F.struct(F.element_at(runs, -1)["first"].alias("first"), i.alias("last"))))
        more = F.concat(runs, F.array(F.struct(first.alias("first"), i.alias("last"))))
        hot = (first >= 0) & (acc["s"] <= most)
        return F.struct(acc["c"].alias("c"), acc["s"].alias("s"), (i + 1).alias("i"), F.when(hot & joins, longer).when(hot, more).otherwise(runs).alias("runs"))

    shifted = F.concat(F.array_repeat(F.lit(0), window), chars)
    moves = F.zip_with(chars, F.slice(shifted, F.lit(1), F.size(chars)), lambda a, b: F.struct(a.alias("in"), b.alias("out")))
    # three lambdas a character, each over the last one's result, so that no part of a step is worked out twice
    step = lambda acc, move: F.element_at(F.transform(F.transform(F.transform(F.array(acc), lambda x: enter(x, move)), lambda x: leave(x, move)), mark), 1)
    return F.aggregate(moves, start, step, lambda acc: acc["runs"])


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))))


def add_spans(df: DataFrame) -> DataFrame:
    """Adds ``base`` and ``found``, arrays of (start, k, end), to rows with a non-null ``text``."""
    df = _with_spans(df, "assign", ASSIGN, keep_values=True)
    df = _with_spans(df, "access", ACCESS)
    df = _with_spans(df, "hex", HEX).drop("assign_m", "access_m", "hex_m")
    df = df.withColumn("base", F.concat("assign", "access", "hex"))
    df = df.withColumn("whole", F.col("text")).withColumn("text", F.when(F.size("base") > 0, _blanked(F.col("text"), F.col("base"))).otherwise(F.col("text")))
    for kind, (pattern, alphabet, window, bits) in CLASSES.items():
        df = _with_spans(df, "run", pattern)
        pairs = F.zip_with("run", "run_m", lambda s, m: F.struct(s["start"].alias("start"), m.alias("m")))
        own = F.filter(pairs, lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]") & ~x["m"].rlike(ALLOWED) & (x["m"].rlike(ONLY_HEX) == F.lit(kind == "entropy_hex")))  # noqa: B023
        runs = F.transform(own, lambda x: F.transform(hot_runs(x["m"], alphabet, window, bits), lambda h: F.struct((x["start"] + h["first"]).alias("start"), F.lit(KINDS.index(kind)).alias("k"), (x["start"] + h["last"] + 1).alias("end"))))  # noqa: B023
        df = df.withColumn(kind, F.flatten(runs)).drop("run", "run_m")
    # a hex run inside of a longer candidate's span is part of that one
    df = df.withColumn("entropy_hex", F.filter("entropy_hex", lambda h: ~F.exists("entropy_base64", lambda b: (b["start"] <= h["start"]) & (b["end"] >= h["end"]))))
    df = df.drop("text").withColumnRenamed("whole", "text").withColumn("found", F.array_sort(F.concat("base", *CLASSES)))
    # a generator of one row: filters on the spans are not pushed into the expressions that make them
    made = [*KINDS[:3], "base", "found"]
    others = [c for c in df.columns if c not in (*KINDS, "base", "found")]
    return df.select(*others, F.inline(F.array(F.struct(*made))))


def _merged(spans: Column) -> Column:
    """Disjoint (start, end) that cover the same places as sorted spans."""
    last = lambda acc: F.element_at(acc, -1)
    longer = lambda acc, s: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"))))
    fold = lambda acc, s: F.when((F.size(acc) > 0) & (last(acc)["end"] >= s["start"]), longer(acc, s)).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))
    return F.aggregate(F.array_sort(spans), F.expr("cast(array() as array<struct<start:int,end:int>>)"), fold)


def _kept(text: Column, cut: Column) -> Column:
    """The stretches of ``text`` before, between and after the disjoint spans ``cut``."""
    starts = F.concat(F.array(F.lit(0)), F.transform(cut, lambda c: c["end"]))
    ends = F.concat(F.transform(cut, lambda c: c["start"]), F.array(F.length(text)))
    return F.zip_with(starts, ends, lambda a, b: F.substring(text, a + 1, b - a))


def _blanked(text: Column, spans: Column) -> Column:
    """``text`` with spaces in place of the spans: what they leave keeps its places."""
    cut = _merged(spans)
    blanks = F.concat(F.transform(cut, lambda c: F.repeat(F.lit(" "), c["end"] - c["start"])), F.array(F.lit("")))
    return F.array_join(F.zip_with(_kept(text, cut), blanks, lambda a, b: F.concat(a, b)), "")


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every text, with ``found``: (start, k, end) of all spans sorted.

    Base spans are the leftmost non-overlapping matches of each pattern, in code points. Entropy spans are what the windows
    of a candidate that reach the bits of its class cover; candidates are runs of a class's characters in what base spans
    leave of the text, with a digit and a letter, that no allowed form matches as a whole. Null and empty texts have no spans; rows are independent, so repeats and ties give equal rows; other
    columns of ``docs`` are ignored. No shuffle.
    """
    df = add_spans(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return df.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), "found")


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every stretch of its texts that spans of ``add_spans`` cover replaced by ``mask``; null texts stay null, other columns as they are."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    df = add_spans(held).select("row", "text", "found")
    df = df.withColumn("cut", _merged(F.col("found")))
    kept = F.array_join(_kept(F.col("text"), F.col("cut")), mask)
    text = F.when(F.col("row")["text"].isNull(), F.lit(None).cast("string")).when(F.size("cut") > 0, kept).otherwise(F.col("text"))
    return df.withColumn("new", text).select(*[F.col("new").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def oracle() -> str:
    """DuckDB SQL for the digest columns of ``secret_spans`` over ``documents``: the entropy of every window by its definition."""

    def matches(name: str, pattern: str, table: str = "d") -> str:
        p = pattern.replace("'", "''")
        return f"{name} AS (SELECT r, m, v, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) AS e FROM (SELECT r, generate_subscripts(regexp_extract_all(t, '{p}'), 1) AS i, unnest(regexp_extract_all(t, '{p}')) AS m, unnest(regexp_extract_all(t, '{p}', 1)) AS v, unnest(regexp_split_to_array(t, '{p}')[:len(regexp_extract_all(t, '{p}'))]) AS g FROM {table}))"

    names = "(['" + "','".join(KINDS) + "'])"
    spans = lambda where: f"coalesce(string_agg({names}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER ({where}), '')"
    runs = ", ".join(matches(kind, f"({pattern})", "t2") for kind, (pattern, *_) in CLASSES.items())

    def hot(kind: str, window: int, bits: float) -> str:
        own = f"SELECT r, m, e - length(m) AS s FROM {kind} WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT regexp_matches(m, '{ALLOWED}') AND regexp_matches(m, '{ONLY_HEX}') = {kind == 'entropy_hex'}"
        counts = f"SELECT r, s, i, m[CAST(i + j + 1 AS INTEGER)] AS c, count(*) AS n FROM (SELECT *, unnest(range(length(m) - {window} + 1)) AS i FROM ({own})), range({window}) w(j) GROUP BY ALL"
        windows = f"SELECT r, s + i AS i FROM ({counts}) GROUP BY r, s, i HAVING sum(n * log2(n)) <= {window * (math.log2(window) - bits) + 1e-9!r}"
        steps = f"SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {window} THEN 0 ELSE 1 END AS new FROM ({windows})"
        return f"SELECT r, min(i) AS s, {KINDS.index(kind)} AS k, max(i) + {window} AS e FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS island FROM ({steps})) GROUP BY r, island"

    classes = {kind: hot(kind, window, bits) for kind, (_, _, window, bits) in CLASSES.items()}
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        {matches("a", ASSIGN)}, {matches("b", f"({ACCESS})")}, {matches("c", f"({HEX})")},
        base AS MATERIALIZED (SELECT r, e - length(m) AS s, 0 AS k, e FROM a WHERE length(v) >= {MIN_VALUE} UNION ALL SELECT r, e - length(m), 1, e FROM b UNION ALL SELECT r, e - length(m), 2, e FROM c),
        gone AS (SELECT DISTINCT r, unnest(range(CAST(s AS BIGINT), CAST(e AS BIGINT))) AS i FROM base),
        chars AS (SELECT r, t, unnest(range(length(t))) AS i FROM d WHERE r IN (SELECT r FROM base)),
        t2 AS MATERIALIZED (SELECT r, string_agg(CASE WHEN gone.i IS NULL THEN t[CAST(chars.i + 1 AS INTEGER)] ELSE ' ' END, '' ORDER BY chars.i) AS t FROM chars LEFT JOIN gone USING (r, i) GROUP BY r
               UNION ALL SELECT r, t FROM d WHERE r NOT IN (SELECT r FROM base)),
        {runs}, h64 AS ({classes["entropy_base64"]}), h16 AS ({classes["entropy_hex"]}),
        al AS (SELECT * FROM base UNION ALL SELECT * FROM h64 UNION ALL SELECT * FROM h16 WHERE NOT EXISTS (SELECT 1 FROM h64 WHERE h64.r = h16.r AND h64.s <= h16.s AND h64.e >= h16.e))
        SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, sha256({spans("k < 3")}) AS base_sha256, {spans("k >= 0")} AS spans
        FROM d LEFT JOIN al USING (r) GROUP BY d.r, d.doc_id"""
