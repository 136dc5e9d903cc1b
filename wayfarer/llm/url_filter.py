"""URL filters: dated list entries become validity intervals, and an as-of join finds those active when a page was fetched. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.llm.common import small

#: Intervals up to which the list is broadcast; a larger one is joined by a shuffle.
SMALL_ROWS = 500_000

#: Fixed values of the sample list: (list, domain, day, 1 for an entry and 0 for its withdrawal).
SAMPLE = (
    ("spam", "casino-win.example.com", "2024-01-01", 1),
    ("spam", "casino-win.example.com", "2024-05-01", 0),
    ("spam", "casino-win.example.com", "2024-08-15", 1),
    ("spam", "cheap-pills.example.com", "2024-03-01", 1),
    ("spam", "free-bets.example.com", "2024-02-10", 1),
    ("spam", "free-bets.example.com", "2024-02-10", 0),
    ("spam", "free-bets.example.com", "2024-06-20", 1),
    ("adult", "example.org", "2024-07-01", 1),
    ("adult", "example.org", "2024-07-15", 0),
    ("malware", "blog.tionsh.example.com", "2024-09-01", 1),
    ("malware", "m.casino-win.example.com", "2024-04-01", 1),
    ("malware", "m.casino-win.example.com", "2024-04-01", 1),
)


def sample_entries(pages: DataFrame) -> DataFrame:
    """list_name, domain, day, listed: the sample list, and for tables without a list of their own a dated one of their hosts.

    From the md5 of a host come whether it is ever listed (a quarter of hosts are), by which of two lists, when first, for
    how many days, and when again.
    """
    rows = ", ".join(f"('{a}', '{b}', DATE '{c}', {d})" for a, b, c, d in SAMPLE)
    fixed = pages.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(list_name, domain, day, listed)")
    hosts = pages.select(host(F.col("url")).alias("domain")).filter("domain IS NOT NULL").distinct().withColumn("h", F.md5("domain"))
    part = lambda at, mod: F.pmod(F.conv(F.substring("h", at, 4), 16, 10).cast("int"), F.lit(mod))
    first = F.date_add(F.lit("2024-01-01").cast("date"), part(2, 300))
    gone = F.date_add(first, part(6, 60))
    again = F.date_add(gone, part(10, 120))
    made = hosts.filter(F.substring("h", 1, 1) < "4").select(F.when(part(14, 2) == 0, "spam").otherwise("adult").alias("list_name"), "domain", F.explode(F.array(F.struct(first.alias("day"), F.lit(1).alias("listed")), F.struct(gone.alias("day"), F.lit(0).alias("listed")), F.struct(again.alias("day"), F.lit(1).alias("listed")))).alias("e"))
    return fixed.unionByName(made.select("list_name", "domain", "e.day", "e.listed"))


def capture_day(column: str) -> Column:
    """The day of a capture where the table holds none: page ids go round the days of 2024; null for a null id."""
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col(column), F.lit(366)).cast("int"))


def host(url: Column) -> Column:
    """Lower-case host of a URL without user, port and last dot; null where there is none."""
    found = F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    bare = F.regexp_replace(found, r"\.+$", "")
    return F.when(bare != "", bare)


def suffixes(name: Column) -> Column:
    """A host and its parent domains, the longest first."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts) - k + 1), "."))


def validity(entries: DataFrame) -> DataFrame:
    """list_name, domain, since, until: half-open intervals of days in which a list names a domain.

    Entries are ordered by day; of one day's entries a listing wins over a withdrawal only if no withdrawal is there, so a
    domain entered and withdrawn on one day stays out. Repeated listings extend an interval, withdrawals without one do
    nothing. Null domains, days and list names are left out. An open interval has a null ``until``.
    """
    daily = entries.filter(F.col("domain").isNotNull() & F.col("day").isNotNull() & F.col("list_name").isNotNull()).groupBy("list_name", F.lower("domain").alias("domain"), "day").agg(F.min(F.coalesce(F.col("listed"), F.lit(0))).alias("listed"))
    own = Window.partitionBy("list_name", "domain").orderBy("day")
    changes = daily.withColumn("was", F.coalesce(F.lag("listed").over(own), F.lit(0))).filter(F.col("was") != F.col("listed"))
    return changes.withColumn("until", F.lead("day").over(own)).filter("listed = 1").select("list_name", "domain", F.col("day").alias("since"), "until")


#: Hosts and days of a domain that one slice of a shuffled join takes.
HOT = 100_000


def evaluate(captures: DataFrame, intervals: DataFrame) -> DataFrame:
    """The captures (page_id, url, fetched) with host, n_active, lists and blocked as of the day they were fetched.

    A capture meets the intervals of its host and of every parent domain that hold its day; of a list and domain there is
    at most one. What is active is found once for each host and day, so a host of any size costs its days, and a capture
    takes what its own host and day have: pages captured on several days are judged on each. Captures without a host or day
    meet none; repeated captures are each returned; an empty list blocks nothing. A list too large to broadcast is
    shuffled by domain, domains of many hosts and days over several slices.
    """
    rows = captures.select("page_id", "url", "fetched", host(F.col("url")).alias("host"))
    asked = rows.select("host", "fetched").filter("host IS NOT NULL AND fetched IS NOT NULL").distinct()
    asked = asked.select("host", "fetched", F.explode(suffixes(F.col("host"))).alias("domain"))
    if intervals.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        met = asked.join(F.broadcast(intervals), "domain")
    else:
        hot = asked.groupBy("domain").agg(F.count("*").alias("many")).filter(F.col("many") > HOT).select("domain", F.ceil(F.col("many") / HOT).cast("int").alias("slices"))
        slices = F.coalesce("slices", F.lit(1))
        dealt = asked.join(hot, "domain", "left").withColumn("slice", F.pmod(F.xxhash64("host", "fetched"), slices).cast("int")).drop("slices")
        spread = intervals.join(hot, "domain", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("slices")
        met = dealt.join(spread, ["domain", "slice"])
    met = met.filter((F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    active = met.groupBy("host", "fetched").agg(F.countDistinct("list_name", "domain").alias("n"), F.array_sort(F.collect_set("list_name")).alias("names"))
    joined = rows.join(small(active), ["host", "fetched"], "left")
    return joined.select("page_id", "url", "fetched", "host", F.coalesce("n", F.lit(0)).alias("n_active"), F.coalesce(F.array_join("names", ","), F.lit("")).alias("lists"), F.coalesce(F.col("n") > 0, F.lit(False)).alias("blocked"))


def oracle() -> str:
    """DuckDB SQL for the rows of the registered query."""
    rows = ", ".join(f"('{a}', '{b}', DATE '{c}', {d})" for a, b, c, d in SAMPLE)
    found = r"nullif(rtrim(regexp_extract(lower(url), '^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '.'), '')"
    part = lambda at, mod: f"CAST(CAST('0x' || substr(h, {at}, 4) AS BIGINT) % {mod} AS INTEGER)"
    first, gone, again = part(2, 300), f"{part(2, 300)} + {part(6, 60)}", f"{part(2, 300)} + {part(6, 60)} + {part(10, 120)}"
    return f"""
        WITH hs AS (SELECT DISTINCT {found} AS domain, md5({found}) AS h FROM pages),
        e AS (SELECT * FROM (VALUES {rows}) v(list_name, domain, day, listed) UNION ALL
              SELECT CASE WHEN {part(14, 2)} = 0 THEN 'spam' ELSE 'adult' END, domain, DATE '2024-01-01' + unnest([{first}, {gone}, {again}]), unnest([1, 0, 1]) FROM hs WHERE domain IS NOT NULL AND substr(h, 1, 1) < '4'),
        daily AS (SELECT list_name, domain, day, min(listed) AS listed FROM e GROUP BY ALL),
        was AS (SELECT *, coalesce(lag(listed) OVER (PARTITION BY list_name, domain ORDER BY day), 0) AS was FROM daily),
        iv AS (SELECT list_name, domain, day AS since, until FROM
               (SELECT *, lead(day) OVER (PARTITION BY list_name, domain ORDER BY day) AS until FROM was WHERE was <> listed) WHERE listed = 1),
        c AS MATERIALIZED (SELECT row_number() OVER () AS r, page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched,
              {found} AS host FROM pages),
        m AS (SELECT r, count(DISTINCT (list_name, domain)) AS n, string_agg(DISTINCT list_name, ',' ORDER BY list_name) AS l FROM c JOIN iv
              ON (c.host = iv.domain OR ends_with(c.host, '.' || iv.domain)) AND fetched >= since AND (until IS NULL OR fetched < until) GROUP BY r)
        SELECT page_id, url, strftime(fetched, '%Y-%m-%d') AS fetched, host, CAST(coalesce(n, 0) AS BIGINT) AS n_active, coalesce(l, '') AS lists, n IS NOT NULL AS blocked
        FROM c LEFT JOIN m USING (r)"""
