"""URL filters by a temporal list join.

List entries are dated: at a time, a pattern (a host with all its subdomains, or a
host with a path prefix) goes on a list or comes off it. Entries of one pattern
become validity intervals [from, until) by looking at the next entry of the same
pattern. A capture is judged by the entries active when it was fetched: an as-of
join on the pattern's host and the capture's time.

Equal captures are folded to one row with their number. Distinct hosts, not captures,
are expanded to their parent domains and joined to the listed patterns. The as-of join
then pairs each capture with those intervals of its host's patterns that hold its fetch
time: of one pattern there is one at most. A host that holds a third of all captures is
dealt over salted keys for it.

Defined results: a null or unreadable URL or a null time is never listed; repeated
entries have no effect; of entries of the same pattern and time the last action in
order add < remove wins; a prefix covers whole steps of a path; repeated captures are each judged; an empty list blocks
nothing; an empty capture table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shuffle_width

# Scheme, optional user part, host, optional port, path.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def url_host(url: Column) -> Column:
    """Lower-case host of a URL without a dot at its end, or null; a host with white space is none."""
    host = F.lower(F.rtrim(F.regexp_extract(url, HOST, 1), F.lit(".")))
    return F.when((host != "") & ~host.rlike(r"\s"), host)


def url_path(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, PATH, 1), F.lit("")), F.lit("/"))


def parent_domains(host: Column) -> Column:
    """The host itself and every parent domain of at least two labels."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.when(n < 2, F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, i, n), ".")))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(domain, prefix, list_name, valid_from, valid_until) from dated (domain, prefix, list_name, at, action).

    prefix "/" stands for the whole host; action is "add" or "remove"; valid_until is null while open.
    """
    pattern = ["list_name", "domain", "prefix"]
    last = entries.groupBy(*pattern, "at").agg(F.max("action").alias("action"))
    order = W.partitionBy(*pattern).orderBy("at")
    changed = last.withColumn("was", F.lag("action").over(order)).filter("was is null or was <> action")
    closed = changed.withColumn("valid_until", F.lead("at").over(order))
    return closed.filter("action = 'add'").select(*pattern, F.col("at").alias("valid_from"), "valid_until")


def judge_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """One row per capture: id, host, fetch time, n_active (entries active for it then), lists (their names, sorted) and blocked."""
    seen = captures.select(
        F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"), F.col(time_col).alias("fetched")
    )
    every = ["id", "host", "path", "fetched"]
    folded = seen.groupBy(*every).agg(F.count(F.lit(1)).alias("copies"))
    met = as_of(folded, validity_intervals(entries))
    judged = met.groupBy(*every).agg(
        F.min("copies").alias("copies"), F.count("list_name").alias("n_active"), F.array_join(F.sort_array(F.collect_set("list_name")), ",").alias("lists")
    )
    return judged.select(
        F.col("id").alias(id_col), "host", F.col("fetched").alias(time_col), "n_active", "lists", (F.col("n_active") > 0).alias("blocked"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


def as_of(captures: DataFrame, intervals: DataFrame, salts: int | None = None) -> DataFrame:
    """captures (host, path, fetched, ...) with list_name, domain and prefix of each interval that holds: one row for each, one with nulls where there is none.

    A pattern covers its domain with all subdomains, and whole steps of a path. Captures
    are dealt into ``salts`` parts (by default twice the shuffle width); a host's few
    intervals go to each part that has captures of it.
    """
    hosts = captures.select("host").filter("host is not null").distinct()
    reach = hosts.select("host", F.explode(parent_domains(F.col("host"))).alias("domain")).join(intervals, "domain")
    dealt = captures.withColumn("part", F.pmod(F.xxhash64("path", "fetched", *[c for c in captures.columns if c not in ("host", "path", "fetched")]), F.lit(salts or 2 * shuffle_width(captures.sparkSession))))
    rules = dealt.select("host", "part").distinct().join(reach, "host")
    c, r = dealt.alias("c"), rules.alias("r")
    path, prefix = F.col("c.path"), F.col("r.prefix")
    # "/en" covers "/en" and "/en/x", not "/english".
    under = path.startswith(prefix) & (prefix.endswith("/") | (path == prefix) | path.startswith(F.concat(prefix, F.lit("/"))))
    holds = (F.col("r.valid_from") <= F.col("c.fetched")) & (F.col("r.valid_until").isNull() | (F.col("c.fetched") < F.col("r.valid_until")))
    on = (F.col("c.host") == F.col("r.host")) & (F.col("c.part") == F.col("r.part")) & holds & under
    return c.join(r, on, "left").select("c.*", "r.list_name", "r.domain", "r.prefix").drop("part")
