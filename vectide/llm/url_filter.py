"""URL lists over time: dated entries become validity intervals, and each capture meets those active when it was fetched.

An entry names a host (``host``), a domain with its subdomains (``domain``) or one address (``url``). A capture has one
key for its address, one for its host and one for each domain above it; keys are joined to intervals by
equality, and the fetch time picks the active one. A list has at most one interval per key and day, so a key's side of
the join is bounded by the calendar; the captures' side is dealt into ``lots``, and each lot meets a copy of the list, so a host with a
third of all captures makes no task large. Keys of a kind or depth (number of labels) that no entry has, such as top-level domains, are never made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and a final dot; empty where there is none."""
    h = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.rtrim(F.lower(h), F.lit("."))


def address_of(url: Column) -> Column:
    """Host, path and query: without scheme, user, port and fragment."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.concat(host_of(url), F.when(rest == "", F.lit("/")).otherwise(rest))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """list, kind, pattern, since, until from dated entries (list, kind, pattern, day, action: add or remove).

    An interval runs from an add up to the next remove (until is null while there is none). Of several entries for
    one key on one day a remove counts. Entries with a null in any column are ignored.
    """
    e = entries.select("list", "kind", F.lower("pattern").alias("pattern"), F.to_date("day").alias("day"), "action").dropna()
    e = e.withColumn("pattern", F.when(F.col("kind") == "url", address_of(F.concat(F.lit("x://"), "pattern"))).otherwise(F.col("pattern")))
    day = e.groupBy("list", "kind", "pattern", "day").agg(F.max("action").alias("action"))
    w = Window.partitionBy("list", "kind", "pattern").orderBy("day")
    turns = day.withColumn("before", F.lag("action").over(w)).where(~F.col("action").eqNullSafe(F.col("before")))
    turns = turns.withColumn("until", F.lead("day").over(w))
    return turns.where("action = 'add'").select("list", "kind", "pattern", F.col("day").alias("since"), "until")


def _keys(host: Column, address: Column, kinds: Column, depths: Column) -> Column:
    """The keys of a capture, of kinds and depths that the list has."""
    labels = F.split(host, r"\.")
    up = F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.array_contains(depths, F.size(labels) - i + 1)),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")),
    )
    own = F.array(
        F.struct(F.lit("host").alias("kind"), host.alias("pattern")), F.struct(F.lit("url").alias("kind"), F.lower(address).alias("pattern"))
    )
    own = F.filter(own, lambda x: F.array_contains(kinds, x["kind"]))
    return F.when(host != "", F.concat(own, up)).otherwise(F.array().cast("array<struct<kind:string,pattern:string>>"))


def evaluate_captures(
    captures: DataFrame, entries: DataFrame, *, page_id: str = "page_id", url: str = "url", fetched_at: str = "fetched_at", lots: int = 16
) -> DataFrame:
    """page_id, url, fetched_at, n_active, rule and blocked for each capture.

    n_active counts the entries active at the fetch time (from the day of the add, up to the day before that of the
    remove). rule is the most specific one, as list:kind:pattern: an address before a host before a domain, the longer
    domain first, an allow before a block. blocked is true if that rule's list is ``block``. A capture without a
    host or a time has no active entries. Repeated rows each keep their row. A table of no captures gives no rows, an empty list none that
    are active; long addresses count whole. Other columns of either table play no part, whatever their names.
    """
    c = captures.select(col(page_id).alias("page_id"), col(url).cast("string").alias("url"), col(fetched_at).cast("timestamp").alias("fetched_at"))
    c = c.groupBy("page_id", "url", "fetched_at").agg(F.count("*").alias("rows"))
    spans = validity_intervals(entries).withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    depth = F.when(F.col("kind") == "domain", F.size(F.split("pattern", r"\.")))
    said = entries.agg(F.struct(F.collect_set("kind").alias("kinds"), F.collect_set(depth).alias("depths"))).scalar()
    keys = _keys(host_of(F.col("url")), address_of(F.col("url")), F.col("said.kinds"), F.col("said.depths"))
    k = c.select("*", said.alias("said")).select("page_id", "url", "fetched_at", F.explode(keys).alias("k"))
    lot = F.pmod(F.xxhash64("page_id", "url", "fetched_at"), F.lit(lots)).cast("int").alias("lot")
    k = k.select("page_id", "url", "fetched_at", "k.kind", "k.pattern", lot)
    active = k.join(spans, ["kind", "pattern", "lot"]).where("to_date(fetched_at) >= since and (until is null or to_date(fetched_at) < until)")
    rank = F.struct(
        F.when(F.col("kind") == "url", 0).when(F.col("kind") == "host", 1).otherwise(2).alias("a"),
        (-F.length("pattern")).alias("b"),
        F.col("list"),
        F.col("pattern"),
    )
    best = active.groupBy("page_id", "url", "fetched_at").agg(F.count("*").alias("n"), F.min(F.struct(rank.alias("r"), "kind", "list", "pattern")).alias("best"))
    same = [F.col(f"c.{x}").eqNullSafe(F.col(f"b.{x}")) for x in ("page_id", "url", "fetched_at")]
    out = c.alias("c").join(best.alias("b"), same[0] & same[1] & same[2], "left")
    return out.select(
        "c.page_id",
        "c.url",
        "c.fetched_at",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_active"),
        F.concat_ws(":", "best.list", "best.kind", "best.pattern").alias("rule"),
        F.coalesce(F.col("best.list") == "block", F.lit(False)).alias("blocked"),
        F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("copy"),
    ).drop("copy")
