"""URL filters by a temporal list join, in DataFrame functions only.

A list's entries are dated: from a date on an entry is listed, or no longer.  The
events of an entry become validity intervals (each lasts until the entry's next
event), and every capture is held against the entries that were active when it was
fetched.  An entry names a host suffix, so a host is looked up under itself and
each of its parent domains.

Hosts are looked up once each: the distinct hosts' suffixes, as many labels long as
some entry is, are held against the entries, and only captures of a host that has any
go on.  The as-of join is an equi-join on (entry, month) with the interval as a
residual: intervals are entered under every month they touch, so even a host that a
third of all captures share is spread over the months it was fetched in, and skewed
months can be split.  Tables are broadcast only after a count has shown them small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, col, cut_lineage, small_side, unboxed

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url_col: str = "url"):
    """Lower-case host of a URL, without user, port or trailing dot; null if there is none."""
    host = F.rtrim(F.lower(F.regexp_extract(col(url_col), HOST, 1)), F.lit("."))
    return F.when(host == "", F.lit(None)).otherwise(host)


def suffixes(host: str = "host") -> str:
    """SQL of the array of a host and its parent domains down to one label."""
    return f"transform(array(split({host}, '[.]')), p -> transform(sequence(1, size(p)), i -> array_join(slice(p, i, size(p)), '.')))[0]"


def validity_intervals(events: DataFrame) -> DataFrame:
    """(entry, category, valid_from, valid_to): the times during which entries are listed.

    ``events``: entry, category, listed (boolean), at (date).  Of several events of
    an entry and category on one date a listing wins; nulls in entry, listed or at
    drop the event.  An open interval ends at null.
    """
    known = events.where("entry is not null and listed is not null and at is not null")
    daily = known.groupBy(F.lower("entry").alias("entry"), "category", "at").agg(F.max("listed").alias("listed"))
    after = F.lead("at").over(Window.partitionBy("entry", "category").orderBy("at"))
    spans = daily.select("entry", "category", "listed", F.col("at").alias("valid_from"), after.alias("valid_to"))
    return spans.where("listed").drop("listed")


#: What the filter adds to a capture.
VERDICT = ("blocked", "n_active", "entries", "categories")


def listed_suffixes(hosts: DataFrame, entries: DataFrame) -> DataFrame:
    """(host, entry): the ``entries`` (entry) that are a host of ``hosts`` (host) or one of its parent domains."""
    lengths = [r["n"] for r in entries.select(F.size(F.split("entry", "[.]")).alias("n")).distinct().collect()]  # a few numbers
    wanted = F.filter(F.expr(suffixes()), lambda x: F.size(F.split(x, "[.]")).isin(lengths))
    return hosts.distinct().select("host", F.explode(wanted).alias("entry")).join(small_side(entries), "entry", "left_semi")


def active_entries(captures: DataFrame, events: DataFrame) -> DataFrame:
    """One row for each of ``captures`` (k, url, at) and entry that was active at its date; an entry's last day is the day before its end."""
    spans = cut_lineage(validity_intervals(events))
    horizon = captures.agg(F.max("at").alias("hi"), F.min("at").alias("lo")).first()
    if horizon["hi"] is None:
        spans, lo, hi = spans.where(F.lit(False)), F.current_date(), F.current_date()
    else:
        lo, hi = F.lit(horizon["lo"]), F.lit(horizon["hi"])
    first, end = F.greatest("valid_from", lo), F.least(F.coalesce("valid_to", F.date_add(hi, 1)), F.date_add(hi, 1))
    touched = spans.select("*", first.alias("a"), F.date_sub(end, 1).alias("b")).where("a <= b")
    months = F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))
    entered = touched.select("entry", "category", "valid_from", "valid_to", F.explode(months).alias("month"))
    looked = captures.select("*", host_of("url").alias("host")).where("host is not null and at is not null")
    named = cut_lineage(listed_suffixes(looked.select("host"), touched.select("entry").distinct()))
    met = looked.join(small_side(named), "host").withColumn("month", F.trunc("at", "month")).join(entered, ["entry", "month"])
    return met.where("valid_from <= at and (valid_to is null or at < valid_to)").drop("month")


def filter_captures(captures: DataFrame, events: DataFrame, key_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """Every capture with ``blocked``, ``n_active``, ``entries`` (distinct, sorted, comma-joined) and ``categories``.

    Captures are matched by (key, URL, date); equal ones decide alike.  Captures
    without a URL, host or time, and captures that meet no entry, are not blocked.
    Input columns of the added names are replaced, all others pass through.
    """
    own = [c for c in captures.columns if c not in VERDICT]
    keyed = captures.select(boxed(captures, own), col(key_col).alias("k"), col(url_col).alias("url"), col(time_col).cast("date").alias("at"))
    met = active_entries(keyed.select("k", "url", "at").distinct(), events)
    each = met.groupBy("k", "url", "at").agg(
        F.count("*").alias("n_active"),
        F.array_join(F.array_sort(F.collect_set("entry")), ",").alias("entries"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
    )
    left, right = keyed.alias("c"), each.alias("e")
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"e.{c}")) for c in ("k", "url", "at")]
    joined = left.join(right, same[0] & same[1] & same[2], "left").select("row", "n_active", "entries", "categories")
    return joined.select(
        *unboxed(own),
        F.col("n_active").isNotNull().alias("blocked"),
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("entries", F.lit("")).alias("entries"),
        F.coalesce("categories", F.lit("")).alias("categories"),
    )
