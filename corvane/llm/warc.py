"""Not-modified revisit records: an as-of join to the latest earlier full response of the same URL.

A revisit (304) carries headers and validators but no body. It refers to the latest response before
it (by time, then record id) whose canonical URL is the same. Its validators are checked against that
response: entity tags compare weakly, the modification time counts where a tag is missing. Headers
that a 304 may update are merged over the stored ones.

The join is split by time: within a block of time a window finds the response; the last response of
each block is carried to later blocks. So a URL with a third of all captures is as many groups as its
captures span blocks, and rows carry no bodies.

A null URL is a URL of its own; null times come before all. Equal rows are separate captures. A
revisit without an earlier response, with other validators, or with none to compare is returned with
that status and its own headers. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_SECONDS = 6 * 3600
# Header fields that a 304 response never updates.
NOT_UPDATED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)
# Query parameters that only track the visitor.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)=|^$"


def canonical_url(url: Column) -> Column:
    """Host without case, www and default port, path without a closing slash, sorted parameters
    without tracking; scheme and fragment go."""
    bare = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www[0-9]*\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(query, lambda p: ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def merged_headers(stored: Column, new: Column) -> Column:
    """Stored headers updated by those of a 304 that may be."""
    new = F.map_filter(new, lambda k, _: ~F.lower(k).isin(*NOT_UPDATED))
    names = F.transform(F.map_keys(new), lambda k: F.lower(k))
    kept = F.map_filter(stored, lambda k, _: ~F.array_contains(names, F.lower(k)))
    return F.map_concat(kept, new)


def resolve_revisits(captures: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """(record_id, canonical_url, ts, refers_to, status, headers) of every revisit.

    ``captures``: record_id, url, ts (seconds), kind ('response' or 'revisit'), etag, last_modified,
    headers (map). Status: resolved, changed, unchecked (nothing to compare) or missing.
    """
    rows = captures.select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", "etag", "last_modified",
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
        (F.col("kind") == "response").alias("full"),
        F.expr(f"coalesce(ts div {block_seconds}, -9223372036854775808)").alias("block"),
    )
    stored = F.when(F.col("full"), F.struct("record_id", "ts", "etag", "last_modified", "headers"))
    rows = rows.withColumn("stored", stored)
    # At one time revisits stand before responses: a response at the same time is not earlier.
    order = Window.partitionBy("canonical_url", "block").orderBy("ts", "full", "record_id")
    near = rows.withColumn("near", F.last("stored", ignorenulls=True).over(order)).where("not full")
    last = rows.groupBy("canonical_url", "block").agg(
        F.max_by("stored", F.when(F.col("full"), F.struct("ts", "record_id"))).alias("last")
    )
    ahead = Window.partitionBy("canonical_url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("canonical_url", "block", F.last("last", ignorenulls=True).over(ahead).alias("carried"))
    joined = near.join(carried, ["canonical_url", "block"]).withColumn("base", F.coalesce("near", "carried"))
    tag = lambda c: F.regexp_replace(c, "^W/", "")
    same_tag = tag(F.col("etag")) == tag(F.col("base.etag"))
    same_time = F.col("last_modified") == F.col("base.last_modified")
    same = F.coalesce(same_tag, same_time)
    status = (
        F.when(F.col("base").isNull(), "missing").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("changed")
    )
    out = joined.withColumn("status", status)
    headers = F.when(F.col("status") == "resolved", merged_headers(F.col("base.headers"), F.col("headers"))).otherwise(F.col("headers"))
    return out.select(
        "record_id", "canonical_url", "ts",
        F.when(F.col("status") == "resolved", F.col("base.record_id")).alias("refers_to"), "status", headers.alias("headers"),
    )


def header_text(headers: Column) -> Column:
    """Headers as sorted lines."""
    lines = F.transform(F.map_entries(headers), lambda e: F.concat(F.lower(e["key"]), F.lit(": "), e["value"]))
    return F.array_join(F.array_sort(lines), "\n")
