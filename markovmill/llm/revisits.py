"""Web archive records: not-modified revisits resolved to the latest earlier full response of their canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

# Fields of a stored response that a 304 must not change (RFC 9111, section 3.2, and those of one connection alone)
KEPT_FIELDS = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade"]
#: Query parameters that say where a reader came from, not what is shown.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid|phpsessid|jsessionid)(=|$)"
#: Stretches of time by which a URL's records are dealt out.
STRETCHES = 256


def canonical_url(url: Column) -> Column:
    """Host in lower case without user, default port, www. and m., path without index page, .html and closing slashes, the query's other
    parameters sorted; no scheme and no fragment. Null where there is no scheme or host."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?:@]*)", 1)), r"^(www[0-9]*|m)\.", "")
    port = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?[^/?:@]*(:[0-9]+)", 1)
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), r"(/index)?\.html?$", ""), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))), "&")
    whole = F.concat(host, F.when(port.isin(":80", ":443"), "").otherwise(port), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host != "", whole)


def merge_headers(stored: Column, fresh: Column) -> Column:
    """The stored fields, renewed by those of the 304 that may change. Names are compared in lower case; the last of several counts."""

    def lowered(m: Column) -> Column:
        entries = F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>")))
        return F.map_from_entries(F.transform(F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"]))), lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == k), -1)["value"].alias("value"))))

    old = lowered(stored)
    new = F.map_filter(lowered(fresh), lambda k, _: ~k.isin(KEPT_FIELDS))
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False))), new)


def _opaque(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(record_id, canonical_url, outcome, resolved_id, headers) for each record of kind "revisit".

    records: record_id of any type that has an order, url string, kind string ("response" or "revisit"), at long, etag string, last_modified string, digest string
    (of the payload), headers map<string,string>. Full responses are those of kind "response"; other kinds are neither.

    outcome: "resolved"; "no_url" (null or not to be read); "no_response" (none is earlier); "no_validator" (the two share none);
    "changed" (the first validator that both have, of etag by weak comparison, last_modified and digest, differs). resolved_id is the
    response of the same canonical URL with the latest time before the revisit's (of equal times, the greatest id), for "resolved" and
    "changed"; headers are merged where it is resolved, else the revisit's own. Null times come before all. Repeated rows: a row each. No
    rows: no rows. Other columns aren't read; payloads are never moved, as the result names the record that has it.

    The join goes by (URL, stretch of time): within a stretch by a window, across them by the last response of each, of which a URL has at
    most STRETCHES. A URL with a third of all records so is many tasks.
    """
    at = F.coalesce("at", F.lit(-(2**63)))
    kept = ["record_id", "kind", "url_", "at_", "etag", "last_modified", "digest", "headers"]
    rows = records.where(F.col("kind").isin("response", "revisit")).withColumn("url_", canonical_url(F.col("url"))).withColumn("at_", at).select(kept)
    rows = cut(rows)
    splits = sorted(set(rows.approxQuantile("at_", [i / STRETCHES for i in range(1, STRETCHES)], 0.002))) if rows.take(1) else []
    stretch = F.lit(0)
    if splits:
        stretch = F.size(F.filter(F.lit([float(s) for s in splits]), lambda s: s <= F.col("at_").cast("double")))
    rows = rows.withColumn("stretch", stretch)
    full = F.when((F.col("kind") == "response") & F.col("url_").isNotNull(), F.struct("at_", "record_id", "etag", "last_modified", "digest", "headers"))
    named = rows.where("url_ is not null").withColumn("full", full)
    here = Window.partitionBy("url_", "stretch").orderBy("at_", F.when(F.col("kind") == "revisit", 0).otherwise(1), "record_id").rowsBetween(Window.unboundedPreceding, 0)
    within = named.withColumn("full", F.last("full", ignorenulls=True).over(here)).where("kind = 'revisit'")
    last = named.where("full is not null").groupBy("url_", "stretch").agg(F.max_by("full", F.struct("at_", "record_id")).alias("last"))
    # a stretch's carry: the last response of the stretches before; also for stretches that have revisits alone
    steps = named.select("url_", "stretch").distinct().join(last, ["url_", "stretch"], "left")
    before = Window.partitionBy("url_").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.select("url_", "stretch", F.last("last", ignorenulls=True).over(before).alias("carry"))
    found = within.join(carried, ["url_", "stretch"], "left").withColumn("full", F.coalesce("full", "carry"))
    found = found.unionByName(rows.where("url_ is null and kind = 'revisit'"), allowMissingColumns=True)
    same = F.when(F.col("etag").isNotNull() & F.col("full.etag").isNotNull(), _opaque(F.col("etag")) == _opaque(F.col("full.etag")))
    same = same.when(F.col("last_modified").isNotNull() & F.col("full.last_modified").isNotNull(), F.col("last_modified") == F.col("full.last_modified"))
    same = same.when(F.col("digest").isNotNull() & F.col("full.digest").isNotNull(), F.col("digest") == F.col("full.digest"))
    outcome = F.when(F.col("url_").isNull(), "no_url").when(F.col("full").isNull(), "no_response").when(same.isNull(), "no_validator").when(same, "resolved").otherwise("changed")
    found = found.withColumn("outcome", outcome)
    headers = F.when(F.col("outcome") == "resolved", merge_headers(F.col("full.headers"), F.col("headers"))).otherwise(F.col("headers"))
    return found.select("record_id", F.col("url_").alias("canonical_url"), "outcome", F.when(F.col("outcome").isin("resolved", "changed"), F.col("full.record_id")).alias("resolved_id"), headers.alias("headers"))


def page_records(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Records of a crawl over pages: a full response at the time of its id, and two revisits between the others' responses.

    record_id is a struct of the page's id and the visit: 0 the response, which comes at the time `id`; 1 a revisit right before it, which
    meets what stood at its URL earlier; 2 a revisit 1 to 256 steps later, which meets the response itself or one that has come since. The
    first digits of the payload's md5 say how much later that is, and which validators a page's records carry: an etag, a last-modified
    date, a digest, several of them or none. A page without an id has no time, which comes before all; neither has one so great that it
    has no later time. Repeated rows: records each.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    base = pages.select(F.col(page).cast("long").alias("page"), F.col(url).alias("url"), F.md5(body.cast("binary")).alias("tag"), F.octet_length(body).alias("size"))
    digit = F.instr(F.lit("0123456789abcdef"), F.substring("tag", 1, 1)) - 1
    later = F.instr(F.lit("0123456789abcdef"), F.substring("tag", 2, 1)) + digit * 16
    etag = F.when(digit < 8, F.concat(F.lit('"'), F.col("tag"), F.lit('"')))
    modified = F.when(digit.between(4, 11), F.concat(F.lit("version "), F.substring("tag", 1, 8)))
    digest = F.when(digit.between(8, 13), F.col("tag"))

    def record(visit: int) -> Column:
        day = F.concat(F.lit("visit " if visit else "fetch "), F.col("page").cast("string"))
        fields = [("ETag", etag), ("Last-Modified", modified), ("Date", day), ("Content-Length", F.lit("0") if visit else F.col("size").cast("string"))]
        fields.append(("Cache-Control", F.lit("max-age=60")) if visit else ("Content-Type", F.lit("text/html")))
        headers = F.map_filter(F.create_map(*[x for k, v in fields for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
        kind = F.lit("revisit" if visit else "response").alias("kind")
        at = F.try_add(F.col("page"), later.cast("long")) if visit == 2 else F.col("page")
        return F.struct(F.struct(F.col("page"), F.lit(visit).alias("visit")).alias("record_id"), kind, at.alias("at"), etag.alias("etag"), modified.alias("last_modified"), digest.alias("digest"), headers.alias("headers"))

    return base.select("url", F.explode(F.array(*map(record, range(3)))).alias("r")).select("r.record_id", "url", *[f"r.{c}" for c in ("kind", "at", "etag", "last_modified", "digest", "headers")])
