"""Canonical addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that never identify a document.
TRACKING = r"(?i)^(utm_\w+|fbclid|gclid|gbraid|wbraid|msclkid|mc_[ce]id|igshid|ref|ref_src|referrer|source|cmpid|ncid|smid|partner|at_medium|at_campaign|guccounter|guce_\w+|__twitter_impression|amp|spm|share|sh)$"
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def canonical_url(url: Column) -> Column:
    """One key for one document: https, small host without www and default port, no AMP suffix, fragment, path parameters, tracking or blank parameters; the rest sorted.

    Null and blank become empty; what isn't an absolute address stays as it is.
    """
    url = F.trim(F.coalesce(url, F.lit("")))
    part = lambda i: F.regexp_extract(url, PARTS, i)
    scheme = F.when(F.lower(part(1)).isin("http", "https"), "https").otherwise(F.lower(part(1)))
    host = F.regexp_replace(F.regexp_replace(F.lower(part(2)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(part(3), r";[^/]*$", ""), r"(?i)/amp/?$|\.amp$|/amp\.html$", "")
    path = F.when(path == "", "/").when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    pairs = F.filter(F.split(part(4), "&"), lambda p: p.rlike("^[^=]+=.+") & ~F.regexp_extract(p, "^([^=]*)=", 1).rlike(TRACKING))
    rows = F.array_sort(F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, "^([^=]*)=", 1).alias("k"), F.regexp_extract(p, "^[^=]*=(.*)$", 1).alias("v"))))
    query = F.array_join(F.transform(rows, lambda r: F.concat(r["k"], F.lit("="), r["v"])), "&")
    whole = F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.rlike(PARTS), whole).otherwise(url)
