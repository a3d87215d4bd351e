"""URL columns: all are built-in expressions and work on strings that are no valid URLs, too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_url(url: Column) -> Column:
    """Trimmed, with https:// in front unless it has a web scheme; '' stays ''."""
    url = F.trim(url)
    return F.when((url == "") | url.rlike("(?i)^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def valid_url(url: Column) -> Column:
    return url.rlike(r"(?i)^https?://[^/?#\s]+")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def compare_key(url: Column) -> Column:
    """Key of "the same page": lower scheme and host, one trailing slash dropped, no fragment, query kept."""
    full = normalize_url(url)
    p = F.when(path(full) == "", "/").otherwise(path(full))
    p = F.when((p != "/") & p.endswith("/"), p.substr(F.lit(1), F.length(p) - 1)).otherwise(p)
    q = query(full)
    return F.concat(scheme(full), F.lit("://"), host(full), p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def site_keys(url: Column) -> dict[str, Column]:
    """origin, host, bare_host, section (first path segment, or /) and depth."""
    h, parts = host(url), segments(url)
    return {
        "origin": F.concat(scheme(url), F.lit("://"), h),
        "host": h,
        "bare_host": F.regexp_replace(h, r"^www\.", ""),
        "section": F.coalesce(F.get(parts, 0), F.lit("/")),
        "depth": F.size(parts),
    }


def depth_level(url: Column) -> Column:
    n = F.size(segments(url))
    return F.when(n <= 1, "level1").when(n == 2, "level2").otherwise("level3plus")


def path_and_query(url: Column) -> Column:
    p, q = path(url), query(url)
    return F.concat(F.when(p == "", "/").otherwise(p), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def parents(domain: Column) -> Column:
    """The domain and all its parent suffixes, longest first: a.b.c, b.c, c."""
    parts = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


#: RFC 3986, appendix B: scheme, authority with its slashes, path, query with its mark, fragment with its mark.
_REFERENCE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def remove_dots(path: Column) -> Column:
    """A path without . and .. segments, by a fold over its segments with the ones so far as a stack."""
    parts = F.split(path, "/")
    step = lambda out, x: F.when(x == ".", out).when(x == "..", F.when(F.size(out) > 1, F.slice(out, 1, F.size(out) - 1)).otherwise(out)).otherwise(F.concat(out, F.array(x)))
    folded = F.aggregate(parts, F.array().cast("array<string>"), step)
    ends = F.when(path.rlike(r"(?:^|/)\.\.?$"), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.array_join(ends, "/")).otherwise(path)


def resolve(base: Column, reference: Column) -> Column:
    """A reference made absolute (RFC 3986, 5.2); null if neither it nor the base has a scheme, or has one but no host.

    A reference with a scheme of its own and no host, as mailto: and the like, stays as it is.

    White space around it and line ends within it are dropped, as browsers do.
    """
    href = F.regexp_replace(F.trim(F.regexp_replace(reference, r"[\t\r\n]", "")), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    b, r = ([F.regexp_extract(c, _REFERENCE, i) for i in range(1, 6)] for c in (base, href))
    merged = F.when((b[1] != "") & (b[2] == ""), F.concat(F.lit("/"), r[2])).otherwise(F.concat(F.regexp_extract(b[2], r"(?s)^(.*/)", 1), r[2]))
    own = (r[0] != "") | (r[1] != "")
    path_ = F.when(own | r[2].startswith("/"), remove_dots(r[2])).when(r[2] == "", b[2]).otherwise(remove_dots(merged))
    query_ = F.when(own | (r[2] != "") | (r[3] != ""), r[3]).otherwise(b[3])
    scheme_ = F.lower(F.when(r[0] != "", r[0]).otherwise(b[0]))
    full = F.concat(scheme_, F.lit(":"), F.when(own, r[1]).otherwise(b[1]), path_, query_, r[4])
    whole = F.concat(F.lower(r[0]), F.lit(":"), r[2], r[3], r[4])
    return F.when((r[0] != "") & (r[1] == ""), whole).when((scheme_ != "") & F.when(own, r[1]).otherwise(b[1]).rlike("^//[^/]"), full)
