"""URL resolution, parts and group names as Column expressions.

Everything stays in generated code: no Python runs per row. Covered of the URL
standard: stripping of outer white space and inner tabs and line feeds, lower
case of scheme and host, default ports, relative references of all kinds, dot
segments, back slashes as slashes, and percent-encoding by component. Host names
beyond ASCII are kept as they are. A special URL without a host gives NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPECIAL = ("http", "https", "ws", "wss", "ftp", "file")
#: Schemes that a link may have without counting as unusual (fixed values).
RECOGNISED = ("mailto", "file", "tel", "javascript")
#: Extensions that mark a response as a file (fixed values).
FILE_TYPES = ("jpeg", "jpg", "png", "gif", "pdf", "xml", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "csv")
UNSAFE_PATH = r'[^\x21-\x7E]|["#<>?`{}^]'
UNSAFE_QUERY = r"""[^\x21-\x7E]|["#<>']"""
UNSAFE_FRAGMENT = r'[^\x21-\x7E]|["<>`]'
UNSAFE_OPAQUE = r"[^\x20-\x7E]"


def percent_encoded(text: Column, unsafe: str) -> Column:
    """Characters that match `unsafe` as percent-encoded UTF-8."""
    each = F.transform(
        F.split(text, ""),
        lambda c: F.when(c.rlike(unsafe), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c),
    )
    return F.when(text.rlike(unsafe), F.array_join(each, "")).otherwise(text)


def scheme_of(url: Column) -> Column:
    """Lower-case scheme without its colon, or NULL."""
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)))


def without_dots(path: Column) -> Column:
    """Path with dot segments removed; starts with a slash."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    dot, dots = r"(?i)^(?:\.|%2e)$", r"(?i)^(?:\.|%2e){2}$"
    empty = F.expr("cast(array() as array<string>)")
    walked = F.aggregate(
        segments,
        empty,
        lambda acc, s: F.when(s.rlike(dots), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s.rlike(dot), acc).otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(path.rlike(r"(?i)/(?:\.|%2e){1,2}$"), F.lit("/")).otherwise("")
    joined = F.concat(F.lit("/"), F.array_join(walked, "/"), tail)
    return F.when(path.rlike(r"(?i)(?:^|/)(?:\.|%2e){1,2}(?:/|$)"), F.regexp_replace(joined, "^//$", "/")).otherwise(path)


@dataclass(frozen=True)
class Parts:
    """Component columns of a resolved URL."""

    scheme: Column
    host: Column
    port: Column
    path: Column
    search: Column
    hash: Column

    @property
    def origin(self) -> Column:
        port = F.when(self.port == "", F.lit("")).otherwise(F.concat(F.lit(":"), self.port))
        return F.when(self.scheme.isin("http", "https", "ws", "wss", "ftp"), F.concat(self.scheme, F.lit("://"), self.host, port)).otherwise("null")


def parts(url: Column) -> Parts:
    """Components of an already resolved URL."""
    scheme = scheme_of(url)
    layered = url.rlike(r"^[a-z][a-z0-9+.-]*://")
    authority = F.when(layered, F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)).otherwise("")
    host = F.lower(F.regexp_extract(authority, r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))
    path = F.when(layered, F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)).otherwise(F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*:([^?#]*)", 1))
    mark = F.regexp_extract(url, r"^[^#]*#(.+)$", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]+)", 1)
    return Parts(
        scheme, host, F.regexp_extract(authority, r":([0-9]+)$", 1), path,
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)), F.when(mark == "", "").otherwise(F.concat(F.lit("#"), mark)),
    )


def with_resolved(df: DataFrame, ref: Column, base: Column, out: str) -> DataFrame:
    """Adds the absolute form of a reference found in the document at `base`;
    NULL for a NULL reference or one that has no absolute form.

    The steps are columns: each is used several times by the next, and one
    expression for all of it would grow with every use."""
    df = df.withColumns({"_ref": ref, "_base": base})
    df = df.withColumn("_clean", F.regexp_replace(F.regexp_replace("_ref", r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", ""))
    slashed = F.concat(F.translate(F.regexp_extract("_clean", r"^[^?#]*", 0), "\\", "/"), F.regexp_extract("_clean", r"^[^?#]*(.*)$", 1))
    b_path = F.regexp_extract("_base", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    df = df.withColumns({
        "_own": scheme_of(F.col("_clean")),
        "_ahead": F.when(F.col("_clean").rlike(r"^[^?#]*\\"), slashed).otherwise(F.col("_clean")),
        "_top": F.regexp_extract("_base", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1),
        "_dir": F.when(b_path == "", "/").otherwise(b_path),
    })
    ahead, top = F.col("_ahead"), F.col("_top")
    relative = (
        F.when(ahead.startswith("//"), F.concat(scheme_of(F.col("_base")), F.lit(":"), ahead))
        .when(ahead.startswith("/"), F.concat(top, ahead))
        .when(ahead.startswith("?"), F.concat(top, F.col("_dir"), ahead))
        .when(ahead.startswith("#") | (ahead == ""), F.concat(F.regexp_extract("_base", r"^[^#]*", 0), ahead))
        .otherwise(F.concat(top, F.regexp_replace("_dir", r"[^/]*$", ""), ahead))
    )
    fixed = F.regexp_replace(ahead, r"^([A-Za-z][A-Za-z0-9+.-]*):/*", "$1://")
    web = F.col("_own").isin(*SPECIAL) & (F.col("_own") != "file")
    df = df.withColumn("_whole", F.when(F.col("_own").isNull(), relative).when(web, fixed).otherwise(F.col("_clean")))
    return with_normalised(df, F.col("_whole"), out).drop("_ref", "_base", "_clean", "_own", "_ahead", "_top", "_dir", "_whole")


def with_normalised(df: DataFrame, url: Column, out: str) -> DataFrame:
    """Adds the serialised form of an absolute URL, in steps like the above."""
    df = df.withColumn("_url", url)
    rest = F.regexp_replace("_url", r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    df = df.withColumns({"_scheme": scheme_of(F.col("_url")), "_rest": rest})
    path = F.regexp_extract("_rest", r"^//[^/?#]*([^?#]*)", 1)
    df = df.withColumns({
        "_authority": F.regexp_extract("_rest", r"^//([^/?#]*)", 1),
        "_path": F.when(path == "", "/").otherwise(path),
        "_search": F.regexp_extract("_rest", r"^//[^?#]*(\?[^#]*)?", 1),
        "_mark": F.when(F.col("_rest").contains("#"), F.regexp_extract("_rest", r"^[^#]*(#.*)$", 1)).otherwise(""),
    })
    df = df.withColumns({
        "_user": F.regexp_extract("_authority", r"^(.*@)?", 1),
        "_host": F.lower(F.regexp_extract("_authority", r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1)),
        "_port": F.regexp_extract("_authority", r":([0-9]+)$", 1),
        "_flat": without_dots(F.col("_path")),
    })
    default = F.concat_ws(":", "_scheme", "_port").isin("http:80", "https:443", "ws:80", "wss:443", "ftp:21") | (F.col("_port") == "")
    layered = F.concat(
        F.col("_scheme"), F.lit("://"), F.col("_user"), F.col("_host"), F.when(default, "").otherwise(F.concat(F.lit(":"), F.col("_port"))),
        percent_encoded(F.col("_flat"), UNSAFE_PATH), percent_encoded(F.col("_search"), UNSAFE_QUERY), percent_encoded(F.col("_mark"), UNSAFE_FRAGMENT),
    )
    opaque = F.concat(F.col("_scheme"), F.lit(":"), percent_encoded(F.col("_rest"), UNSAFE_OPAQUE))
    web = F.col("_scheme").isin(*SPECIAL) & (F.col("_scheme") != "file")
    full = F.when(web, F.when(F.col("_host") != "", layered)).when((F.col("_scheme") == "file") & F.col("_rest").startswith("//"), layered).otherwise(opaque)
    return df.withColumn(out, full).drop("_url", "_scheme", "_rest", "_authority", "_path", "_search", "_mark", "_user", "_host", "_port", "_flat")


#: Columns that with_parts adds.
PART_COLUMNS = ("url_scheme", "url_host", "url_port", "url_path", "url_search", "url_hash", "url_origin")


def with_parts(df: DataFrame, url: str) -> DataFrame:
    """Adds the components of a resolved URL column, and its origin."""
    p = parts(F.col(url))
    df = df.withColumns(dict(zip(PART_COLUMNS, (p.scheme, p.host, p.port, p.path, p.search, p.hash))))
    return df.withColumn("url_origin", stored_parts().origin)


def stored_parts() -> Parts:
    """The components that with_parts has added."""
    return Parts(*[F.col(c) for c in PART_COLUMNS[:6]])


def without_fragment(url: Column) -> Column:
    """origin + path + query of a resolved URL ('null' + path for opaque ones);
    the empty string stays empty."""
    p = parts(url)
    return F.when(url == "", "").otherwise(F.concat(p.origin, p.path, p.search))


def extension(url: Column) -> Column:
    """Lower-case text after the last dot of the whole URL, NULL without a dot."""
    return F.when(url.contains("."), F.lower(F.substring_index(url, ".", -1)))


def is_file(url: Column) -> Column:
    return F.coalesce(extension(url).isin(*FILE_TYPES), F.lit(False))


def banned(url: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words occurs, ignoring case."""
    found = F.lit(False)
    for w in words:
        found = found | F.lower(url).contains(w.lower())
    return F.coalesce(found, F.lit(False))


def tokens(url: Column) -> Column:
    """struct(scheme, authority, path, query, fragment) of a raw URL string.

    NULL without a colon or with a slash before the first one. A part that is
    absent is NULL; an authority may be empty; a path has no leading slash after
    an authority and is absent if nothing follows the authority."""
    valid = url.rlike(r"^[^/:]*:")
    has_authority = url.rlike(r"^[^:]*://")
    authority = F.regexp_extract(url, r"^[^:]*://([^/?#]*)", 1)
    after = F.when(has_authority, F.regexp_extract(url, r"^[^:]*://[^/?#]*((?s:.*))$", 1)).otherwise(F.regexp_extract(url, r"^[^:]*:((?s:.*))$", 1))
    path = F.regexp_extract(after, r"^/?([^?#]*)", 1)
    plain = F.regexp_extract(after, r"^([^?#]*)", 1)
    path_there = F.when(has_authority, after.startswith("/")).otherwise((plain != "") | (after == ""))
    return F.when(
        valid,
        F.struct(
            F.regexp_extract(url, r"^([^:]*):", 1).alias("scheme"),
            F.when(has_authority, authority).alias("authority"),
            F.when(path_there, F.when(has_authority, path).otherwise(plain)).alias("path"),
            F.when(after.rlike(r"^[^#]*\?"), F.regexp_extract(after, r"^[^?#]*\?([^#]*)", 1)).alias("query"),
            F.when(after.contains("#"), F.regexp_extract(after, r"^[^#]*#((?s:.*))$", 1)).alias("fragment"),
        ),
    )
