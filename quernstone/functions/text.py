"""Text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` computed once a row; a column named in a lambda is computed again for each element."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def tokenize(c: Column) -> Column:
    """TX01. Lower-case ASCII words; camelCase and acronym borders separate."""
    c = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")
    c = F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != "")


#: The same in DuckDB SQL; ``{c}`` is the text.
TOKENIZE_SQL = r"list_filter(string_split_regex(lower(regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda t: t <> '')"


def search_terms(c: Column, longest: int = 4) -> Column:
    """TX02. Sorted different words, and joins of up to ``longest`` neighbouring words."""
    words = tokenize(c)
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), ""))))
    return F.array_sort(F.array_distinct(F.filter(spans, lambda t: t != "")))


def fts_text(c: Column) -> Column:
    """TX03."""
    return F.array_join(search_terms(c), " ")


def stem(t: Column) -> Column:
    """TX31. Endings -ies, -ing, -es after a sibilant, and -s."""
    n, cut = F.length(t), lambda k: F.substring(t, F.lit(1), F.length(t) - k)
    return (
        F.when((n > 4) & t.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 5) & t.endswith("ing"), cut(3))
        .when((n > 4) & t.rlike("(ss|x|z|ch|sh)es$"), cut(2))
        .when((n > 3) & t.endswith("s") & ~t.endswith("ss"), cut(1))
        .otherwise(t)
    )


STEM_SQL = "CASE WHEN length({t}) > 4 AND {t} LIKE '%ies' THEN left({t}, length({t}) - 3) || 'y' WHEN length({t}) > 5 AND {t} LIKE '%ing' THEN left({t}, length({t}) - 3) WHEN length({t}) > 4 AND regexp_matches({t}, '(ss|x|z|ch|sh)es$') THEN left({t}, length({t}) - 2) WHEN length({t}) > 3 AND {t} LIKE '%s' AND {t} NOT LIKE '%ss' THEN left({t}, length({t}) - 1) ELSE {t} END"


def estimate_tokens(c: Column) -> Column:
    """TX33."""
    return F.ceil(F.length(c) / CHARS_PER_TOKEN).cast("long")


def normalize_path(c: Column) -> Column:
    """TX35. Forward slashes, no leading ./"""
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^(\\./)+", "")


def normalize_query(c: Column) -> Column:
    """TX36. Lower-case letters and digits of any script, single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", " "))


def directory(c: Column) -> Column:
    return F.regexp_extract(c, "^(.*)/[^/]*$", 1)


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def suffix_boundary(a: Column, b: Column) -> Column:
    """TX38. One path equals the other or ends with it at a segment border."""
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


def proximity(a: Column, b: Column) -> Column:
    """TX39. 2 in one directory, 1 for ancestors and siblings, else null."""
    x, y = directory(a), directory(b)
    slash = F.lit("/")
    return (
        F.when(x == y, 2)
        .when((x != "") & (y != "") & (x.startswith(F.concat(y, slash)) | y.startswith(F.concat(x, slash))), 1)
        .when((directory(x) != "") & (directory(x) == directory(y)), 1)
    )


def clip_bytes(c: Column, most: int) -> Column:
    """TX41. The longest prefix of whole characters in at most ``most`` UTF-8 bytes."""
    raw = F.substring(F.encode(c, "UTF-8"), 1, most)
    cut = F.regexp_replace(F.hex(raw), "(F[0-7]([89AB][0-9A-F]){0,2}|E[0-9A-F]([89AB][0-9A-F])?|[CD][0-9A-F])$", "")
    aligned = F.when(F.length(cut) % 2 == 0, cut).otherwise(F.hex(raw))
    return F.when(F.octet_length(c) <= most, c).otherwise(F.decode(F.unhex(aligned), "UTF-8"))


def shared_stem(a: Column, b: Column, least: int = 5) -> Column:
    """Equal words, or such as share a prefix of ``least`` letters and all but three of the shorter."""
    n = F.least(F.length(a), F.length(b))
    k = F.greatest(F.lit(least), n - 3)
    return (a == b) | ((n >= least) & (F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k)))


def half_up(c: Column, digits: int = 4) -> Column:
    """Rounds halves toward positive infinity."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale
