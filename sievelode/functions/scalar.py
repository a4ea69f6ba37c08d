"""Column functions: each takes and gives a Column, built from Spark's own functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: severity scale and weights ----
SEVERITY_WEIGHTS = (("critical", 20), ("major", 10), ("minor", 3), ("info", 1))
UNKNOWN_WEIGHT = 5
TIERS = (("critical", "P0"), ("major", "P1"), ("minor", "P2"), ("info", "P2"))


def clean_severity(severity: Column) -> Column:
    """Letters in lower case; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(severity), "[^a-z]", ""), F.lit(""))


def severity_weight(severity: Column) -> Column:
    """Points that a finding costs; unknown and missing severities cost ``UNKNOWN_WEIGHT``."""
    clean = clean_severity(severity)
    out = F.lit(UNKNOWN_WEIGHT)
    for name, weight in reversed(SEVERITY_WEIGHTS):
        out = F.when(clean == name, weight).otherwise(out)
    return out


def tier(severity: Column) -> Column:
    """P0 for critical, P1 for major, P2 for everything else."""
    clean = clean_severity(severity)
    out = F.lit("P2")
    for name, label in reversed(TIERS):
        out = F.when(clean == name, label).otherwise(out)
    return out


def version_key(version: Column) -> Column:
    """The first three numbers of a version as an array, missing ones 0; arrays compare in order. Null stays null."""
    numbers = F.regexp_extract_all(version, F.lit(r"\d+"), 0)
    padded = F.slice(F.concat(numbers, F.array(*[F.lit("0")] * 3)), 1, 3)
    return F.when(version.isNotNull(), F.transform(padded, lambda x: x.cast("int")))


def normal_path(path: Column) -> Column:
    """Forward slashes, no drive letter, no doubled slashes, no leading or inner ``./``."""
    slashes = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^[A-Za-z]:", "")
    single = F.regexp_replace(F.regexp_replace(slashes, r"/+", "/"), r"(^|/)(\./)+", "$1")
    return F.regexp_replace(single, r"^/", "")


def token_estimate(text: Column) -> Column:
    """A quarter of the ASCII characters plus all others, at least 1; 0 for empty texts, null for null."""
    others = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    ascii_only = F.length(text) - others
    return F.when(text.isNull(), None).when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(ascii_only / 4).cast("int") + others))


def slug(text: Column, size: int = 24) -> Column:
    """Lower-case letters and digits with single hyphens, at most ``size`` characters."""
    return F.substring(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), 1, size)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once; a column used inside a lambda would be worked out for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def softmax(vector: Column) -> Column:
    """Softmax of an array, shifted by its greatest element."""
    shifted = _let(F.array_max(vector).cast("double"), lambda top: F.transform(vector, lambda x: F.exp(x.cast("double") - top)))
    return _let(shifted, lambda e: _let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total)))


def search_terms(text: Column) -> Column:
    """Search terms: words of ASCII letters, digits and underscores in lower case, Han letters, and neighbouring Han pairs."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), 0)
    han = F.regexp_extract_all(low, F.lit(r"[\x{4e00}-\x{9fff}]"), 0)
    both = lambda h: F.when(F.size(h) > 1, F.concat(h, F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h) - 1), lambda a, b: F.concat(a, b)))).otherwise(h)
    return F.when(text.isNotNull(), F.concat(words, _let(han, both)))


def keywords(text: Column, limit: int = 12) -> Column:
    """The first distinct of: runs of two or more Han letters, the pairs within them, words of three or more Latin letters in lower case."""
    runs = F.regexp_extract_all(text, F.lit(r"[\x{4e00}-\x{9fff}]{2,}"), 0)
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]{3,}"), 0)
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))
    found = _let(runs, lambda h: F.concat(h, F.flatten(F.transform(h, pairs))))
    return F.slice(F.array_distinct(F.concat(found, words)), 1, limit)
