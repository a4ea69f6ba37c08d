"""Rule scans over texts and their lines."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    name: str
    dimension: str
    severity: str
    pattern: str
    unless: str | None = None


# ---- fixed values: patterns that both Java's and RE2's dialect read alike ----
SECURITY_RULES = (
    Rule("sql-in-string", "injection", "critical", r"(?i)(select|insert|update|delete)\s[^\n]{0,80}(from|into|set)\s[^\n]{0,80}(\+|%s|\{)"),
    Rule("query-literal", "injection", "major", r"\.(query|run|execute)\(['\"](?i:select|insert|update|delete)\s"),
    Rule("shell-call", "injection", "critical", r"os\.system\(|shell\s*=\s*True|Runtime\.getRuntime\(\)\.exec"),
    Rule("eval-call", "injection", "critical", r"\b(eval|exec)\s*\("),
    Rule("plain-http", "network", "minor", r"http://", r"http://(localhost|127\.0\.0\.1)"),
    Rule("url-credentials", "network", "critical", r"[a-z]+://[^/\s:@'\"]+:[^/\s:@'\"]+@"),
    Rule("debug-flag", "config", "major", r"(?i)\bdebug\s*[:=]\s*true\b"),
    Rule("hard-coded-secret", "authn", "critical", r"(?i)(password|passwd|secret|token|api_?key)['\"]?\s*(:\s*str\s*)?[:=]\s*['\"][^'\"\n]{8,}['\"]", r"(?i)(example|changeme|placeholder)"),
    Rule("weak-hash", "crypto", "minor", r"\b(md5|sha1)\s*\("),
    Rule("unsafe-load", "deserialization", "critical", r"pickle\.loads?\(|yaml\.load\(|ObjectInputStream"),
    Rule("env-access", "config", "info", r"os\.environ|process\.env|System\.getenv|os\.Getenv"),
)
SURFACE_RULES = (
    Rule("network", "surface", "info", r"https?://|\bsocket\b|\bfetch\(|\brequests\.|\bhttp\."),
    Rule("file", "surface", "info", r"\bopen\(|\bread_?file|\bwrite_?file|FileInputStream"),
    Rule("database", "surface", "info", r"(?i)\.(query|run|execute)\("),
    Rule("command", "surface", "info", r"\b(system|popen|subprocess|exec|spawn)\b"),
    Rule("environment", "surface", "info", r"os\.environ|process\.env|getenv|os\.Getenv"),
)


def _fires(text: Column, rule: Rule) -> Column:
    hit = text.rlike(rule.pattern)
    return hit & ~text.rlike(rule.unless) if rule.unless else hit


def scan_texts(df: DataFrame, key: str, text: str, rules: tuple[Rule, ...] = SECURITY_RULES) -> DataFrame:
    """One row per key and rule that its text breaks: ``key``, ``rule``, ``dimension``, ``severity``.

    All rules are looked at in one projection over the text; null texts break none. Rows delivered twice count once.
    """
    hits = F.array(*(F.when(_fires(F.col(text), r), F.struct(F.lit(r.name).alias("rule"), F.lit(r.dimension).alias("dimension"), F.lit(r.severity).alias("severity"))) for r in rules))
    return df.select(key, F.explode(F.array_compact(hits)).alias("x")).select(key, "x.*").distinct()


def first_rule(line: Column, rules: tuple[Rule, ...]) -> Column:
    """Name of the first rule, in order, that the line breaks; null for none."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(_fires(line, r), r.name).otherwise(out)
    return out


def scan_lines(df: DataFrame, key: str, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """One row per line that breaks a rule: ``key``, ``line_no``, ``rule``; the first rule in order decides."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return lines.select(key, (F.col("pos") + 1).alias("line_no"), first_rule(F.col("line"), rules).alias("rule")).where("rule is not null").distinct()


def text_shape(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``n_words``, ``longest_line``, ``few_words``, ``long_line``, ``placeholder`` (first of a list that occurs)."""
    low = F.lower(F.col(text))
    words = F.size(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""))
    longest = F.array_max(F.transform(F.split(text, "\n"), lambda x: F.length(x)))
    hint = F.lit(None).cast("string")
    for word in ("fixme", "todo", "lorem ipsum"):
        hint = F.when(F.contains(low, F.lit(word)), word).otherwise(hint)
    return df.where(F.col(text).isNotNull()).select(
        key, words.alias("n_words"), longest.alias("longest_line"), (words < 40).alias("few_words"), (longest > 160).alias("long_line"), hint.alias("placeholder")
    )


#: What marks a text as unfinished (fixed values); the first that occurs is told.
UNFINISHED = ("TODO", "FIXME", "lorem", "placeholder", "示例", "待补充")


def mode_rules(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """``key``, ``mode``, ``issue``: what the modes design (loose, thin), layout (no-media, long-line) and content (unfinished marks) find in each text.

    Loose are more than 30 blank lines, thin fewer than 40 words, long more than 160 characters in a line; pages without
    a media rule are told by their ending, so a null path has none. Null texts give no rows; repeated rows give theirs once.
    """
    body = F.col(text)
    blank = (F.length(body) - F.length(F.replace(body, F.lit("\n\n"), F.lit("")))) / 2
    words = F.size(F.filter(F.split(body, r"\s+"), lambda w: w != ""))
    unfinished = F.coalesce(*(F.when(F.contains(F.lower(body), F.lit(w.lower())), w) for w in UNFINISHED))
    found = (
        ("design", F.when(blank > 30, "loose")), ("design", F.when(words < 40, "thin")),
        ("layout", F.when(F.col(path).endswith(".html") & ~F.contains(body, F.lit("@media")), "no-media")),
        ("layout", F.when(F.exists(F.split(body, "\n"), lambda x: F.length(x) > 160), "long-line")),
        ("content", unfinished),
    )
    issues = F.filter(F.array(*(F.struct(F.lit(mode).alias("mode"), issue.alias("issue")) for mode, issue in found)), lambda x: x["issue"].isNotNull())
    return df.where(body.isNotNull()).select(key, F.explode(issues).alias("x")).select(key, "x.mode", "x.issue").distinct()


#: Comments that only name what a scanner looks for (a fixed value).
RULE_COMMENT = r"(?m)^[ \t]*#[^\n]*(SELECT|INSERT|UPDATE|DELETE|pickle\.loads|yaml\.load|eval|exec|os\.system|cursor\.execute|AKIA|BEGIN \w+ PRIVATE KEY|password)[^\n]*$"


def without_rule_comments(text: Column) -> Column:
    """The text with comment lines emptied that only name what a scanner looks for, so that rules don't find themselves; lines keep their numbers."""
    return F.regexp_replace(text, RULE_COMMENT, "")


def line_estimates(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``n_lines``, ``n_blank``, ``n_comment``, ``n_code``, ``n_branches`` of each text: what a test can cover, by its lines.

    Counted where the text lies; of several deliveries the greatest numbers. Null texts have none.
    """
    lines = F.split(F.regexp_replace(text, "\r", ""), "\n")
    n = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern)))
    rows = df.where(F.col(text).isNotNull()).select(
        key, F.size(lines).alias("n_lines"), n(r"^[ \t]*$").alias("n_blank"), n(r"^[ \t]*(#|//|\*|/\*)").alias("n_comment"), n(r"^[ \t]*(if|elif|else|for|while|except|catch|case|switch)\b").alias("n_branches")
    )
    most = rows.groupBy(key).agg(*(F.max(c).cast("bigint").alias(c) for c in ("n_lines", "n_blank", "n_comment", "n_branches")))
    return most.withColumn("n_code", F.col("n_lines") - F.col("n_blank") - F.col("n_comment"))
