"""Rule packs as data: security dimensions, network, command execution, known defects and secrets, each scanned in one pass."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class PackRule(NamedTuple):
    """A rule fires where ``pattern`` (and ``also``, if given) occurs and ``unless`` does not."""

    name: str
    pack: str
    severity: str
    confidence: str
    pattern: str
    also: str | None = None
    unless: str | None = None


# ---- fixed values: patterns of the packs, in a form that Java's and RE2's dialect read alike ----

DIMENSION_RULES = (
    PackRule("sql-concatenation", "injection", "critical", "high", r"(?s)\b(SELECT|INSERT|UPDATE|DELETE)\b.*?(f[\"']|\+\s*[\"'a-zA-Z_]|%[\"']|\.format\(|\{[^}]*\})"),
    PackRule("shell-true", "injection", "critical", "high", r"(?i)subprocess\.[a-z]+\([^)]*shell\s*=\s*True"),
    PackRule("command-concatenation", "injection", "major", "high", r"os\.system\s*\([^)]*[\+\{]"),
    PackRule("template-injection", "injection", "critical", "medium", r"render_template_string\s*\("),
    PackRule("inner-html", "injection", "major", "medium", r"\.innerHTML\s*=|dangerouslySetInnerHTML"),
    PackRule("default-credentials", "authentication", "critical", "medium", r"(?i)\b(admin\s*/\s*admin|administrator\s*/\s*administrator|root\s*/\s*root)|user\s*=\s*[\"']admin[\"']\s*,\s*pass\s*=\s*[\"']admin[\"']"),
    PackRule("always-true-check", "authentication", "major", "medium", r"\b(login|auth|verify)\s*\([^)]*\)\s*:\s*return\s+True"),
    PackRule("object-reference", "authorization", "major", "medium", r"\.get\([^)]*\.get\(|request\.[a-z_]+\.get\([\"'](id|uid|user_id)[\"']\)", None, r"is_admin|role|authorize"),
    PackRule("no-deny-branch", "authorization", "minor", "low", r"if\s+[^\n]*(user|role|admin)[^\n]*:\s*\n\s*[^#]*\z", None, r"return False|(?i:deny)"),
    PackRule("pickle", "deserialization", "critical", "high", r"pickle\.loads?\s*\("),
    PackRule("yaml-load", "deserialization", "critical", "high", r"yaml\.load\s*\([^)]*\)"),
    PackRule("marshal", "deserialization", "major", "high", r"\bmarshal\.loads?\s*\("),
    PackRule("open-write", "file", "major", "medium", r"open\s*\([^)]*[\"']w[\"']|\bopen\s*\([^)]*(path|filename|name|user_input)"),
    PackRule("path-traversal", "file", "critical", "medium", r"(path|filename|name|dir|target)\s*=\s*request\.[a-z_]+\.get\([^)]*\)[^;\n]*open\s*\("),
    PackRule("archive-extract", "file", "critical", "medium", r"\.extractall\s*\(|\.extract\s*\("),
    PackRule("recursive-delete", "file", "major", "medium", r"\bshutil\.rmtree\s*\([^)]*(path|dir|name)"),
    PackRule("request-to-variable", "ssrf", "major", "medium", r"(requests\.(get|post)|urlopen)\s*\([^)]*(url|target|host|link|input)"),
    PackRule("request-concatenation", "ssrf", "major", "medium", r"(requests\.(get|post)|urlopen)\s*\([^)]*[\+\{]"),
    PackRule("weak-digest", "crypto", "major", "medium", r"hashlib\.(md5|sha1)\s*\("),
    PackRule("weak-cipher", "crypto", "critical", "medium", r"\bCipher\.(DES|RC4)|MODE_ECB"),
    PackRule("clear-transport", "crypto", "minor", "low", r"http://", r"(url|endpoint|api|server)"),
    PackRule("debug-on", "config", "major", "high", r"debug\s*=\s*True"),
    PackRule("any-origin", "config", "major", "medium", r"CORS|Access-Control-Allow-Origin[^\n]*\*|allowed_origins\s*=\s*\[[\"']\*"),
    PackRule("any-host", "config", "major", "high", r"ALLOWED_HOSTS\s*=\s*\[[\"']\*"),
    PackRule("unpinned-requirement", "supply-chain", "minor", "medium", r"(?m)^\s*(requests|flask|django|pip|numpy|pandas|torch|tensorflow|pyyaml|cryptography|httpx|fastapi)\s*[><=!]", None, r"\A[^\n]*==\s*['\"\d]"),
    PackRule("unsafe-install", "supply-chain", "major", "medium", r"pip\s+install\s+[^>]*\b--[^\n]*(pre|no-deps)|npm\s+install\s+--unsafe"),
)
NETWORK_RULES = (
    PackRule("request-variable", "network", "major", "high", r"requests\.(get|post|put|delete|head)\s*\(\s*[a-zA-Z_][a-zA-Z0-9_]*"),
    PackRule("urlopen-variable", "network", "major", "high", r"urllib\.request\.urlopen\s*\(\s*[a-zA-Z_][a-zA-Z0-9_]*\s*\)"),
    PackRule("clear-http", "network", "major", "high", r"[\"']http://[^\"'\s]+", None, r"https?://(localhost|127\.0\.0\.1|0\.0\.0\.0)"),
    PackRule("credentials-in-url", "network", "critical", "high", r"https?://[^@\s/:]+:[^@\s/]+@"),
    PackRule("executed-response", "network", "critical", "high", r"(response\.text|\.content|requests\.get[^)]*\))\s*[^\n]{0,40}(eval|exec|__import__)"),
    PackRule("debug-setting", "network", "major", "high", r"DEBUG\s*=\s*True"),
    PackRule("host-setting", "network", "major", "high", r"ALLOWED_HOSTS\s*=\s*\[?\s*[\"']\*"),
    PackRule("shell-download", "network", "major", "high", r"(curl|wget)\b[^)\n]{0,40}[\+\{]"),
)
GUARD_RULES = (
    PackRule("system-call", "guard", "critical", "high", r"\bos\.system\s*\("),
    PackRule("popen-call", "guard", "critical", "high", r"\bos\.popen\s*\("),
    PackRule("spawn-call", "guard", "critical", "high", r"\bos\.spawn[a-z]*\s*\("),
    PackRule("shell-process", "guard", "critical", "high", r"subprocess\.(Popen|run|call|check_call)\s*\([^)]*\bshell\s*=\s*True"),
    PackRule("dynamic-code", "guard", "critical", "high", r"\beval\s*\(|\bexec\s*\("),
)
KNOWN_DEFECTS = (
    PackRule("bool-field-json", "defect", "major", "high", r"\b(bool|boolean|is_[a-z_]+|has_[a-z_]+|flag|enabled|active)\b\s*=\s*[\"'](true|false|1|0)[\"']"),
    PackRule("cn-tokenize", "defect", "major", "high", r"\.split\([\"'][^\"']{1,6}[\"']\)|split\(\)"),
    PackRule("quote-escape", "defect", "major", "high", r"[\"']\\\"[\"']|\\\['\"\]"),
    PackRule("datetime-naive", "defect", "minor", "high", r"datetime\.now\(\)|datetime\.utcnow\(\)"),
    PackRule("float-eq", "defect", "minor", "high", r"==\s*0?\.?[0-9]+(\.\d+)?"),
    PackRule("silent-except", "defect", "critical", "high", r"except\s*:\s*pass|except\s+[A-Za-z]+\s*:\s*pass"),
    PackRule("global-mutation", "defect", "major", "high", r"^\s*global\s+"),
)
SECRET_RULES = (
    PackRule("aws-access-key", "secret", "critical", "high", r"\bAKIA[0-9A-Z]{16}\b"),
    PackRule("aws-secret-key", "secret", "critical", "high", r"(?i)\baws_secret_access_key\b\s*=\s*['\"][A-Za-z0-9/+=]{40}['\"]"),
    PackRule("private-key", "secret", "critical", "high", r"-----BEGIN (RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----"),
    PackRule("github-token", "secret", "critical", "high", r"\bgh[pousr]_[A-Za-z0-9]{36,255}\b"),
    PackRule("google-api-key", "secret", "major", "high", r"\bAIza[0-9A-Za-z\-_]{35}\b"),
    PackRule("slack-token", "secret", "major", "high", r"\bxox[baprs]-[0-9A-Za-z\-]{10,}\b"),
    PackRule("signing-secret", "secret", "major", "high", r"(?i)\b(jwt_?secret|secret_key)\b\s*=\s*['\"][^'\"]{16,}['\"]"),
    PackRule("named-secret", "secret", "major", "high", r"(?i)\b(password|passwd|pwd|secret|api_key|apikey|token|client_secret)\b\s*=\s*['\"][^'\"]{6,}['\"]"),
    PackRule("long-hex", "secret", "minor", "high", r"\b[0-9a-f]{32}\b"),
    PackRule("long-base64", "secret", "minor", "high", r"\b[A-Za-z0-9+/]{40,}={0,2}\b"),
)
TEXT_PACKS = DIMENSION_RULES + NETWORK_RULES + GUARD_RULES
TIER_OF = {"critical": "P0", "major": "P1"}


def tier_of(rule: PackRule) -> str:
    """P0 for critical, P1 for major, P2 for the rest and for whatever is said with low confidence."""
    return "P2" if rule.confidence == "low" else TIER_OF.get(rule.severity, "P2")


def fires(text: Column, rule: PackRule) -> Column:
    hit = text.rlike(rule.pattern)
    if rule.also:
        hit = hit & text.rlike(rule.also)
    return hit & ~text.rlike(rule.unless) if rule.unless else hit


def _row(rule: PackRule, **more: Column) -> Column:
    fixed = {"rule": rule.name, "pack": rule.pack, "severity": rule.severity, "tier": tier_of(rule)}
    return F.struct(*(F.lit(v).alias(k) for k, v in fixed.items()), *(c.alias(k) for k, c in more.items()))


def scan_packs(df: DataFrame, key: str, text: str, rules: tuple[PackRule, ...] = TEXT_PACKS) -> DataFrame:
    """``key``, ``rule``, ``pack``, ``severity``, ``tier`` of every rule that a text breaks.

    All rules are asked in one projection where the text lies. Null texts break none; rows delivered twice count once.
    """
    hits = F.array(*(F.when(fires(F.col(text), r), _row(r)) for r in rules))
    return df.select(key, F.explode(F.array_compact(hits)).alias("x")).select(key, "x.*").distinct()


def scan_defects(df: DataFrame, key: str, text: str, rules: tuple[PackRule, ...] = KNOWN_DEFECTS) -> DataFrame:
    """``key``, ``rule``, ``severity``, ``tier``, ``line`` of the first place where each known defect occurs in a text."""

    def line(pattern: str) -> Column:
        before = F.substring(F.col(text), F.lit(1), F.regexp_instr(text, F.lit(pattern)) - 1)
        return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1

    hits = F.array(*(F.when(F.col(text).rlike(r.pattern), _row(r, line=line(r.pattern))) for r in rules))
    return df.select(key, F.explode(F.array_compact(hits)).alias("x")).select(key, "x.*").drop("pack").distinct()


def scan_secrets(df: DataFrame, key: str, text: str, rules: tuple[PackRule, ...] = SECRET_RULES, shown: int = 24) -> DataFrame:
    """``key``, ``line_no``, ``rule``, ``severity``, ``tier``, ``excerpt`` of every line with a secret; the first rule in order decides.

    ``excerpt`` has the first ``shown`` characters of what the rule found. A critical secret is P0, every other P1.
    """
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    found = F.lit(None).cast("struct<rule:string,severity:string,tier:string,excerpt:string>")
    for r in reversed(rules):
        excerpt = F.concat(F.substring(F.regexp_extract("line", r.pattern, 0), 1, shown), F.lit("…"))
        row = F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit("P0" if r.severity == "critical" else "P1").alias("tier"), excerpt.alias("excerpt"))
        found = F.when(F.col("line").rlike(r.pattern), row).otherwise(found)
    return lines.select(key, (F.col("pos") + 1).alias("line_no"), found.alias("x")).where("x is not null").select(key, "line_no", "x.*").distinct()
