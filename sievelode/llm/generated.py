"""Problem 2: files that nobody wrote by hand: generated, minified, third-party, or data saved as code.

Method: a multi-pattern automaton finds generation and origin notices in file headers; path rules know vendored
directories, lockfiles, generated and minified names. A file whose body equals a third-party file's is a copy too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelode.session import written

# ---- fixed values: notices and path rules ----

#: What only a generator's notice says, in lower case.
GENERATED_NOTICES = (
    "@generated", "<auto-generated", "autogenerated file", "auto-generated file", "autogenerated by", "auto-generated by",
    "auto generated by", "autogenerated from", "auto-generated from", "code generated by", "file generated by",
    "file was generated", "file is generated", "generated automatically", "automatically generated",
    "was automatically created", "is automatically created", "machine generated", "machine-generated", "machine-made output",
    "changes will be lost", "change will be lost", "change is overwritten", "changes will be overwritten",
    "changes are overwritten", "do not edit this file", "do not modify this file", "do not edit manually",
    "generated by the protocol buffer compiler", "automatisch erzeugt", "automatisch generiert", "maschinell erzeugt",
    "nicht bearbeiten", "généré automatiquement", "fichier généré", "ne pas modifier ce fichier", "généré par",
    "generado por", "generado automáticamente", "archivo generado", "gerado por", "gerado automaticamente",
    "arquivo gerado", "сгенерирован", "создан автоматически", "wygenerowan", "plik utworzony automatycznie",
    "otomatik olarak oluşturul", "otomatik üretil", "自动生成", "自動生成", "自動的に生成", "자동 생성", "자동으로 생성",
    "请勿手工修改", "请勿编辑", "手動で編集しない", "generato automaticamente", "automatisch gegenereerd",
)
#: What only the notice of somebody else's code says.
ORIGIN_NOTICES = (
    "vendored from", "bundled copy of", "copied unchanged from", "upstream: http", "copied verbatim from",
    "imported unchanged from", "third-party code", "third party code", "local copy of http", "taken unchanged from",
)
#: Sayings that take a notice back.
DENIALS = ("nothing is generated", "not generated", "by hand; nothing", "generated by hand")
GENERATED_DIRS = {"generated", "gen", "generated-sources", "generated-src", "autogen", "auto-generated", "_generated", "__generated__", "gen-src"}
VENDOR_DIRS = {
    "node_modules", "bower_components", "jspm_packages", "third_party", "third-party", "thirdparty", "3rdparty", "3rd-party",
    "3rd_party", "vendor", "_vendor", "vendored", "godeps", "site-packages", "dist-packages", "pods", "carthage", ".bundle",
}
LOCKFILES = {
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "pipfile.lock", "uv.lock",
    "cargo.lock", "go.sum", "composer.lock", "gemfile.lock", "mix.lock", "podfile.lock", "flake.lock", "pubspec.lock",
}
GENERATED_NAME = re.compile(
    r"(?:_pb2(?:_grpc)?\.pyi?|_pb2?\.js|_grpc_pb\.js|\.pb\.(?:go|cc|h)|\.pb\.gw\.go|_parsetab\.py|_lextab\.py|OuterClass\.java"
    r"|BaseImpl\.java|_generated\.\w+|\.generated\.\w+|_gen\.go|\.gen\.\w+|\.g\.(?:dart|cs)|\.designer\.cs"
    r"|zz_generated[\w.]*\.go|bindata\.go|_rc\.py)$"
)
MINIFIED_NAME = re.compile(r"(?:[.-]min\.(?:js|css|mjs|cjs)|\.bundle\.(?:js|css)|\.chunk\.js|\.packed\.js|\.[0-9a-f]{8,20}\.(?:js|css))$")
VERSIONED_DIR = re.compile(r"^@?[\w.@-]*?-v?\d+(?:\.\d+)+")
#: "name 1.2.3 - Copyright the name contributors": a package's own banner, version included.
PACKAGE_BANNER = re.compile(r"\b([\w@/.-]+) v?\d+\.\d+(?:\.\d+)* *[-–|,] *(?:\(c\)|copyright|licen[cs]e)\b.*", re.I)
COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|\"\"\"|'''|--|;|<!--|%|\{-|\(\*)")
PREAMBLE = re.compile(r"^\s*(?:package|import|from|use|using|require|include|#include|namespace|'use strict'|\"use strict\"|const .*require\()\b|^\s*['\"]use strict")
OPENERS = (('"""', '"""'), ("'''", "'''"), ("/*", "*/"), ("<!--", "-->"))

_STRINGS = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
_COMMENTS = re.compile(r"^[ \t]*(?:#|//)[^\n]*$|/\*[\s\S]*?\*/", re.M)
_WORDS = re.compile(r"(?<![\w.])[A-Za-z_]\w*")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, notices in (("generated", GENERATED_NOTICES), ("third-party", ORIGIN_NOTICES), ("denied", DENIALS)):
        for notice in notices:
            found.add_word(notice, kind)
    found.make_automaton()
    return found


def header_of(text: str) -> str:
    """The comment lines before the first line of real code; package and import lines may stand between them."""
    out, at, close = [], 0, None
    text = text.lstrip("﻿")
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end].rstrip("\r")
        at = end + 1
        if close:
            out.append(line)
            if close in line:
                close = None
            continue
        bare = line.strip()
        if not bare or PREAMBLE.match(line):
            continue
        if not COMMENT.match(line):
            break
        out.append(line)
        for opener, closer in OPENERS:
            if bare.startswith(opener):
                if closer not in bare[len(opener) :]:
                    close = closer
                break
    return "\n".join(out)


def normal_path(path: str | None) -> str:
    """Forward slashes, no drive, no doubled slashes, no ``./``."""
    parts = re.split(r"[\\/]+", path or "")
    return "/".join(p for p in parts if p not in ("", ".") and not re.fullmatch(r"[A-Za-z]:", p))


def path_kind(path: str | None) -> str | None:
    """What the path alone says: ``third-party``, ``generated``, ``minified`` or nothing."""
    clean = normal_path(path)
    *dirs, name = clean.split("/")
    low = [d.lower() for d in dirs]
    for i, d in enumerate(low):
        if d in VENDOR_DIRS:
            return "third-party"
        if d in ("external", "deps", "extern", "externals", "subprojects", "contrib") and i + 1 < len(low):
            if low[i + 1] == "upstream" or VERSIONED_DIR.match(low[i + 1]):
                return "third-party"
    if name.lower() in LOCKFILES or GENERATED_NAME.search(name) or GENERATED_DIRS & set(low):
        return "generated"
    if MINIFIED_NAME.search(name):
        return "minified"
    return None


def is_minified(text: str, path: str | None = None) -> bool:
    """Dense lines without room between the words, over the whole text."""
    n = len(text)
    if n < 300:
        return False
    lines = text.count("\n") + 1
    room = text.count(" ") + text.count("\t") + lines - 1
    return n / lines > 160 and room / n < 0.09


def is_data(text: str) -> bool:
    """Whether nearly all of the text is literals: a table, an array or an encoded blob saved as code."""
    if len(text) < 600 or sum(text.count(c) for c in "0123456789\"'") * 12 < len(text) and text.count("=") < 3:
        return False
    code = _COMMENTS.sub("", text)
    total = len(code)
    if total < 600:
        return False
    plain = _STRINGS.sub('""', code)
    words = sum(len(w) for w in _WORDS.findall(plain) if w not in ("true", "false", "null", "None", "True", "False", "nil"))
    literals = (total - len(plain)) + sum(map(len, re.findall(r"(?<![\w])[-+]?(?:0x[0-9a-fA-F]+|\d[\d.eE_]*)[,\s]*", plain)))
    return words < 0.06 * total and literals > 0.55 * total


_DIGITS = re.compile(r"0[xX][0-9a-fA-F]+|\d+")


def is_repetitive(text: str) -> bool:
    """Whether ten or more different code lines are at most half as many once their numbers are alike: numbered accessors, fields, tables of bytes."""
    lines = {x for x in map(str.strip, text.split("\n")) if len(x) > 3 and not x.startswith(("//", "* ", "/*"))}
    return len(lines) >= 10 and 2 * len({_DIGITS.sub("#", x) for x in lines}) <= len(lines)


def judge(path: str | None, text: str | None, notices: ahocorasick.Automaton) -> tuple[str | None, str | None]:
    """``(category, reason)`` of one file; ``(None, None)`` for a file that looks hand-written."""
    kind = path_kind(path)
    if kind:
        return kind, "path"
    if not text:
        return None, None
    header = header_of(text)
    if header:
        for line in header.split("\n"):
            kinds = {k for _, k in notices.iter(line.lower())}
            if "denied" not in kinds:
                for kind in ("third-party", "generated"):
                    if kind in kinds:
                        return kind, "notice"
            if PACKAGE_BANNER.search(line) and not line.lstrip().startswith("/*!"):
                return "third-party", "banner"
    if is_minified(text):
        return ("data", "literals") if is_data(text) else ("minified", "density")
    if is_data(text):
        return "data", "literals"
    if is_repetitive(text):
        return "generated", "repetition"
    return None, None


def body_digest(text: str | None) -> int | None:
    """64-bit digest of the text without its leading comments, line ends and blank lines; None for next to no body."""
    if not text:
        return None
    lines = [x.rstrip() for x in text.lstrip("﻿").split("\n")]
    at = 0
    while at < len(lines) and (not lines[at] or lines[at].lstrip().startswith(("#", "//"))):
        at += 1
    body = "\n".join(x for x in lines[at:] if x)
    if len(body) < 80:
        return None
    return int.from_bytes(hashlib.blake2b(body.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def not_handwritten(df: DataFrame, key: str = "file_id", path: str = "file", text: str = "src") -> DataFrame:
    """One row per file that is no hand-written source: ``key``, ``category``, ``reason``.

    Categories: ``generated``, ``minified``, ``third-party``, ``data``; where several hold, the first by path, then
    by notice, then by content. A file that lies anywhere with the body of a third-party file is ``third-party`` with
    the reason ``copy``. A null or empty text is judged by its path, a null path by the text, both null by nothing.
    Rows delivered twice under one key give one row. Only digests and flags are shuffled, never texts; a digest held
    by very many files is aggregated before the shuffle.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notices = _automaton()
        for batch in batches:
            paths, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            judged = [judge(p, t, notices) for p, t in zip(paths, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([c for c, _ in judged], pa.string()),
                    pa.array([r for _, r in judged], pa.string()),
                    pa.array([body_digest(t) for t in texts], pa.int64()),
                ],
                ["k", "category", "reason", "digest"],
            )

    rows = df.select(F.col(key).cast("long").alias("k"), F.col(path).cast("string"), F.col(text).cast("string"))
    judged = written(rows.mapInArrow(scan, "k long, category string, reason string, digest long"))
    foreign = (
        judged.where("category = 'third-party' and digest is not null").groupBy("digest").agg(F.lit(True).alias("foreign"))
    )
    both = judged.join(foreign, "digest", "left")
    copied = both.withColumn("copy", F.coalesce(F.col("foreign"), F.lit(False)) & (F.coalesce(F.col("category"), F.lit("")) != "third-party"))
    return (
        copied.select(
            F.col("k").alias(key),
            F.when(F.col("copy"), "third-party").otherwise(F.col("category")).alias("category"),
            F.when(F.col("copy"), "copy").otherwise(F.col("reason")).alias("reason"),
        )
        .where("category is not null")
        .groupBy(key)
        .agg(F.min_by("category", "reason").alias("category"), F.min("reason").alias("reason"))
    )
