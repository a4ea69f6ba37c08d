"""Problem 4: functions and methods paired with their documentation, in Python, JavaScript, Java and Go.

Method: declarations, class hierarchies and documentation tags are parsed per file; overridden methods without own
documentation are joined level by level with the methods of their base classes, until every one that can be is
resolved; what stays without documentation is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelode.llm.lexing import BLOCK, LINE, family, lex, masked
from sievelode.session import cut_lineage, written

# ---- fixed values: what documentation says nothing ----

PLACEHOLDERS = re.compile(
    r"(?i)^\W*(?:(?:todo|fixme|tbd|tba|xxx|hack|wip|placeholder|stub)\b.*|(?:no|missing) (?:description|documentation|docs?)\b.*"
    r"|auto[- ]?generated (?:stub|method|constructor|code)\b.*|(?:to be|not yet) (?:done|written|documented|described|implemented|defined)\b.*"
    r"|(?:description|documentation|docstring|write|add|insert|put) (?:goes |the |a |your )?(?:here|later|docs?|description|documentation)\b.*"
    r"|see (?:above|below|super|parent|base)\b.*|siehe oben.*|voir (?:plus haut|ci-dessus).*|véase arriba.*|à faire\b.*|por hacer\b.*|a fazer\b.*"
    r"|noch zu (?:tun|schreiben|dokumentieren)\b.*|(?:n/a|none|null|undocumented|internal|getter|setter|helper)\W*"
    r"|待补充.*|待完善.*|暂无.*|同上.*|说明\W*|未実装.*|後で.*|省略\W*|추후 .*|나중에 .*|설명 없음.*|см\. выше.*|нужно описать.*|дописать.*)$",
    re.S,
)
TAG_LINE = re.compile(
    r"^\s*(?:[@\\]\w+|:\w[\w \[\], *.]*:|(?:Args|Arguments|Parameters|Params|Returns?|Raises|Yields|Throws|Examples?|See Also|Notes?|Attributes):?\s*$|-{3,}\s*$)"
)
_WORD = re.compile(r"[^\W_][\w'’-]*")
_DENSE = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿]")
_THAI = re.compile(r"[฀-๿]")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+")

PY_DEF = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*(?:\[[^\]\n]*\][ \t]*)?\(", re.M)
PY_CLASS = re.compile(r"^([ \t]*)class[ \t]+(\w+)[ \t]*(?:\(([^)]*)\))?[ \t]*:", re.M)
GO_FUNC = re.compile(r"^func[ \t]+(?:\([^)\n]*?\*?(\w+)(?:\[[^\]\n]*\])?\)[ \t]*)?(\w+)[ \t]*(?:\[[^\]\n]*\])?\(", re.M)
_PAREN = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
JS_FUNC = re.compile(
    r"(?<![\w$.])(?:(?:export|default|async|const|let|var|static|public|private|protected|readonly|get|set)\s+)*"
    rf"(?:function\s*\*?\s+(?P<a>[\w$]+)\s*(?=\()|(?P<b>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:function\b|(?:{_PAREN}|[\w$]+)\s*(?::[^=\n]+)?=>)"
    rf"|(?:[\w$]+\.)+(?P<c>[\w$]+)\s*=\s*(?:async\s+)?(?:function\b|(?:{_PAREN}|[\w$]+)\s*=>)"
    rf"|(?P<d>[\w$]+)\s*:\s*(?:async\s+)?(?:function\b|{_PAREN}\s*=>)|(?:\*\s*)?#?(?P<e>[\w$]+)\s*{_PAREN}\s*(?::[^{{=;\n]+)?\{{)"
)
JAVA_METHOD = re.compile(
    r"(?<![\w$.])(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*(?:<[^>()]+>\s*)?"
    rf"(?P<type>[\w$.]+(?:<[^()=;{{}}]*>)?(?:\[\])*)\s+(?P<name>[\w$]+)\s*{_PAREN}\s*(?:throws\s+[\w.,\s]+?)?\s*[{{;]"
)
BRACE_CLASS = re.compile(r"\b(?:class|interface|enum|record)\s+([\w$]+)[^{;()]*?(?:\bextends\s+([\w$.<>, ]+?))?\s*(?:\bimplements\s+([\w$.<>, ]+?))?\s*\{")
ANNOTATION = re.compile(rf"\s*@(?!interface\b)[\w.]+(?:\s*{_PAREN})?")
NO_NAMES = {"if", "for", "while", "switch", "catch", "return", "function", "new", "else", "throw", "super", "do", "try", "with", "typeof", "await", "synchronized", "yield", "case", "assert"}


def clean_doc(raw: str, star: bool) -> str:
    """Documentation without comment stars, common indentation and markup tags."""
    lines = [x.rstrip("\r") for x in raw.split("\n")]
    lines = [re.sub(r"^\s*\*? ?" if star else r"^\s*", "", x).rstrip() for x in lines]
    text = "\n".join(lines).strip()
    return text


def says_something(doc: str | None, name: str) -> bool:
    """Whether documentation, without tag lines, has at least four words (eight characters in dense scripts) of its own."""
    if not doc:
        return False
    kept, tagged = [], False
    for line in doc.split("\n"):
        if TAG_LINE.match(line):
            tagged = True
        elif tagged and line[:1].isspace():
            continue
        else:
            tagged = tagged and bool(line.strip()) and False
            kept.append(line)
    text = re.sub(r"\{@\w+[^}]*\}|</?\w+[^>]*>|\*\*|__|`", " ", "\n".join(kept)).strip()
    if not text or PLACEHOLDERS.match(text):
        return False
    own = {p.lower() for p in _PARTS.findall(name)}
    dense = len(_DENSE.findall(text)) + len(_THAI.findall(text))
    words = [w for w in _WORD.findall(text) if not _DENSE.search(w)]
    if dense >= 8:
        return True
    if len(words) + (dense > 0) < 4:
        return False
    parts = {p.lower() for w in words for p in _PARTS.findall(w)}
    return bool(parts - own - {"the", "a", "an", "function", "method", "of", "this", "to", "and", "class", "helper", "der", "die", "das", "la", "le", "el"})


_BRACKETS = re.compile(r"[()\[\]{}:]")
_FIRST_LETTERS = re.compile(r"^([ \t]*)(?=[^\s\\])", re.M)
_PY_FROM = re.compile(r"^[ \t]*from[ \t]+([\w.]+)[ \t]+import[ \t]+(\([^)]*\)|[^\n]+)", re.M)
_PY_IMPORT = re.compile(r"^[ \t]*import[ \t]+([\w., \t]+)", re.M)
_JS_IMPORT = re.compile(r"(?:\bimport\s+(?P<a>[\w$*{}\s,]+?)\s+from\s*|\b(?:const|let|var)\s+(?P<b>[\w$]+|\{[^}]*\})\s*=\s*require\s*\(\s*)[\"'](?P<path>[^\"'\n]+)[\"']")


def _signature_end(code: str, at: int, limit: int) -> int:
    """Offset behind the colon that ends a Python signature whose opening bracket is before ``at``; -1 without one before ``limit``."""
    depth = 1
    for m in _BRACKETS.finditer(code, at, limit):
        c = m.group()
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return -1
        elif depth == 0:
            return m.end()
    return -1


def stem_of(path: str | None) -> str | None:
    """The name by which other files import a file: its own without endings, or its folder's for a folder's main file."""
    parts = [x for x in re.split(r"[\\/]+", path or "") if x]
    if not parts:
        return None
    name = parts[-1].split(".")[0]
    return parts[-2] if name in ("__init__", "index") and len(parts) > 1 else name


def _imported(text: str, fam: str) -> dict[str, tuple[str, str | None]]:
    """Local names of imported classes and modules: the stem of the file that they come from, and their own name there (None for modules)."""
    out: dict[str, tuple[str, str | None]] = {}
    if fam == "py":
        for m in _PY_FROM.finditer(text):
            for part in re.sub(r"[()\\]|#[^\n]*", " ", m[2]).split(","):
                words = part.split()
                if words:
                    out[words[-1]] = (m[1].rsplit(".", 1)[-1], words[0])
        for m in _PY_IMPORT.finditer(text):
            for part in m[1].split(","):
                words = part.split()
                if words:
                    out[words[-1]] = (words[0].rsplit(".", 1)[-1], None)
    elif fam == "js":
        for m in _JS_IMPORT.finditer(text):
            stem = stem_of(m["path"])
            for part in re.split(r"[,{}]", m["a"] or m["b"] or ""):
                words = part.replace(":", " as ").split()
                if words and stem:
                    out[words[-1]] = (stem, None if words[0] == "*" else words[0])
    return out


def _bodies(code: str) -> dict[int, int]:
    """Closing brace of each opening one."""
    stack, out = [], {}
    for m in re.finditer(r"[{}]", code):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start()
    return out


def extract(text: str, fam: str) -> tuple[list[tuple], list[tuple[str, str, int, str | None]], list[str]]:
    """``(functions, bases, classes)`` of one file.

    A function is ``(name, line, class or None, documentation or None, start, end)``; a base is ``(class, base, order,
    stem of the file that the base is imported from or None)``.
    """
    if fam == "conf":
        return [], [], []
    tokens, _ = lex(text, fam)
    code = masked(text, tokens)
    if code[:1] == "\ufeff":
        code = " " + code[1:]
        if fam == "go" and code.startswith(" func"):
            code = "\n" + code[1:]
    out: list[tuple] = []
    named: list[tuple[str, str, int]] = []
    line_at = [0, 1]

    def line_of(pos: int) -> int:
        if pos < line_at[0]:
            line_at[:] = [0, 1]
        line_at[1] += text.count("\n", line_at[0], pos)
        line_at[0] = pos
        return line_at[1]

    def with_stems() -> list[tuple[str, str, int, str | None]]:
        known = _imported(text, fam) if named else {}
        found = []
        for cls, base, i in named:
            first, _, last = base.partition(".")
            stem, own = known.get(first, (None, None))
            last = last.rsplit(".", 1)[-1] or own or first
            found.append((cls, last, i, stem or (last if fam == "java" else None)))
        return found

    if fam == "py":
        strings = {t[1]: t for t in tokens if t[0] not in (LINE, BLOCK)}
        classes = {}
        for m in PY_CLASS.finditer(code):
            classes[m.start()] = m[2]
            for i, b in enumerate(re.split(r"[,\s]+", m[3] or "")):
                if b and "=" not in b:
                    named.append((m[2], b, i))
        defs = {m.start(): m for m in PY_DEF.finditer(code)}
        starts = sorted(defs)
        limits = dict(zip(starts, [*starts[1:], len(code)], strict=False))
        stack: list[list] = []  # [indent, class name or None, index in out or None, end of the signature]

        def close(indent: int, at: int) -> None:
            while stack and stack[-1][0] >= indent:
                index = stack.pop()[2]
                if index is not None:
                    out[index] = (*out[index][:5], at)

        for first in _FIRST_LETTERS.finditer(code):
            at, indent = first.start(), len(first[1].expandtabs())
            if stack and first.end() < stack[-1][3]:
                continue  # within a signature
            close(indent, at)
            if at in classes:
                stack.append([indent, classes[at], None, 0])
            elif at in defs:
                m, doc = defs[at], None
                end = _signature_end(code, m.end(), limits[at])
                if end >= 0:
                    doc = _docstring(text, end, strings)
                stack.append([indent, None, len(out), max(end, 0)])
                owner = stack[-2][1] if len(stack) > 1 else None
                out.append((m[1], line_of(m.end(1)), owner, doc, at, len(text)))
        return out, with_stems(), list(classes.values())

    closing = _bodies(code)
    if fam == "go":
        comments = {t[3]: t for t in tokens if t[0] in (LINE, BLOCK)}
        for m in GO_FUNC.finditer(code):
            lines: list[str] = []  # from the last to the first
            at = m.start() - 1  # the line break before the declaration
            if at >= 0:
                end = at - (text[at - 1 : at] == "\r")
                token = comments.get(at) or comments.get(end)
                block = comments.get(end - 2) if text[end - 2 : end] == "*/" else None
                if block and block[0] == BLOCK:
                    if not text[text.rfind("\n", 0, block[1]) + 1 : block[1]].strip():
                        lines = [clean_doc(text[block[2] : block[3]], True)]
                else:
                    while token and token[0] == LINE and not text[(s := text.rfind("\n", 0, token[1]) + 1) : token[1]].strip():
                        body = text[token[2] : token[3]].rstrip("\r")
                        if not re.match(r"go:|nolint|line |export ", body):
                            lines.append(body[1:] if body.startswith(" ") else body)
                        token = comments.get(s - 1) if s else None
            brace = code.find("{", m.end())
            out.append((m[2], line_of(m.start()), m[1], "\n".join(reversed(lines)).strip() or None, m.start(), closing.get(brace, len(text) - 1) + 1))
        return out, [], []

    pattern = JS_FUNC if fam == "js" else JAVA_METHOD
    docs: dict[int, str] = {}
    matches: dict[int, re.Match] = {}
    for state, start, inner, end in tokens:
        if state == BLOCK and text.startswith("**", start + 1) and text[start : start + 5] != "/**/":
            at = end + 2
            while m := ANNOTATION.match(code, at):
                at = m.end()
            while at < len(code) and code[at].isspace():
                at += 1
            m = pattern.match(code, at)
            if m:
                docs[m.start()] = clean_doc(text[inner + 1 : end], True)
                matches[_name_of(m)[1]] = m
    spans = []
    for m in BRACE_CLASS.finditer(code):
        spans.append((m.end() - 1, closing.get(m.end() - 1, len(code)), m[1]))
        for i, b in enumerate(re.findall(r"[\w$.]+(?=\s*(?:<|,|$))", re.sub(r"<[^<>]*>", "", f"{m[2] or ''},{m[3] or ''}"))):
            named.append((m[1], b, i))
    for m in pattern.finditer(code):
        matches.setdefault(_name_of(m)[1], m)
    inside: list[tuple[int, int, str]] = []  # the classes around the place, the innermost last
    waiting = 0
    for m in sorted(matches.values(), key=lambda m: m.start()):
        name = _name_of(m)[0]
        while waiting < len(spans) and spans[waiting][0] < m.start():
            while inside and inside[-1][1] <= spans[waiting][0]:
                inside.pop()
            inside.append(spans[waiting])
            waiting += 1
        while inside and inside[-1][1] <= m.start():
            inside.pop()
        if not name or name in NO_NAMES or fam == "java" and m["type"] in NO_NAMES | {"class", "import", "package", "extends"}:
            continue
        brace = code.find("{", m.end() - 1)
        out.append((name, line_of(m.start()), inside[-1][2] if inside else None, docs.get(m.start()), m.start(), closing.get(brace, len(text) - 1) + 1))
    return out, with_stems(), [n for _, _, n in spans]


def _name_of(m: re.Match) -> tuple[str | None, int]:
    """Name of a declaration in braces languages, and where it stands; what is no declaration has none."""
    return next(((v, m.start(k)) for k, v in m.groupdict().items() if k != "type" and v), (None, -1 - m.start()))


def _docstring(text: str, at: int, strings: dict[int, tuple[int, int, int, int]]) -> str | None:
    """The literal that is the first statement behind ``at``; comments and blank lines may stand before it."""
    while True:
        while at < len(text) and (text[at].isspace() or text[at] == "\\"):
            at += 1
        if at >= len(text) or text[at] != "#":
            break
        at = text.find("\n", at)
        if at < 0:
            return None
    head = re.match(r"[rRuU]?(?=[\"'])", text[at : at + 2])
    token = strings.get(at + head.end()) if head else None
    if not token:
        return None
    after = token[3] + (3 if token[0] >= 5 else 1)
    return clean_doc(text[token[2] : token[3]], False) if _STATEMENT_END.match(text, after) else None


_STATEMENT_END = re.compile(r"[ \t]*(?:[;#\r\n]|\Z)")


_BASE = "struct<cls:string,base:string,ord:int,stem:string>"


def _extracted(df: DataFrame, key: str, text: str, lang: str, path: str, repo: str, with_code: bool) -> DataFrame:
    """``rid, k, repo, fam, stem, cls, name, line, doc, says, code`` of the functions that say something or may inherit it; ``bases`` and ``classes`` of a file on its first row."""
    schema = f"rid long, k long, repo string, fam string, stem string, cls string, name string, line int, doc string, says boolean, code string, bases array<{_BASE}>, classes array<string>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_type = pa.list_(pa.struct([("cls", pa.string()), ("base", pa.string()), ("ord", pa.int32()), ("stem", pa.string())]))
        types = (pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int32(), pa.string(), pa.bool_(), pa.string(), base_type, pa.list_(pa.string()))
        names = ["rid", "k", "repo", "fam", "stem", "cls", "name", "line", "doc", "says", "code", "bases", "classes"]
        for batch in batches:
            out: list[tuple] = []
            for rid, k, body, language, place, home in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not body:
                    continue
                fam = family(language, place, body)
                functions, bases, classes = extract(body, fam)
                found, deriving = {}, {b[0] for b in bases}
                for name, line, cls, doc, start, end in functions:
                    says = says_something(doc, name)
                    # Of functions with one name on one line, one that says something counts.
                    if (says or cls in deriving) and ((name, line) not in found or says and not found[name, line][4]):
                        found[name, line] = (cls, name, line, doc if says else None, says, body[start:end].rstrip() if with_code else None)
                rows = list(found.values())
                if classes and not rows:
                    rows.append((None, None, None, None, False, None))
                for i, row in enumerate(rows):
                    links = [{"cls": c, "base": b, "ord": n, "stem": s} for c, b, n, s in bases]
                    out.append((rid, k, home, fam, stem_of(place), *row, *((links or None, classes or None) if i == 0 else (None, None))))
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    fields = (F.col(c).cast("string").alias(n) for c, n in ((text, "t"), (lang, "l"), (path, "p"), (repo, "r")))
    return df.select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("k"), *fields).mapInArrow(scan, schema)


def _once(rows: DataFrame) -> DataFrame:
    """The functions, each once a key, name and line. Only rows of keys that were delivered more than once are shuffled."""
    again = written(rows.select("k", "rid").distinct().groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select(F.col("k").alias("again")))
    same = F.col("k").eqNullSafe(F.col("again"))
    functions = rows.where("name is not null").drop("rid", "bases", "classes")
    first = functions.join(again, same, "left_semi").groupBy("k", "name", "line").agg(F.min(F.struct(~F.col("says"), *(c for c in functions.columns if c not in ("k", "name", "line")))).alias("x"))
    kept = first.select(*(c if c in ("k", "name", "line") else F.col(f"x.{c}").alias(c) for c in functions.columns))
    return functions.join(again, same, "left_anti").unionByName(kept)


def _hierarchy(rows: DataFrame) -> DataFrame:
    """``ak, acls, ord, tk, tcls``: each class and its bases, as keys of the file that defines them.

    A base is looked for in its own file, then in the files of the repository by whose name it is imported, then
    anywhere in the repository; of several the least key. Each step joins one row a name, so that a name that very many
    classes have makes no pairs.
    """
    home = rows.where("classes is not null").select("k", "repo", "fam", "stem", F.explode("classes").alias("base")).distinct()
    links = (
        rows.where("bases is not null").select("k", "repo", "fam", F.explode("bases").alias("b")).where("b.cls <> b.base or b.stem is not null")
        .groupBy("k", "repo", "fam", "b.cls", "b.base").agg(F.min(F.struct("b.ord", "b.stem")).alias("x"))
        .select("k", "repo", "fam", "cls", "base", "x.ord", "x.stem")
    )
    here = home.select("k", "base", F.col("k").alias("k1")).distinct()
    imported = home.where("stem is not null").groupBy("repo", "fam", "stem", "base").agg(F.min("k").alias("k2"))
    anywhere = home.groupBy("repo", "fam", "base").agg(F.min("k").alias("k3"))
    found = links.join(here, ["k", "base"], "left").join(imported, ["repo", "fam", "stem", "base"], "left").join(anywhere, ["repo", "fam", "base"], "left")
    target = F.when(F.col("cls") != F.col("base"), F.coalesce("k1", "k2", "k3")).otherwise(F.col("k2"))
    return found.select(F.col("k").alias("ak"), F.col("cls").alias("acls"), "ord", target.alias("tk"), F.col("base").alias("tcls")).where("tk is not null")


def _inherited(rows: DataFrame) -> DataFrame:
    """``k, name, line, dk, dcls``: which class documents each method that lacks documentation of its own."""
    links = cut_lineage(_hierarchy(rows))
    donors = cut_lineage(rows.where("says and cls is not null").select(F.col("k").alias("ak"), F.col("cls").alias("acls"), "name").distinct().withColumn("there", F.lit(True)))
    front = rows.where("not says and cls is not null and name is not null").select("k", "name", "line", F.col("k").alias("ak"), F.col("cls").alias("acls")).distinct()
    front = front.withColumn("way", F.array().cast("array<int>"))
    place = ["k", "name", "line", "ak", "acls"]
    met = found = None
    depth = 0
    while True:
        climbed = (
            front.join(links, ["ak", "acls"]).select("k", "name", "line", F.col("tk").alias("ak"), F.col("tcls").alias("acls"), F.concat("way", F.array("ord")).alias("way"))
            .groupBy(*place).agg(F.min("way").alias("way"))
        )
        if met is not None:
            climbed = climbed.join(met, place, "left_anti")
        climbed = cut_lineage(climbed.join(donors, ["ak", "acls", "name"], "left"))
        level = climbed.where("there").groupBy("k", "name", "line").agg(F.min_by(F.struct("ak", "acls"), "way").alias("d")).select("k", "name", "line", "d.ak", "d.acls")
        found = level if found is None else found.unionByName(level)
        front = climbed.where("there is null").join(level, ["k", "name", "line"], "left_anti").drop("there")
        if climbed.where("there is null").isEmpty():
            return found.withColumnsRenamed({"ak": "dk", "acls": "dcls"})
        depth += 1
        here = climbed.select(*place)
        met = here if met is None else met.unionByName(here)
        if depth % 16 == 0:
            met, found = cut_lineage(met), cut_lineage(found)


def documented(df: DataFrame, key: str = "review_id", text: str = "content", lang: str = "lang", path: str = "path", repo: str = "repo") -> DataFrame:
    """The pairs whose documentation is the function's own: ``key``, ``func_name``, ``func_line``, ``doc``."""
    return function_pairs(df, key, text, lang, path, repo, with_code=False).where("doc_source = 'own'").select(key, "func_name", "func_line", "doc")


def function_pairs(
    df: DataFrame, key: str = "review_id", text: str = "content", lang: str = "lang", path: str = "path", repo: str = "repo", with_code: bool = True
) -> DataFrame:
    """One row per function with documentation of its own or inherited: ``key``, ``func_name``, ``func_line``,
    ``class_name``, ``doc``, ``doc_source`` (``own`` or ``inherited``), ``code`` (null unless ``with_code``).

    Inherited documentation is that of the nearest base class whose method of the same name says something; among bases
    of one class the first named wins. Bases are found by file, import and repository (``_hierarchy``). Each round climbs
    one level for all open methods at once, until none is left; classes that were met before are not climbed again, so
    that circular bases end. Functions that stay without documentation are dropped.

    Null and empty texts give no rows, a null language is told from path or text, files that do not parse are read as
    far as their brackets and quotes allow, a null repository is one of its own. Rows delivered twice give one row each
    function. The files are parsed once and written to the shared folder; the rounds move keys and names only,
    documentation and code are joined at the end.
    """
    rows = written(_extracted(df, key, text, lang, path, repo, with_code).withColumn("repo", F.coalesce("repo", F.lit(""))))
    found = _inherited(rows)
    functions = _once(rows)
    own = functions.where("says").select("k", "name", "line", "cls", "doc", F.lit("own").alias("source"), "code")
    docs = functions.where("says and cls is not null").groupBy(F.col("k").alias("dk"), F.col("cls").alias("dcls"), "name").agg(F.min_by("doc", "line").alias("doc"))
    inherited = (
        functions.where("not says").select("k", "name", "line", "cls", "code")
        .join(found, ["k", "name", "line"]).join(docs, ["dk", "dcls", "name"])
        .select("k", "name", "line", "cls", "doc", F.lit("inherited").alias("source"), "code")
    )
    return own.unionByName(inherited).select(
        F.col("k").alias(key), F.col("name").alias("func_name"), F.col("line").alias("func_line"), F.col("cls").alias("class_name"),
        "doc", F.col("source").alias("doc_source"), "code",
    )
