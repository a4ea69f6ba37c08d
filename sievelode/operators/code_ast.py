"""Syntax-tree operators on Python sources: one row per node of interest, everything else is relational."""

from __future__ import annotations

import ast
import builtins
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelode.functions.languages import family

_MUTATORS = ("append", "extend", "insert", "pop", "remove", "clear", "add", "discard")
_RETURN_CODES = ("os.system", "subprocess.run", "subprocess.call")
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.Assert)


def _is_built(node: ast.AST) -> bool:
    """Whether a query's text is put together: an f-string with values, a sum or a format of a string."""
    if isinstance(node, ast.JoinedStr):
        return any(isinstance(v, ast.FormattedValue) for v in node.values)
    return isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add | ast.Mod)


def cognitive(function: ast.AST) -> int:
    """Cognitive complexity: each branch costs one more than the branches around it, a chain of conditions one per further condition and its depth."""
    total, stack = 0, [(function, 0)]
    while stack:
        node, depth = stack.pop()
        if isinstance(node, ast.BoolOp):
            cost = len(node.values) - 1
        else:
            cost = int(isinstance(node, ast.If | ast.While | ast.For | ast.AsyncFor | ast.ExceptHandler | ast.IfExp))
        if cost:
            total += cost + depth
            depth += 1
        stack += [(child, depth) for child in ast.iter_child_nodes(node)]
    return total


def _is_forwarding(function: ast.FunctionDef | ast.AsyncFunctionDef) -> bool:
    """Whether a function only passes its plain arguments on to one call."""
    plain = not function.args.vararg and not function.args.kwarg and not any(a.arg.startswith("_") for a in function.args.args)
    one = len(function.body) == 1 and isinstance(function.body[0], ast.Return | ast.Expr)
    return plain and one and sum(isinstance(x, ast.Call) for x in ast.walk(function)) == 1


def _changes_what_it_walks(loop: ast.For | ast.AsyncFor) -> Iterator[int]:
    """Lines in a loop over a name on which that name's container is changed."""
    if not isinstance(loop.iter, ast.Name):
        return
    for x in ast.walk(loop):
        if isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr in _MUTATORS:
            if isinstance(x.func.value, ast.Name) and x.func.value.id == loop.iter.id:
                yield x.lineno


def _repeated_literals(tree: ast.AST, least: int = 3, top: int = 3) -> list[tuple[str, int]]:
    """The ``top`` string constants of four or more characters that stand ``least`` times or more; ties by text."""
    counts = Counter(x.value for x in ast.walk(tree) if isinstance(x, ast.Constant) and isinstance(x.value, str) and len(x.value) >= 4)
    return sorted(((s, n) for s, n in counts.items() if n >= least), key=lambda x: (-x[1], x[0]))[:top]


def _facts(tree: ast.AST) -> Iterator[tuple[str, str, str, int, int]]:
    """``(kind, scope, name, line, number)`` of a module: functions, classes, imports, names, calls and findings."""

    def walk(node: ast.AST, scope: str) -> Iterator[tuple[str, str, str, int, int]]:
        for child in ast.iter_child_nodes(node):
            inner = scope
            line = getattr(child, "lineno", 0)
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                inner = f"{scope}.{child.name}" if scope else child.name
                branches = 1 + sum(isinstance(x, _BRANCHES) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0) for x in ast.walk(child))
                yield "function", scope, child.name, line, branches
                yield "cognitive", scope, child.name, line, cognitive(child)
                yield "length", scope, child.name, line, (child.end_lineno or line) - line + 1
                if any(isinstance(d, ast.List | ast.Dict | ast.Set) for d in [*child.args.defaults, *child.args.kw_defaults]):
                    yield "mutable-default", scope, child.name, line, 1
                if child.name.startswith("_") and sum(isinstance(x, ast.stmt) for x in ast.walk(child)) <= 2:
                    yield "thin-private", scope, child.name, line, 1
                if _is_forwarding(child):
                    yield "forwarding", scope, child.name, line, 1
            elif isinstance(child, ast.ClassDef):
                inner = f"{scope}.{child.name}" if scope else child.name
                yield "class", scope, child.name, line, len(child.bases)
                methods = [x.name for x in child.body if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef)]
                if methods == ["__init__"]:
                    yield "only-init", scope, child.name, line, 1
            elif isinstance(child, ast.Import | ast.ImportFrom):
                for alias in child.names:
                    yield "import", getattr(child, "module", None) or alias.name, (alias.asname or alias.name).split(".")[0], line, 1
            elif isinstance(child, ast.Name):
                yield "load" if isinstance(child.ctx, ast.Load) else "store", scope, child.id, line, 1
            elif isinstance(child, ast.arg):
                yield "store", scope, child.arg, line, 1
            elif isinstance(child, ast.Constant) and isinstance(child.value, str) and child.value.startswith(("http://", "https://", "ws://", "wss://", "ftp://")):
                yield "address", scope, child.value.split("?")[0], line, 1
            elif isinstance(child, ast.Call):
                name = child.func.attr if isinstance(child.func, ast.Attribute) else getattr(child.func, "id", "")
                if name:
                    yield "call", scope, name, line, len(child.args)
                if name in ("execute", "run", "query") and child.args and _is_built(child.args[0]):
                    yield "built-query", scope, name, line, 1
            elif isinstance(child, ast.BinOp) and isinstance(child.op, ast.Div | ast.FloorDiv | ast.Mod) and isinstance(child.right, ast.Constant) and child.right.value == 0:
                yield "zero-division", scope, "/", line, 1
            elif isinstance(child, ast.While) and isinstance(child.test, ast.Constant) and child.test.value and not any(isinstance(x, ast.Break | ast.Return | ast.Raise) for x in ast.walk(child)):
                yield "endless-loop", scope, "while", line, 1
            elif isinstance(child, ast.ExceptHandler) and child.type is None:
                yield "bare-except", scope, "except", line, 1
            elif isinstance(child, ast.For | ast.AsyncFor):
                for at in _changes_what_it_walks(child):
                    yield "mutated-loop", scope, "for", at, 1
            elif isinstance(child, ast.Expr) and isinstance(child.value, ast.Call) and ast.unparse(child.value.func) in _RETURN_CODES:
                yield "ignored-result", scope, ast.unparse(child.value.func), line, 1
            elif isinstance(child, ast.Compare) and any(isinstance(c, ast.Constant) and c.value is None for c in child.comparators) and any(isinstance(o, ast.Eq | ast.NotEq) for o in child.ops):
                yield "none-compare", scope, "==", line, 1
            for body in (getattr(child, "body", None), getattr(child, "orelse", None)):
                for before, after in zip(body or [], (body or [])[1:], strict=False) if isinstance(body, list) else ():
                    if isinstance(before, ast.Return | ast.Raise | ast.Break | ast.Continue):
                        yield "unreachable", inner, type(before).__name__.lower(), after.lineno, 1
            yield from walk(child, inner)

    yield from walk(tree, "")
    for text, n in _repeated_literals(tree):
        yield "repeated-literal", "", text, 1, n


def code_facts(df: DataFrame, key: str = "review_id", text: str = "content", lang: str | None = None, path: str | None = None) -> DataFrame:
    """``key``, ``kind``, ``scope``, ``name``, ``line``, ``number`` of each node of interest; files that do not parse give one ``syntax-error`` row.

    Each file is parsed once, where it is read. Null and empty texts give no rows; very deep nests count as errors.
    Where ``lang`` and ``path`` name columns, only files are parsed that are Python by ending, else language, else text.
    Rows delivered twice give their facts once; equal nodes of one line are facts of their own, told apart by their
    place in the tree, since chained calls begin at one column.
    """
    python_only = lang is not None and path is not None

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, source, said, at in zip(frame["k"], frame["t"], frame["said"], frame["at"], strict=True):
                if not source or python_only and family(said, at, source) != "py":
                    continue
                try:
                    out += [(k, *f, i) for i, f in enumerate(_facts(ast.parse(source.lstrip("﻿"))))]
                except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
                    out.append((k, "syntax-error", "", type(error).__name__, getattr(error, "lineno", None) or 0, 1, 0))
            yield pd.DataFrame(out, columns=["k", "kind", "scope", "name", "line", "number", "place"])

    said, at = (F.col(c).cast("string") if python_only else F.lit("") for c in (lang, path))
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"), said.alias("said"), at.alias("at")).where("t is not null")
    facts = rows.mapInPandas(parse, "k long, kind string, scope string, name string, line int, number int, place int")
    return facts.withColumnRenamed("k", key).distinct().drop("place")


def unused_imports(facts: DataFrame, key: str = "review_id") -> DataFrame:
    """``key``, ``name``, ``line`` of imports whose name is never loaded (anti join)."""
    loads = facts.where("kind = 'load'").select(key, "name").distinct()
    return facts.where("kind = 'import'").select(key, "name", "line").distinct().join(loads, [key, "name"], "left_anti")


def complexity_report(facts: DataFrame, key: str = "review_id", over: int = 10) -> DataFrame:
    """``key``, ``n_functions``, ``avg_complexity``, ``max_complexity``, ``n_over``, ``worst`` (first by line of the most complex)."""
    f = facts.where("kind = 'function'")
    return f.groupBy(key).agg(
        F.count("*").alias("n_functions"), F.bround(F.avg("number"), 1).alias("avg_complexity"), F.max("number").alias("max_complexity"),
        F.count_if(F.col("number") > over).alias("n_over"), F.min_by("name", F.struct(-F.col("number"), F.col("line"), F.col("name"))).alias("worst"),
    )


def function_report(facts: DataFrame, key: str = "review_id", high: int = 10) -> DataFrame:
    """``key``, ``scope``, ``name``, ``line``, ``cyclomatic``, ``cognitive``, ``lines``, ``verdict`` of each function.

    Several functions of one name and line (as in generated one-line files) are one row with their greatest numbers.
    """
    most = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("number")))
    rows = facts.where(F.col("kind").isin("function", "cognitive", "length")).groupBy(key, "scope", "name", "line").agg(
        most("function").alias("cyclomatic"), most("cognitive").alias("cognitive"), most("length").alias("lines")
    )
    return rows.withColumn("verdict", F.when(F.col("cyclomatic") > high, "high").when(F.col("cyclomatic") > high // 2, "warn").otherwise("ok"))


def reuse_rules(facts: DataFrame, key: str = "review_id") -> DataFrame:
    """``key``, ``rule``, ``name``, ``line``, ``n``: functions of one statement whose name begins with an underscore (``__init__`` too), functions that only forward, classes with nothing but ``__init__``, and repeated literals."""
    kinds = ("thin-private", "forwarding", "only-init", "repeated-literal")
    return facts.where(F.col("kind").isin(*kinds)).groupBy(key, F.col("kind").alias("rule"), "name", "line").agg(F.max("number").alias("n"))


def defined_names(facts: DataFrame, key: str = "review_id") -> DataFrame:
    """``key``, ``name``: the functions and classes that a file defines and the top packages that it imports, of two or more characters."""
    name = F.when(F.col("kind") == "import", F.split("scope", r"\.")[0]).otherwise(F.col("name"))
    return facts.where(F.col("kind").isin("import", "function", "class")).select(key, name.alias("name")).where(F.length("name") >= 2).distinct()


def tainted_calls(facts: DataFrame, sources: tuple[str, ...], sinks: tuple[str, ...], key: str = "review_id") -> DataFrame:
    """``key``, ``scope``, ``sink``, ``line``: calls of a sink in a scope that calls a source on an earlier or the same line."""
    calls = facts.where("kind = 'call'")
    first = calls.where(F.col("name").isin(*sources)).groupBy(key, "scope").agg(F.min("line").alias("from_line"))
    return calls.where(F.col("name").isin(*sinks)).join(first, [key, "scope"]).where("line >= from_line").select(key, "scope", F.col("name").alias("sink"), "line").distinct()


def naming_breaks(facts: DataFrame, key: str = "review_id") -> DataFrame:
    """``key``, ``kind``, ``name``, ``line`` of functions that are not in snake case and classes that are not in capitals by word."""
    ok = F.when(F.col("kind") == "function", F.col("name").rlike("^_{0,2}[a-z][a-z0-9_]*$")).otherwise(F.col("name").rlike("^_?[A-Z][A-Za-z0-9]*$"))
    return facts.where(F.col("kind").isin("function", "class") & ~ok).select(key, "kind", "name", "line").distinct()


def file_outline(facts: DataFrame, key: str = "review_id") -> DataFrame:
    """``key``, ``classes``, ``functions``, ``imports``: sorted distinct names, joined by commas. Bounded by one file's size."""
    names = lambda kind, column="name": F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col(column)))))
    return facts.groupBy(key).agg(names("class").alias("classes"), names("function").alias("functions"), names("import", "scope").alias("imports"))


def minimalism(facts: DataFrame, known: tuple[str, ...], opaque: tuple[str, ...], key: str = "review_id") -> DataFrame:
    """``key``, ``foreign_imports``, ``opaque_calls``, ``score``: 100 less 15 for each of up to 4 foreign imports and 5 for each of up to 4 opaque calls."""
    top = F.split("scope", r"\.")[0]
    n = F.count_distinct(F.when((F.col("kind") == "import") & ~top.isin(*known), top))
    m = F.count_if((F.col("kind") == "call") & F.col("name").isin(*opaque))
    counts = facts.groupBy(key).agg(n.alias("foreign_imports"), m.alias("opaque_calls"))
    return counts.withColumn("score", F.greatest(F.lit(0), 100 - 15 * F.least("foreign_imports", F.lit(4)) - 5 * F.least("opaque_calls", F.lit(4))))


def module_edges(facts: DataFrame, files: DataFrame, key: str = "review_id") -> DataFrame:
    """``repo``, ``src``, ``dst``: which file (by the stem of its path) imports which module, for the graph operators."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/\\\\]+)$", 1), r"\.\w+$", "")
    known = files.where("path is not null").select(key, "repo", stem.alias("src")).distinct()
    return facts.where("kind = 'import'").select(key, F.col("scope").alias("dst")).distinct().join(known, key).select("repo", "src", "dst")


def undefined_names(facts: DataFrame, key: str = "review_id") -> DataFrame:
    """``key``, ``name``, ``first_line``, ``n`` of names that are loaded but neither built in nor bound anywhere in the file (anti joins)."""
    bound = facts.where(F.col("kind").isin("store", "import", "function", "class")).select(key, "name").distinct()
    loads = facts.where((F.col("kind") == "load") & ~F.col("name").isin(*dir(builtins)))
    return loads.join(bound, [key, "name"], "left_anti").groupBy(key, "name").agg(F.min("line").alias("first_line"), F.count("*").alias("n"))


def outward_data(facts: DataFrame, network: tuple[str, ...], key: str = "review_id") -> DataFrame:
    """``key``, ``network_imports``, ``addresses``: files that import a network module or hold an address."""
    top = F.split("scope", r"\.")[0]
    counts = facts.groupBy(key).agg(F.count_if((F.col("kind") == "import") & top.isin(*network)).alias("network_imports"), F.count_if(F.col("kind") == "address").alias("addresses"))
    return counts.where("network_imports + addresses > 0")


def threat_model(facts: DataFrame, entries: tuple[str, ...], sinks: tuple[str, ...], key: str = "review_id") -> DataFrame:
    """``key``, ``entries``, ``sinks``, ``boundary``: calls that bring data in and that use it; a boundary has both."""
    calls = facts.where("kind = 'call'")
    counts = calls.groupBy(key).agg(F.count_if(F.col("name").isin(*entries)).alias("entries"), F.count_if(F.col("name").isin(*sinks)).alias("sinks"))
    return counts.where("entries + sinks > 0").withColumn("boundary", (F.col("entries") > 0) & (F.col("sinks") > 0))
