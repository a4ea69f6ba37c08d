"""Data flows in Python sources: def-use edges of each function, and what outside data reaches along them.

A file is parsed where it is read and gives plain rows; sources, propagation and sinks are relational.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelode.functions.languages import family
from sievelode.operators import graph

# ---- fixed values: entries of outside data, dangerous calls, names that tell outside data ----

SOURCES = (
    "input", "raw_input", "getpass", "os.environ.get", "os.getenv", "sys.argv", "request.args.get", "request.form.get", "request.json.get",
    "request.cookies.get", "request.headers.get", "flask.request", "get_param", "json.loads", "read", "open", "urlopen", "requests.get",
)
SINKS = (
    "eval", "exec", "compile", "os.system", "os.popen", "os.spawn", "subprocess.Popen", "subprocess.run", "subprocess.call", "subprocess.check_call",
    "cursor.execute", "execute", "pickle.loads", "pickle.load", "yaml.load", "open", "os.remove", "os.rename", "requests.get", "urlopen", "render_template_string",
)
ENTRY_PARAMETERS = ("request", "req", "data", "payload", "body", "params", "query", "user_input", "cmd", "url", "name", "path", "content", "text", "value", "filename")
NAMED_SOURCES = (
    "request", "input", "argv", "args", "query", "params", "data", "payload", "body", "headers", "env", "environ", "user_input", "username", "password",
    "token", "command", "cmd", "url", "path", "file", "content", "text", "raw", "json", "xml", "form", "cookie",
)
NAMED_SINKS = (
    ("eval", "critical"), ("exec", "critical"), ("__import__", "high"), ("os.system", "critical"), ("subprocess.call", "high"), ("subprocess.run", "high"),
    ("subprocess.Popen", "high"), ("pickle.loads", "high"), ("yaml.load", "high"), ("compile", "medium"),
)
#: Words of a finding's title and the sinks that they speak of.
TITLE_SINKS = (
    ("shell|command", ("os.system", "os.popen", "subprocess.Popen", "subprocess.run")), ("query|sql|injection", ("cursor.execute", "execute")),
    ("eval|exec", ("eval", "exec")), ("deserial", ("pickle.loads", "pickle.load", "yaml.load")), ("ssrf|url|redirect", ("requests.get", "urlopen")),
)


def _dotted(node: ast.AST) -> str:
    """The name that is called: ``a``, ``a.b.c``, or the attributes alone where the object is no name."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


def _names(node: ast.AST) -> set[str]:
    """Names whose value is part of the expression's: not those that are only called."""
    called = {id(x.func) for x in ast.walk(node) if isinstance(x, ast.Call) and isinstance(x.func, ast.Name)}
    return {x.id for x in ast.walk(node) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load) and id(x) not in called}


def _own(node: ast.AST) -> Iterator[ast.AST]:
    """All nodes of a function but those of functions within it."""
    for child in ast.iter_child_nodes(node):
        yield child
        if not isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda):
            yield from _own(child)


def _flow_rows(tree: ast.AST) -> Iterator[tuple[str, str, str, str, int]]:
    """``(function, kind, a, b, line)``: parameters, assignments from calls and from names, calls and their arguments."""
    functions = [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    for f in functions:
        scope = f"{f.name}@{f.lineno}"
        for a in [*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs, *filter(None, (f.args.vararg, f.args.kwarg))]:
            yield scope, "parameter", a.arg, "", f.lineno
        for node in _own(f):
            line = getattr(node, "lineno", 0)
            value = getattr(node, "value", None)
            if isinstance(node, ast.Assign | ast.AnnAssign | ast.AugAssign | ast.NamedExpr) and value is not None:
                targets = node.targets if isinstance(node, ast.Assign) else [node.target]
                for t in {x.id for t in targets for x in ast.walk(t) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store)}:
                    yield scope, "store", t, "", line
                    for call in {_dotted(x.func) for x in ast.walk(value) if isinstance(x, ast.Call)}:
                        yield scope, "from-call", t, call, line
                    for name in _names(value):
                        yield scope, "from-name", t, name, line
            elif isinstance(node, ast.For | ast.AsyncFor):
                for t in {x.id for x in ast.walk(node.target) if isinstance(x, ast.Name)}:
                    yield scope, "store", t, "", line
                    for name in _names(node.iter):
                        yield scope, "from-name", t, name, line
            elif isinstance(node, ast.Call) and (name := _dotted(node.func)):
                yield scope, "call", name, "", line
                for argument in [*node.args, *(k.value for k in node.keywords)]:
                    for used in _names(argument):
                        yield scope, "argument", name, used, line
                    for inner in {_dotted(x.func) for x in ast.walk(argument) if isinstance(x, ast.Call)}:
                        yield scope, "nested", name, inner, line


def flow_facts(df: DataFrame, key: str = "review_id", text: str = "content", lang: str = "lang", path: str = "path") -> DataFrame:
    """``key``, ``scope`` (function and its line), ``kind``, ``a``, ``b``, ``line`` of the functions of all Python files.

    Python files are told by ending, else language, else text. Null, empty and broken files give no rows; rows
    delivered twice give theirs once.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple] = []
            for k, source, said, at in zip(frame["k"], frame["t"], frame["l"], frame["p"], strict=True):
                if not source or family(said, at, source) != "py":
                    continue
                try:
                    out += [(k, *row) for row in _flow_rows(ast.parse(source.lstrip("\ufeff")))]
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
            yield pd.DataFrame(out, columns=["k", "scope", "kind", "a", "b", "line"])

    rows = df.select(F.col(key).cast("long").alias("k"), *(F.col(c).cast("string").alias(n) for c, n in ((text, "t"), (lang, "l"), (path, "p")))).where("t is not null")
    return rows.mapInPandas(parse, "k long, scope string, kind string, a string, b string, line int").withColumnRenamed("k", key).distinct()


def _is(call: str, names: tuple[str, ...]) -> Column:
    """Whether a dotted call is one of the names, in full or by its last parts (``db.cursor.execute`` is ``cursor.execute``)."""
    exact = F.coalesce(F.col(call).isin(*names), F.lit(False)) if names else F.lit(False)
    for n in names:
        exact = exact | F.col(call).endswith(f".{n}")
    return exact


def taint_flows(facts: DataFrame, key: str = "review_id", sources: tuple[str, ...] = SOURCES, sinks: tuple[str, ...] = SINKS) -> DataFrame:
    """``key``, ``scope``, ``line``, ``sink``, ``distance``: calls of a sink that outside data reaches.

    Outside data enters by a parameter with a telling name or by a source's result, and goes on along assignments, over
    any number of names (``distance`` assignments; 0 where the source is the argument itself).
    """
    entry = (
        facts.where((F.col("kind") == "parameter") & F.col("a").isin(*ENTRY_PARAMETERS) | (F.col("kind") == "from-call") & _is("b", sources))
        .select(key, "scope", F.col("a").alias("name")).distinct()
    )
    home = F.col(key).cast("string")  # a file is a graph whose nodes are the names of its functions
    node = lambda name: F.concat_ws("\n", "scope", name)
    edges = facts.where("kind = 'from-name'").select(home.alias("repo"), node("b").alias("src"), node("a").alias("dst"))
    begin = entry.select(home.alias("repo"), node("name").alias("seed"))
    reached = graph.reach(edges, begin)
    tainted = begin.select("repo", F.col("seed").alias("node"), F.lit(1).alias("distance")).unionByName(reached.select("repo", F.col("module").alias("node"), (F.col("depth") + 1).alias("distance")))
    tainted = tainted.groupBy("repo", "node").agg(F.min("distance").alias("distance"))
    used = facts.where((F.col("kind") == "argument") & _is("a", sinks)).select(key, "scope", "line", F.col("a").alias("sink"), home.alias("repo"), node("b").alias("node"))
    through = used.join(tainted, ["repo", "node"]).select(key, "scope", "line", "sink", "distance")
    direct = facts.where((F.col("kind") == "nested") & _is("a", sinks) & _is("b", sources)).select(key, "scope", "line", F.col("a").alias("sink"), F.lit(0).alias("distance"))
    return through.unionByName(direct).groupBy(key, "scope", "line", "sink").agg(F.min("distance").cast("int").alias("distance"))


def named_flows(facts: DataFrame, key: str = "review_id") -> DataFrame:
    """``key``, ``scope``, ``line``, ``sink``, ``severity``: calls of a sink with a name of the function, where the function has a name that tells outside data.

    A name tells it if it is a word of ``NAMED_SOURCES``, or begins or ends with one and an underscore. One row per function, sink and line.
    """
    low = F.lower("a")
    tells = low.isin(*NAMED_SOURCES)
    for n in NAMED_SOURCES:
        tells = tells | low.endswith(f"_{n}") | low.startswith(f"{n}_")
    named = facts.where(F.col("kind").isin("parameter", "store"))
    telling = named.where(tells).select(key, "scope").distinct()
    own = named.where((F.col("kind") == "store") | tells).select(key, "scope", F.col("a").alias("b")).distinct()
    severity = F.create_map(*(F.lit(x) for pair in NAMED_SINKS for x in pair))
    used = facts.where((F.col("kind") == "argument") & F.col("a").isin(*(n for n, _ in NAMED_SINKS)))
    rows = used.join(telling, [key, "scope"], "left_semi").join(own, [key, "scope", "b"], "left_semi")
    return rows.select(key, "scope", "line", F.col("a").alias("sink"), severity[F.col("a")].alias("severity")).distinct()


def learned_sinks(flows: DataFrame, key: str = "review_id", least: int = 2) -> DataFrame:
    """``sink``, ``n_files``: sinks (by their last part) in which flows end in at least ``least`` files; what is learned from earlier reviews."""
    last = F.element_at(F.split("sink", r"\."), -1)
    return flows.groupBy(last.alias("sink")).agg(F.count_distinct(key).alias("n_files")).where(F.col("n_files") >= least)


def sink_verdicts(facts: DataFrame, flows: DataFrame, learned: DataFrame, sinks: tuple[str, ...] = SINKS, doubtful: tuple[str, ...] = (), key: str = "review_id") -> DataFrame:
    """``key``, ``line``, ``sink``, ``verdict``, ``evidence``: each call of a sink is taken for harmless until shown.

    ``confirmed`` where a flow ends on its line or its sink is a learned one (evidence ``learned`` or ``flow``, the rule
    first), ``needs_review`` for other calls of ``sinks``, ``likely_fp`` for other calls of the ``doubtful`` names.
    """
    calls = facts.where((F.col("kind") == "call") & (_is("a", sinks) | _is("a", doubtful))).select(key, "line", F.col("a").alias("sink")).distinct()
    by_line = flows.select(key, "line", F.lit(True).alias("flow")).distinct()
    rules = learned.select(F.col("sink").alias("last"), F.lit(True).alias("rule")).distinct()
    rows = calls.withColumn("last", F.element_at(F.split("sink", r"\."), -1)).join(by_line, [key, "line"], "left").join(rules, "last", "left")
    evidence = F.when(F.col("rule"), "learned").when(F.col("flow"), "flow").when(_is("sink", sinks), "call").otherwise("none")
    verdict = F.when(F.col("rule") | F.col("flow"), "confirmed").when(_is("sink", sinks), "needs_review").otherwise("likely_fp")
    return rows.select(key, "line", "sink", verdict.alias("verdict"), evidence.alias("evidence"))


def adversarial(findings: DataFrame, flows: DataFrame, facts: DataFrame, key: str = "review_id", order: str = "ord") -> DataFrame:
    """``key``, ``order``, ``outcome`` of each finding (columns ``title``, ``line``, ``severity``): a finding is false until shown.

    ``confirmed`` where a flow ends on its line or in a sink that its title speaks of, ``needs_review`` where such a sink is only
    called, ``likely_fp`` else; findings that are neither critical nor major stay ``static``. Flows and calls are
    aggregated to one row a file, line or sink before they are joined.
    """
    places = facts.where((F.col("kind") == "call") & _is("a", SINKS)).select(key, "line", F.col("a").alias("sink"), F.lit(1).alias("rank"))
    places = places.unionByName(flows.select(key, "line", "sink", F.lit(2).alias("rank")))
    by_line = places.groupBy(key, "line").agg(F.max("rank").alias("at_line"))
    spoken = F.array(*(F.when(F.lower("title").rlike(words), F.array(*map(F.lit, sinks))) for words, sinks in TITLE_SINKS))
    kinds = F.flatten(F.array_compact(spoken))
    short = F.lit(None).cast("string")
    for n in sorted({n for _, names in TITLE_SINKS for n in names}, key=len):
        short = F.when(_is("sink", (n,)), n).otherwise(short)
    by_sink = places.select(key, short.alias("s"), "rank").where("s is not null").groupBy(key, "s").agg(F.max("rank").alias("rank")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("s", "rank"))).alias("sinks"))
    rows = findings.withColumn("kinds", kinds).join(by_line, [key, "line"], "left").join(by_sink, key, "left")
    at_sink = F.array_max(F.transform("kinds", lambda s: F.element_at("sinks", s)))
    best = F.greatest(F.coalesce("at_line", F.lit(0)), F.coalesce(at_sink, F.lit(0)))
    severe = F.coalesce(F.regexp_replace(F.lower("severity"), "[^a-z]", "").isin("critical", "major"), F.lit(False))
    outcome = F.when(~severe, "static").when(best == 2, "confirmed").when(best == 1, "needs_review").otherwise("likely_fp")
    return rows.select(key, order, outcome.alias("outcome"))
