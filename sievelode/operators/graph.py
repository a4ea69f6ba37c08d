"""Graph operators on edge tables (``repo``, ``src``, ``dst``). Each repository is a graph of its own.

Fixpoints advance all graphs at once, one join a round, and cut their lineage in the shared checkpoint folder. Where a
graph must be walked as a whole (components, levels), repositories whose edges are counted to be at most ``small`` are
each solved in a task, without rounds; only larger ones take rounds. Both ways give the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelode.session import cut_lineage


def simple_edges(edges: DataFrame) -> DataFrame:
    """Distinct ``repo, src, dst`` without nulls and self edges."""
    return edges.where("src is not null and dst is not null and src <> dst").select("repo", "src", "dst").distinct()


def coupling(edges: DataFrame) -> DataFrame:
    """``repo``, ``module``, ``fan_in``, ``fan_out`` over distinct edges between modules that the repository defines."""
    own = edges.where("src is not null").select("repo", F.col("src").alias("module")).distinct()
    inner = simple_edges(edges).join(own.withColumnRenamed("module", "dst"), ["repo", "dst"], "left_semi")
    outs = inner.groupBy("repo", F.col("src").alias("module")).agg(F.count("*").alias("fan_out"))
    ins = inner.groupBy("repo", F.col("dst").alias("module")).agg(F.count("*").alias("fan_in"))
    return own.join(ins, ["repo", "module"], "left").join(outs, ["repo", "module"], "left").fillna(0, ["fan_in", "fan_out"])


def hubs(edges: DataFrame) -> DataFrame:
    """``repo``, ``seed``: the module with the greatest fan-in of each repository; of equals the first by name."""
    rank = F.struct(-F.col("fan_in"), F.col("module"))
    return coupling(edges).groupBy("repo").agg(F.min_by("module", rank).alias("seed"))


def callers(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """``repo``, ``seed``, ``caller``: the distinct direct callers of the targets (``repo``, ``seed``)."""
    return simple_edges(edges).withColumnRenamed("dst", "seed").join(targets, ["repo", "seed"]).select("repo", "seed", F.col("src").alias("caller"))


def neighbours(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """``repo``, ``seed``, ``module``, ``direction`` (``in``, ``out`` or ``both``) of what is one edge away from the targets (``repo``, ``seed``)."""
    e = simple_edges(edges)
    out = e.withColumnRenamed("src", "seed").join(targets, ["repo", "seed"]).select("repo", "seed", F.col("dst").alias("module"), F.lit(1).alias("d"))
    back = e.withColumnRenamed("dst", "seed").join(targets, ["repo", "seed"]).select("repo", "seed", F.col("src").alias("module"), F.lit(2).alias("d"))
    sums = out.unionByName(back).groupBy("repo", "seed", "module").agg(F.sum("d").alias("d"))
    return sums.select("repo", "seed", "module", F.when(F.col("d") == 3, "both").when(F.col("d") == 2, "in").otherwise("out").alias("direction"))


def layer_direction(edges: DataFrame, src_layer: Column, dst_layer: Column) -> DataFrame:
    """``repo``, ``src``, ``dst``, ``from_layer``, ``to_layer``, ``direction``: ``same``, ``down``, ``up`` (a violation), or ``unlayered`` where a layer is -1."""
    rows = simple_edges(edges).select("repo", "src", "dst", src_layer.alias("from_layer"), dst_layer.alias("to_layer"))
    a, b = F.col("from_layer"), F.col("to_layer")
    return rows.withColumn("direction", F.when((a < 0) | (b < 0), "unlayered").when(a == b, "same").when(b < a, "down").otherwise("up"))


def path_lengths(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """``repo``, ``src``, ``dst``, ``steps`` of each pair of ``ends`` (``repo``, ``src``, ``dst``): the shortest way, 0 to itself, -1 without one."""
    met = reach(edges, ends.select("repo", F.col("src").alias("seed")).distinct()).select("repo", F.col("seed").alias("src"), F.col("module").alias("dst"), "depth")
    return ends.join(met, ["repo", "src", "dst"], "left").select("repo", "src", "dst", F.when(F.col("src") == F.col("dst"), 0).otherwise(F.coalesce("depth", F.lit(-1))).cast("int").alias("steps"))


def affected_tests(edges: DataFrame, changed: DataFrame, is_test: Column, max_depth: int | None = 10) -> DataFrame:
    """``repo``, ``test``, ``steps``: the test modules that depend on a changed module (``repo``, ``module``) over at most ``max_depth`` edges.

    ``is_test`` is a condition on the column ``module``. A changed test is affected itself (0 steps); tests that nothing
    links to a change are left out. Whole graphs are seen as one: a marker module stands before all that changed, so each
    repository is walked once, however much of it changed.
    """
    marker = F.lit("\0changed")
    first = changed.where("module is not null").select("repo", "module").distinct()
    e = simple_edges(edges).select("repo", "src", "dst").unionByName(first.select("repo", F.col("module").alias("src"), marker.alias("dst")))
    seeds = first.select("repo", marker.alias("seed")).distinct()
    met = reach(e, seeds, reverse=True, max_depth=None if max_depth is None else max_depth + 1)
    return met.where(is_test).select("repo", F.col("module").alias("test"), (F.col("depth") - 1).cast("int").alias("steps"))


def _walks(batches: Iterator[pa.RecordBatch], max_depth: int | None) -> Iterator[pa.RecordBatch]:
    """Breadth first from every seed of each repository (a row with its steps and seeds): what is met, with its depth."""
    for batch in batches:
        rows = []
        for repo, steps, seeds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            after: dict[str, list[str]] = {}
            for step in steps:
                after.setdefault(step["module"], []).append(step["next"])
            for seed in seeds:
                met, now, depth = {seed}, [seed], 0
                while now and (max_depth is None or depth < max_depth):
                    depth += 1
                    now = list(dict.fromkeys(b for a in now for b in after.get(a, ()) if b not in met))
                    met.update(now)
                    rows += [(repo, seed, b, depth) for b in now]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        types = (pa.string(), pa.string(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["repo", "seed", "module", "depth"])


def reach(edges: DataFrame, seeds: DataFrame, reverse: bool = False, max_depth: int | None = None, small: int = 20_000_000) -> DataFrame:
    """``repo``, ``seed``, ``module``, ``depth``: everything that the seeds reach, by the shortest way.

    Breadth first; the seed itself is not given. Cycles end, since only modules not met before go on. ``max_depth`` is
    for queries that ask for a number of steps. A repository whose edges times seeds are counted to be at most ``small``
    is walked in a task; all others take rounds together.
    """
    e = simple_edges(edges)
    step = e.select("repo", F.col("dst" if reverse else "src").alias("module"), F.col("src" if reverse else "dst").alias("next"))
    step, seeds = cut_lineage(step), cut_lineage(seeds.select("repo", "seed").distinct())
    sizes = step.groupBy("repo").agg(F.count("*").alias("n")).join(seeds.groupBy("repo").agg(F.count("*").alias("m")), "repo")
    large = cut_lineage(sizes.where(F.col("n") * F.col("m") > small).select("repo"))
    steps_here = step.join(large, "repo", "left_anti").groupBy("repo").agg(F.collect_list(F.struct("module", "next")).alias("steps"))
    seeds_here = seeds.join(large, "repo", "left_anti").groupBy("repo").agg(F.collect_list("seed").alias("seeds"))
    both = steps_here.join(seeds_here, "repo").select("repo", "steps", "seeds")  # each within the bound
    whole = both.mapInArrow(lambda b: _walks(b, max_depth), "repo string, seed string, module string, depth int")
    if large.isEmpty():
        return whole
    step, seeds = (cut_lineage(df.join(large, "repo", "left_semi")) for df in (step, seeds))
    met = cut_lineage(seeds.select("repo", "seed", F.col("seed").alias("module"), F.lit(0).alias("depth")))
    frontier = met
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = frontier.join(step, ["repo", "module"]).select("repo", "seed", F.col("next").alias("module")).distinct()
        frontier = cut_lineage(new.join(met.select("repo", "seed", "module"), ["repo", "seed", "module"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        met = met.unionByName(frontier)  # each part is written, so the union has no long lineage
        if depth % 16 == 0:  # nor many parts
            met = cut_lineage(met.repartition("repo", "module"))
    return whole.unionByName(met.where("depth > 0"))


def _spread(labels: DataFrame, step: DataFrame) -> DataFrame:
    """Least label that reaches each module along ``step`` (``repo, module, next``), to the fixpoint.

    Three steps are taken before the lineage is cut and the labels are compared with those before. Labels only fall.
    """
    while True:
        new = labels
        for _ in range(3):
            sent = new.join(step, ["repo", "module"]).select("repo", F.col("next").alias("module"), "label")
            new = new.unionByName(sent).groupBy("repo", "module").agg(F.min("label").alias("label"))
        new = cut_lineage(new)
        if new.join(labels.withColumnRenamed("label", "old"), ["repo", "module"]).where("label <> old").isEmpty():
            return new
        labels = new


def _grow(found: DataFrame, step: DataFrame) -> DataFrame:
    """All modules that ``found`` (``repo, module, label``) reaches along ``step``, each with its label, to the fixpoint."""
    n = -1
    while True:
        for _ in range(3):
            sent = found.join(step, ["repo", "module"]).select("repo", F.col("next").alias("module"), "label")
            found = found.unionByName(sent).distinct()
        found = cut_lineage(found)
        n, before = found.count(), n
        if n == before:
            return found


def _trim(e: DataFrame) -> DataFrame:
    """The edges without those before, behind and beside all cycles: modules without callers or calls go until none is left.

    Three layers are taken off before the lineage is cut; long chains cost no colouring this way.
    """
    n = e.count()
    while n:
        for _ in range(3):
            both = e.select("repo", F.col("src").alias("module")).intersect(e.select("repo", F.col("dst").alias("module")))
            e = e.join(both.withColumnRenamed("module", "src"), ["repo", "src"], "left_semi").join(both.withColumnRenamed("module", "dst"), ["repo", "dst"], "left_semi")
        e = cut_lineage(e)
        n, before = e.count(), n
        if n == before:
            break
    return e


def _by_size(edges: DataFrame, small: int) -> tuple[DataFrame, DataFrame | None]:
    """The simple edges of repositories with at most ``small`` of them, and those of the others (None if there are none)."""
    e = cut_lineage(simple_edges(edges))
    sizes = cut_lineage(e.groupBy("repo").agg(F.count("*").alias("n")))
    large = sizes.where(F.col("n") > small).select(F.col("repo").alias("r"))
    if large.isEmpty():
        return e, None
    same = F.col("repo").eqNullSafe(F.col("r"))
    return e.join(large, same, "left_anti"), cut_lineage(e.join(large, same, "left_semi"))


def _neighbours(frame: pd.DataFrame) -> tuple[list[str], list[list[int]]]:
    """Names in order and the places of each one's successors."""
    codes, names = pd.factorize(pd.concat([frame["src"], frame["dst"]]), sort=True)
    after: list[list[int]] = [[] for _ in names]
    for a, b in zip(codes[: len(frame)].tolist(), codes[len(frame) :].tolist(), strict=True):
        after[a].append(b)
    return list(names), after


def _rings(frame: pd.DataFrame) -> pd.DataFrame:
    """Strongly connected components of one repository: two walks in depth, the second against the edges."""
    names, after = _neighbours(frame)
    before: list[list[int]] = [[] for _ in names]
    for a, targets in enumerate(after):
        for b in targets:
            before[b].append(a)

    def walk(start: int, steps: list[list[int]], met: list[bool]) -> list[int]:
        """What is met from ``start``, each after everything that it leads to."""
        done, stack = [], [(start, iter(steps[start]))]
        met[start] = True
        while stack:
            at, rest = stack[-1]
            for b in rest:
                if not met[b]:
                    met[b] = True
                    stack.append((b, iter(steps[b])))
                    break
            else:
                done.append(at)
                stack.pop()
        return done

    met, order = [False] * len(names), []
    for a in range(len(names)):
        if not met[a]:
            order += walk(a, after, met)
    met, rows = [False] * len(names), []
    for a in reversed(order):
        if not met[a]:
            ring = walk(a, before, met)
            if len(ring) > 1:
                rows += [(names[b], names[min(ring)]) for b in ring]
    out = pd.DataFrame(rows, columns=["module", "component"], dtype=object)
    out.insert(0, "repo", frame["repo"].iloc[0])
    return out


def _layers(frame: pd.DataFrame) -> pd.DataFrame:
    """Levels of one repository: what has no open callers is placed, layer by layer."""
    names, after = _neighbours(frame)
    open_callers, level = [0] * len(names), [-1] * len(names)
    for targets in after:
        for b in targets:
            open_callers[b] += 1
    now = [a for a, n in enumerate(open_callers) if not n]
    depth = 0
    while now:
        following = []
        for a in now:
            level[a] = depth
            for b in after[a]:
                open_callers[b] -= 1
                if not open_callers[b]:
                    following.append(b)
        now, depth = following, depth + 1
    return pd.DataFrame({"repo": frame["repo"].iloc[0], "module": names, "level": level})


def components(edges: DataFrame, small: int = 200_000) -> DataFrame:
    """Strongly connected components of two or more modules: ``repo``, ``module``, ``component`` (its least module).

    Large repositories by colouring: every module takes the least name that reaches it; those that reach this name
    backwards within its colour are the name's component. Settled modules leave the graph, and the rest is coloured again.
    """
    lesser, e = _by_size(edges, small)
    whole = lesser.groupBy("repo").applyInPandas(_rings, "repo string, module string, component string")
    if e is None:
        return whole
    settled = None
    while True:
        e = _trim(e)
        if e.isEmpty():
            break
        modules = e.select("repo", F.col("src").alias("module")).union(e.select("repo", F.col("dst").alias("module"))).distinct()
        forward = e.select("repo", F.col("src").alias("module"), F.col("dst").alias("next"))
        colour = _spread(modules.withColumn("label", F.col("module")), cut_lineage(forward))
        inside = (
            e.join(colour.select("repo", F.col("module").alias("src"), F.col("label").alias("a")), ["repo", "src"])
            .join(colour.select("repo", F.col("module").alias("dst"), F.col("label").alias("b")), ["repo", "dst"])
            .where("a = b")
        )
        back = cut_lineage(inside.select("repo", F.col("dst").alias("module"), F.col("src").alias("next")))
        found = _grow(colour.where("module = label"), back)
        settled = found if settled is None else settled.unionByName(found)
        gone = found.select("repo", "module")
        e = cut_lineage(
            e.join(gone.withColumnRenamed("module", "src"), ["repo", "src"], "left_anti").join(gone.withColumnRenamed("module", "dst"), ["repo", "dst"], "left_anti")
        )
    if settled is None:
        return whole
    sizes = settled.groupBy("repo", "label").agg(F.count("*").alias("n")).where("n > 1")
    return whole.unionByName(settled.join(sizes, ["repo", "label"], "left_semi").select("repo", "module", F.col("label").alias("component")))


def levels(edges: DataFrame, small: int = 200_000) -> DataFrame:
    """``repo``, ``module``, ``level``: the longest way from a module without callers; -1 on and behind cycles.

    In large repositories all modules whose callers are placed are placed in one round, until no more can be placed.
    """
    lesser, e = _by_size(edges, small)
    whole = lesser.groupBy("repo").applyInPandas(_layers, "repo string, module string, level int")
    if e is None:
        return whole
    left = cut_lineage(e.select("repo", F.col("src").alias("module")).union(e.select("repo", F.col("dst").alias("module"))).distinct())
    placed, level = None, 0
    while True:
        ready = cut_lineage(left.join(e.select("repo", F.col("dst").alias("module")).distinct(), ["repo", "module"], "left_anti"))
        if ready.isEmpty():
            break
        now = ready.withColumn("level", F.lit(level))
        level += 1
        placed = now if placed is None else placed.unionByName(now)
        if level % 16 == 0:
            placed = cut_lineage(placed.repartition("repo", "module"))
        left = cut_lineage(left.join(ready, ["repo", "module"], "left_anti"))
        e = cut_lineage(e.join(ready.withColumnRenamed("module", "src"), ["repo", "src"], "left_anti"))
    rest = left.withColumn("level", F.lit(-1))
    return whole.unionByName(rest if placed is None else placed.unionByName(rest))
