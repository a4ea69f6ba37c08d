"""Problem 3: long spans that stand verbatim in more than one record.

Method (repeated-phrase automata): every text is sampled by content-defined phrases, so that each window of ``span``
characters holds one; phrases of at least two records recur. Each shard of texts compiles its recurring phrases into
an Aho-Corasick automaton and streams its texts through it, which locates every occurrence. An exact check of the
windows around the occurrences follows, so that nothing rests on the sampled phrases alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Characters that are hashed at a time; bounds the memory of a task, not what is seen.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def _sliding(a: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """``f`` over every ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        a = f(a[:-size], a[size:])
        size *= 2
    return f(a[: len(a) - (width - size)], a[width - size :]) if size < width else a


def window_minima(pieces: list[str], span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the joined pieces: hashes of all grams, the least hash in each window of ``span``, and which windows lie in one piece."""
    codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(codes)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((codes + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    m = _sliding(h, span - gram + 1, np.minimum)
    inside = np.ones(len(m), dtype=bool)
    end = 0
    for p in pieces[:-1]:
        end += len(p)
        inside[max(0, end - span + 1) : end] = False
    return h, m, inside


def _pieces(texts: list[str | None], span: int) -> Iterator[list[tuple[int, int, str]]]:
    """Lists of ``(index of the text, offset, piece)`` of bounded length; pieces of one text overlap by ``span - 1``."""
    some, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(0, len(text or "") - span + 1), CHUNK):
            piece = text[at : at + CHUNK + span - 1]
            some.append((i, at, piece))
            size += len(piece)
            if size >= CHUNK:
                yield some
                some, size = [], 0
    if some:
        yield some


def _phrases(batches: Iterator[pa.RecordBatch], span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """``k, f, fp, pos, met``: the content-defined phrases of each text, each once with a place.

    Phrases that two keys of a batch have recur for certain: their rows are marked ``met``, and one row without a place
    stands for them all, so that a phrase of very many texts is one row a batch where phrases are compared.
    """
    width = span - gram + 1
    edge = np.zeros(width - 1, dtype=np.uint64)
    for batch in batches:
        keys = np.asarray(batch.column(0))
        rows, places, prints = [], [], []
        for some in _pieces(batch.column(2).to_pylist(), span):
            h, m, inside = window_minima([p for _, _, p in some], span, gram)
            best = np.where(inside, m, np.uint64(0))
            chosen = np.flatnonzero(_sliding(np.concatenate([edge, best, edge]), width, np.maximum) == h)
            starts = np.cumsum([0, *(len(p) for _, _, p in some[:-1])])
            of = np.searchsorted(starts, chosen, side="right") - 1
            rows.append(np.array([i for i, _, _ in some])[of])
            places.append((chosen - starts[of] + np.array([a for _, a, _ in some])[of]).astype(np.int32))
            prints.append(h[chosen].view(np.int64))
        if not rows:
            continue
        row, pos, fp = np.concatenate(rows), np.concatenate(places), np.concatenate(prints)
        order = np.lexsort((pos, row, fp))
        row, pos, fp = row[order], pos[order], fp[order]
        first = np.concatenate([[True], (fp[1:] != fp[:-1]) | (row[1:] != row[:-1])])
        row, pos, fp = row[first], pos[first], fp[first]
        groups = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
        k = keys[row]
        least, most = np.minimum.reduceat(k, groups), np.maximum.reduceat(k, groups)
        met = np.repeat(least != most, np.diff([*groups, len(fp)]))
        one = groups[least != most]
        row, pos = np.concatenate([row, row[one]]), np.concatenate([pos, np.full(len(one), -1, np.int32)])
        fp, met = np.concatenate([fp, fp[one]]), np.concatenate([met, np.ones(len(one), dtype=bool)])
        back = np.lexsort((pos, row))  # rows of one text together, which packs better
        take = pa.array(row[back])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), pa.array(fp[back]), pa.array(pos[back]), pa.array(met[back])],
            ["k", "f", "fp", "pos", "met"],
        )


def _located(batches: Iterator[pa.RecordBatch], span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """``k, f, fp, start, n, q, around``: runs of ``n`` windows around each occurrence of a recurring phrase.

    The phrases of a shard's texts go into one automaton; all its texts are streamed through it. ``around`` is the
    run's text without the phrase, which stands at its offset ``q``.
    """
    width = span - gram + 1
    for batch in batches:
        texts, places = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= 2 * CHUNK):
                size += len(texts[upto])
                upto += 1
            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for i in range(at, upto):
                for p in places[i]:
                    automaton.add_word(texts[i][p : p + gram])
            automaton.make_automaton()
            near: list[tuple[int, int, str]] = []
            hits: list[list[int]] = []
            for i in range(at, upto):
                last = len(texts[i]) - span
                stretch: list[int] = []
                for end, _ in automaton.iter(texts[i]):
                    p = end - gram + 1
                    if stretch and p - width + 1 > stretch[1] or stretch and stretch[1] - stretch[0] > CHUNK:
                        near.append((i, stretch[0], texts[i][stretch[0] : stretch[1] + span]))
                        hits.append(stretch[2:])
                        stretch = [max(stretch[1] + 1, p - width + 1), min(p, last), *stretch[-1:]] if stretch[1] - stretch[0] > CHUNK else []
                        if stretch and stretch[0] > stretch[1]:
                            stretch = []
                    if not stretch:
                        stretch = [max(0, p - width + 1), min(p, last)]
                    stretch[1] = max(stretch[1], min(p, last))
                    stretch.append(p)
                if stretch:
                    near.append((i, stretch[0], texts[i][stretch[0] : stretch[1] + span]))
                    hits.append(stretch[2:])
            out: list[tuple] = []
            while near:
                some, size = 0, 0
                while some < len(near) and (not some or size + len(near[some][2]) <= CHUNK):
                    size += len(near[some][2])
                    some += 1
                h, m, inside = window_minima([p for _, _, p in near[:some]], span, gram)
                starts = np.cumsum([0, *(len(p) for _, _, p in near[: some - 1])])
                known = [s + p - near[j][1] for j, s in enumerate(starts.tolist()) for p in hits[j] if 0 <= p - near[j][1] < len(near[j][2]) - gram + 1]
                places_of = np.unique(np.array(known, dtype=np.int64))
                ok = np.flatnonzero(inside & np.isin(m, h[places_of]))
                if len(ok):
                    of = np.searchsorted(starts, ok, side="right") - 1
                    least = _leftmost(h, m, ok, places_of)
                    new = np.concatenate([[True], (np.diff(ok) != 1) | (least[1:] != least[:-1]) | (of[1:] != of[:-1])])
                    first = np.flatnonzero(new)
                    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(ok)], strict=True):
                        i, offset, piece = near[of[a]]
                        local, q = int(ok[a] - starts[of[a]]), int(least[a] - starts[of[a]])
                        around = piece[local:q] + piece[q + gram : local + b - a + span - 1]
                        out.append((i, int(m[ok[a]].astype(np.int64)), offset + local, b - a, q - local, around))
                del near[:some], hits[:some]
            columns = list(zip(*out, strict=True)) or [()] * 6
            take = pa.array(columns[0], pa.int64())
            types = (pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c, t) for c, t in zip(columns[1:], types, strict=True))],
                ["k", "f", "fp", "start", "n", "q", "around"],
            )
            at = upto


def _leftmost(h: np.ndarray, m: np.ndarray, ok: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each window of ``ok`` the leftmost place at or behind its start that has the window's least hash."""
    out = np.full(len(ok), -1, dtype=np.int64)
    open_ones, at = np.arange(len(ok)), np.searchsorted(places, ok)
    while len(open_ones):
        place = places[np.minimum(at, len(places) - 1)]
        fits = h[place] == m[ok[open_ones]]
        out[open_ones[fits]] = place[fits]
        open_ones, at = open_ones[~fits], at[~fits] + 1
    return out


def shared_spans(
    df: DataFrame, key: str = "review_id", fields: tuple[str, ...] = ("content", "reuse"), span: int = 200, gram: int = 100
) -> DataFrame:
    """One row per maximal shared run: ``key``, ``field``, ``span_start``, ``span_len`` (code points).

    A character is shared if it lies in ``span`` consecutive characters of its field that stand, character for
    character, in a field of another key; runs that overlap or touch are one. Null, empty and short texts give no
    rows, rows with a null key neither give nor witness spans, rows delivered twice count once, and a stretch that
    only repeats within one key is not shared. ``gram`` is the length of the sampled phrases; it changes cost only.

    A phrase that many records of a batch have is one row where phrases are compared, and passages are aggregated before
    the shuffle, so that a passage that a third of all records holds is no hot group; the joins on hashes of passages rely
    on the adaptive splitting of skewed partitions.
    """
    if not 1 <= gram < span < 1 << 15:
        raise ValueError("gram must be at least 1 and less than span, span less than 32768")
    texts = (
        df.select(F.col(key).cast("long").alias("k"), *(F.col(f).cast("string").alias(f"t{i}") for i, f in enumerate(fields)))
        .where("k is not null")
        .select("k", F.posexplode(F.array(*(f"t{i}" for i in range(len(fields))))).alias("f", "text"))
        .where(F.length("text") >= span)
        .select("k", F.col("f").cast("byte").alias("f"), "text")
    )
    phrases = texts.mapInArrow(lambda b: _phrases(b, span, gram), "k long, f byte, fp long, pos int, met boolean").persist(StorageLevel.MEMORY_AND_DISK)
    # A phrase has at most one row a batch here, or is one that hardly recurs.
    alike = W.Window.partitionBy("fp")
    compared = phrases.where("not met or pos < 0").select("k", "f", "fp", "pos").withColumn(
        "again", (F.min("k").over(alike) != F.max("k").over(alike)) | (F.min("pos").over(alike) < 0)
    )
    places = phrases.where("met and pos >= 0").select("k", "f", "pos").unionByName(compared.where("again and pos >= 0").select("k", "f", "pos"))
    routes = places.groupBy("k", "f").agg(F.collect_set("pos").alias("places"))
    near = (
        texts.join(routes, ["k", "f"])
        .select("k", "f", "text", "places")
        .mapInArrow(lambda b: _located(b, span, gram), "k long, f byte, fp long, start int, n short, q short, around string")
        .withColumn("id", F.xxhash64("fp", "n", "q", "around"))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    # Exact check. Equal windows have the same least phrase, so only passages of one phrase can share a window.
    passages = (
        near.groupBy("id").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.any_value(F.struct("fp", "n", "q", "around")).alias("x"))
        .select("id", "a", "b", "x.*").persist(StorageLevel.MEMORY_AND_DISK)
    )
    whole = passages.where("a <> b").select("id", F.lit(0).alias("at"), F.col("n").cast("int").alias("upto"))
    varied = passages.groupBy("fp").agg(F.count("*").alias("v"), F.count_if(F.col("a") == F.col("b")).alias("open")).where("v > 1 and open > 0").select("fp")
    windows = (
        passages.join(varied, "fp")
        .select("id", "fp", "q", "a", "b", "around", F.explode(F.expr("sequence(0, n - 1)")).alias("at"))
        .select("id", "a", "b", "at", F.xxhash64("fp", F.col("q") - F.col("at"), F.substring("around", F.col("at") + 1, F.lit(span - gram))).alias("w"))
    )
    met = windows.groupBy("w").agg(F.min("a").alias("lo"), F.max("b").alias("hi")).where("lo <> hi").select("w")
    parts = windows.where("a = b").select("w", "id", F.col("at").cast("short").alias("at")).join(met, "w").groupBy("id").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    # Neighbouring windows of a passage become one piece: a place starts one unless its neighbour is there too.
    firsts = F.filter("ats", lambda x: ~F.array_contains("ats", (x - 1).cast("short")))
    ends = F.filter("ats", lambda x: ~F.array_contains("ats", (x + 1).cast("short")))
    pieces = parts.select("id", F.explode(F.arrays_zip(firsts.alias("lo"), ends.alias("hi"))).alias("x")).select(
        "id", F.col("x.lo").cast("int").alias("at"), (F.col("x.hi") + 1).cast("int").alias("upto")
    )
    runs = (
        near.select("k", "f", "id", "start")
        .join(whole.unionByName(pieces), "id")
        .select("k", "f", (F.col("start") + F.col("at")).alias("s"), (F.col("start") + F.col("upto") - 1 + span).alias("e"))
    )
    order = W.Window.partitionBy("k", "f").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(W.Window.unboundedPreceding, -1))
    marked = runs.withColumn("new", (before.isNull() | (F.col("s") > before)).cast("int"))
    return (
        marked.withColumn("run", F.sum("new").over(order.rowsBetween(W.Window.unboundedPreceding, 0)))
        .groupBy("k", "f", "run")
        .agg(F.min("s").cast("int").alias("span_start"), (F.max("e") - F.min("s")).cast("int").alias("span_len"))
        .select(F.col("k").alias(key), F.element_at(F.array(*map(F.lit, fields)), F.col("f").cast("int") + 1).alias("field"), "span_start", "span_len")
    )


def shared_amounts(
    df: DataFrame, key: str = "review_id", fields: tuple[str, ...] = ("content", "reuse"), span: int = 200, gram: int = 100
) -> DataFrame:
    """One row per key and field with a text: ``n_spans``, ``shared_chars``, ``n_chars`` and ``share`` (0 where nothing is shared).

    Of several texts under one key and field the longest counts for ``n_chars``; empty texts have the share 0.
    """
    spans = shared_spans(df, key, fields, span, gram).groupBy(key, "field").agg(F.count("*").alias("n_spans"), F.sum("span_len").alias("shared_chars"))
    sizes = (
        df.select(F.col(key).cast("long").alias(key), F.explode(F.create_map(*(x for f in fields for x in (F.lit(f), F.length(F.col(f)))))).alias("field", "n"))
        .where("n is not null")
        .groupBy(key, "field")
        .agg(F.max("n").alias("n_chars"))
    )
    return sizes.join(spans, [key, "field"], "left").select(
        key, "field", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), "n_chars",
        F.round(F.when(F.col("n_chars") > 0, F.coalesce("shared_chars", F.lit(0)) / F.col("n_chars")).otherwise(0.0), 6).alias("share"),
    )
