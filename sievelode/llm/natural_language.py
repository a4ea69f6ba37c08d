"""Problem 5: natural language in the comments and string literals of source files.

Method: the lexer's state-transition function of every chunk of a file is computed on its own, the functions are
composed in chunk order (each prefix gives the start state of the next chunk), so that huge files are split safely.
The spans found are labelled by multinomial logistic regression on hashed n-grams, trained on labelled documents; a
phrase that no language claims clearly is none.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sievelode.llm.lexing import BACKTICK, CODE, LINE, STATES, context_of, cuts_of, family, lex

#: Letters of scripts that are written without spaces between words.
DENSE = r"぀-ヿ㐀-䶿一-鿿豈-﫿"
_DENSE = re.compile(f"[{DENSE}]")
_WORDS = re.compile(rf"[{DENSE}]+|[฀-๿]+|[^\W\d_{DENSE}฀-๿]+(?:['’][^\W\d_]+)*")
#: What is not language: addresses, paths, calls, identifiers, formats, tags, code in backquotes.
_NOISE = re.compile(
    r"\b(?:TODO|FIXME|XXX|HACK|TBD|NOTE)\b:?|https?://\S+|www\.\S+|\S+@\S+|\{@?\w+[^}]*\}|</?\w[^>]*>|`[^`]*`|%\(?\w*\)?[sdfr]|:\w+ \w+:|(?<!\S)[@\\]\w+"
    r"|[A-Za-z0-9_.$-]*[A-Za-z0-9$]_[A-Za-z0-9_.$]*(?:\([^)]*\))?|\b\w+(?:\.\w+)*\([^)]*\)|\b[a-z]+[A-Z]\w*|\b[A-Z][a-z]+[A-Z]\w*"
    r"|(?<!\w)[.~]?/?(?:[\w.-]+[/\\])+[\w.-]*|\b\w+\.(?:py|js|go|java|json|ya?ml|toml|md|txt|csv|html?|sh|conf|cfg)\b|(?<!\S)--?\w[\w-]*(?:=\S+)?|\b\w*\d\w*\b"
)
_SQL = re.compile(
    r"(?is)^\W*(?:select\b.+\bfrom\b|insert\s+into\b|update\s+\S+\s+set\b|delete\s+from\b|(?:create|alter|drop)\s+(?:table|index|view|database)\b|with\s+\w+\s+as\s*\()"
)
_COMMAND = re.compile(
    r"^\W*(?:sudo |\$ )?(?:curl|wget|git|docker|kubectl|pip3?|npm|yarn|npx|apt(?:-get)?|mysql(?:dump)?|psql|ssh|scp|rsync|tar|grep|sed|awk|find|chmod|chown|make|go|java|python3?|node|export|echo|cd|ls|cp|mv|rm)\s+(?:-|\S*[/=.@:]|[a-z]+ -)"
)
_CODE_MARKS = re.compile(r"[{}\[\];=<>|&+*\\^~$]|\(\)|==|->|::")
_ESCAPES = re.compile(r"\\(?:u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|([\s\S]))")
_DECORATION = re.compile(r"^[\s*#/!\-=~_+|>]+|[\s*#/\-=~_+|]+$")
_CONTROL = {"n": "\n", "t": "\t", "r": "\n", "0": "", "b": "", "f": "\n"}


def _unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[4] is not None:
            return _CONTROL.get(m[4], m[4])
        code = int(m[1] or m[2] or m[3], 16)
        return chr(code) if code < 0x110000 else " "

    out = _ESCAPES.sub(one, text)
    if any("\ud800" <= c <= "\udfff" for c in out):  # escaped pairs stand for one letter
        out = out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return out


def words_of(line: str) -> list[str]:
    """The natural-language words of a line, without identifiers, addresses, paths, formats and tags."""
    return _WORDS.findall(_NOISE.sub(" ", line))


def is_phrase(line: str, words: list[str]) -> bool:
    """At least five words (eight characters of a dense script), and neither SQL nor a command nor code."""
    dense = sum(len(w) for w in words if _DENSE.match(w))
    thai = sum(len(w) for w in words if "฀" <= w[0] <= "๿")
    if dense >= 8:
        return True
    plain = sum(len(w) > 1 or w in "aàyoeiиявск" for w in words)
    if plain < 5 and thai < 20:
        return False
    if _SQL.match(line) or _COMMAND.match(line):
        return False
    return len(_CODE_MARKS.findall(line)) * 4 <= plain + 3


Span = tuple[int, str, bool, int]


def spans_of(text: str, tokens: list[tuple[int, int, int, int]], at: int = 0) -> list[Span]:
    """``(state, text, whether only blanks part it from the one before, line breaks there)`` of each comment and literal from ``at`` on."""
    out: list[Span] = []
    for state, start, inner, end in tokens:
        gap = text[at:start]
        out.append((state, text[inner:end], not gap.strip(), gap.count("\n")))
        at = end
    return out


def phrases_of(spans: list[Span], fam: str) -> Iterator[tuple[str, list[str], int]]:
    """``(line, words, characters in the file)`` of each phrase in the comments and literals.

    Line comments on neighbouring lines are one comment. A line that breaks off is read together with the next.
    """
    groups: list[tuple[int, list[str]]] = []
    before = CODE
    for state, body, blank, breaks in spans:
        if state == before == LINE and blank and breaks == 1:
            groups[-1][1].append(body)
        else:
            groups.append((state, [body]))
        before = state
    for state, bodies in groups:
        body = "\n".join(bodies)
        if len(body) < 8:
            continue
        if state > 2 and "\\" in body and not (fam == "go" and state == BACKTICK):
            body = _unescape(body)
        held, held_words = "", []
        for raw in body.split("\n"):
            line = _DECORATION.sub("", raw)
            if not line:
                if held_words and is_phrase(held, held_words):
                    yield held, held_words, len(held)
                held, held_words = "", []
                continue
            words = words_of(line)
            if held_words:
                if line[:1].islower() or _DENSE.match(line[:1]) and not is_phrase(held, held_words):
                    line, words = f"{held} {line}", held_words + words
                elif is_phrase(held, held_words):
                    yield held, held_words, len(held)
            if line[-1:] in ".!?。！？।…:" or not words:
                if words and is_phrase(line, words):
                    yield line, words, len(line)
                held, held_words = "", []
            else:
                held, held_words = line, words
        if held_words and is_phrase(held, held_words):
            yield held, held_words, len(held)


# ---- the language model ----


class LanguageModel:
    """Multinomial logistic regression over hashed n-grams (one to four letters with word ends, and whole words).

    ``margin`` is the lead over the second language that a phrase must have; with less it is no language.
    """

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, margin: float = 0.0) -> None:
        self.languages, self.weights, self.bias, self.margin = languages, weights, bias, margin
        self._ids: dict[str, int] = {}
        self._rows: list[np.ndarray] = []

    def __getstate__(self):
        return self.languages, self.weights, self.bias, self.margin

    def __setstate__(self, state):
        self.__init__(*state)

    @staticmethod
    def grams(word: str, dims: int) -> list[int]:
        w = f"<{word.lower()}>"
        n = len(w)
        return [zlib.crc32(w[i : i + k].encode()) % dims for k in (1, 2, 3, 4) for i in range(n - k + 1)] + [zlib.crc32(f"={w}".encode()) % dims]

    def _vector(self, word: str) -> int:
        at = self._ids.get(word)
        if at is None:
            at = self._ids[word] = len(self._rows)
            self._rows.append(self.weights[self.grams(word, len(self.weights))].sum(axis=0))
        return at

    def scores(self, phrases: list[list[str]]) -> np.ndarray:
        """Scores of each list of words by language: the mean over its words."""
        if len(self._ids) > 200_000:  # words seen so far; emptied to bound the memory
            self._ids.clear()
            self._rows.clear()
        ids = [self._vector(w) for words in phrases for w in words]
        starts = np.cumsum([0, *(len(w) for w in phrases[:-1])])
        return np.add.reduceat(np.stack(self._rows)[ids], starts, axis=0) / np.array([[len(w)] for w in phrases]) + self.bias

    def label(self, phrases: list[list[str]]) -> list[str | None]:
        """The likeliest language of each list of words; None where its lead is too small."""
        if not phrases:
            return []
        scores = self.scores(phrases)
        best = scores.argmax(axis=1)
        if len(self.languages) < 2:
            return [self.languages[i] for i in best]
        two = np.partition(scores, -2, axis=1)
        return [self.languages[i] if lead >= self.margin else None for i, lead in zip(best, two[:, -1] - two[:, -2], strict=True)]


def _script(words: list[str]) -> str:
    """The script of most letters: the first word of the letters' Unicode names, kana before Han."""
    letters = "".join(words)
    names = [unicodedata.name(c, "?").split(" ")[0] for c in letters[:: max(1, len(letters) // 40)]]
    if any(n in ("HIRAGANA", "KATAKANA") for n in names):
        return "KANA"
    return max(set(names), key=names.count)


def fit_languages(samples: list[tuple[str, list[str]]], dims: int = 1 << 16, steps: int = 40, penalty: float = 1e-4, part: float = 0.2) -> LanguageModel:
    """The model of labelled word lists, fitted by full-batch gradient steps; labels that the fit contradicts are then dropped once.

    Words of a single sample (names, mostly) are left out of the fit. The margin is ``part`` of the median lead of the samples.
    """
    seen = Counter(w for _, words in samples for w in set(words))
    samples = [(l, [w for w in words if seen[w] > 1] or words) for l, words in samples]
    languages = sorted({s[0] for s in samples})
    label = np.array([languages.index(s[0]) for s in samples])
    vocabulary: dict[str, int] = {}
    flat = np.array([vocabulary.setdefault(w, len(vocabulary)) for _, words in samples for w in words])
    sizes = np.array([len(words) for _, words in samples])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    grams = [LanguageModel.grams(w, dims) for w in vocabulary]
    used, gram = np.unique(np.array([g for x in grams for g in x]), return_inverse=True)
    counts_of = np.array([len(x) for x in grams])
    gram_starts = np.concatenate([[0], np.cumsum(counts_of)[:-1]])
    # Sums run over sorted keys: from samples to words, and from words to grams.
    by_word = np.argsort(flat, kind="stable")
    word_starts, sample_of = np.searchsorted(flat[by_word], np.arange(len(vocabulary))), np.repeat(np.arange(len(samples)), sizes)[by_word]
    by_gram = np.argsort(gram, kind="stable")
    use_starts, word_of = np.searchsorted(gram[by_gram], np.arange(len(used))), np.repeat(np.arange(len(grams)), counts_of)[by_gram]
    k, single = len(languages), np.float32
    keep = np.ones(len(samples), dtype=bool)
    width = sizes[:, None].astype(single)
    for cleaning in (False, True):  # the second fit drops samples whose label the first contradicts
        if cleaning:
            keep = scores.argmax(axis=1) == label  # noqa: F821
        weights, bias = np.zeros((len(used), k), single), np.zeros(k, single)
        first, second = np.zeros_like(weights), np.zeros_like(weights)
        counts = np.bincount(label[keep], minlength=k)
        importance = np.where(keep, 1.0 / np.maximum(counts, 1)[label] / k, 0.0).astype(single)[:, None]
        for step in range(1, steps + 1):
            per_word = np.add.reduceat(weights[gram], gram_starts, axis=0)
            scores = np.add.reduceat(per_word[flat], starts, axis=0) / width + bias
            e = np.exp(scores - scores.max(axis=1, keepdims=True))
            error = e / e.sum(axis=1, keepdims=True)
            error[np.arange(len(label)), label] -= 1
            error *= importance
            word_grad = np.add.reduceat((error / width)[sample_of], word_starts, axis=0)
            grad = np.add.reduceat(word_grad[word_of], use_starts, axis=0) + single(penalty) * weights
            first = single(0.9) * first + single(0.1) * grad
            second = single(0.99) * second + single(0.01) * grad * grad
            weights -= single(0.1 / (1 - 0.9**step)) * first / (np.sqrt(second / single(1 - 0.99**step)) + single(1e-8))
            bias -= single(0.5) * error.sum(axis=0)
    two = np.partition(scores, -2, axis=1) if k > 1 else np.zeros((1, 2))
    spread = np.zeros((dims, k), single)
    spread[used] = weights
    return LanguageModel(languages, spread, bias, part * float(np.median(two[:, -1] - two[:, -2])))


def train_languages(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 200) -> LanguageModel:
    """A model fitted on at most ``per_language`` labelled rows of each language (a documented bound of the sample).

    Labels are cut to their first two letters in lower case; labels with fewer rows than a twentieth of the bound and
    ``und`` are left out. The rows are those with the least hash of their text, over the whole table.
    """
    clean = F.lower(F.trim(F.col(lang)))
    rows = labelled.select(F.substring(clean, 1, 2).alias("l"), F.col(text).cast("string").alias("t")).where(
        clean.rlike("^[a-z]{2}([-_].*)?$") & F.col(text).isNotNull() & (F.length(text) >= 40)
    )
    order = W.Window.partitionBy("l").orderBy(F.xxhash64("t"), "t")
    bounded = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("l", "t")
    samples = []
    for row in sorted(bounded.collect()):
        plain = re.sub(r"```.*?(?:```|\Z)", " ", row.t, flags=re.S)
        for paragraph in re.split(r"\n\s*\n", plain):
            for sentence in re.split(r"(?<=[.!?。！？।])\s*", paragraph):
                words = words_of(sentence)
                if len(words) >= 4 or any(_DENSE.match(w) and len(w) > 5 for w in words):
                    samples.append((row.l, words))
    # Documents hold paragraphs in a second language: samples in another script than most of their label are left out.
    scripts: dict[str, list[str]] = {}
    for l, words in samples:
        scripts.setdefault(l, []).append(_script(words))
    usual = {l: max(set(x), key=x.count) for l, x in scripts.items()}
    used: dict[str, int] = dict.fromkeys(usual, -1)
    kept = []
    for l, words in samples:
        used[l] += 1
        if scripts[l][used[l]] == usual[l] or usual[l] == "KANA" and scripts[l][used[l]] == "CJK":
            kept.append((l, words))
    samples = kept
    counts: dict[str, int] = {}
    for l, _ in samples:
        counts[l] = counts.get(l, 0) + 1
    samples = [s for s in samples if counts[s[0]] >= per_language / 20]
    if not samples:
        raise ValueError("no labelled rows to fit languages on")
    return fit_languages(samples)


# ---- the operator ----


_FOUND = "k long, nl string, phrases long, nl_chars long, chars long"
_PIECES = "id string, k long, part int, fam string, head string, piece string, chars long"
_SPANS = "id string, k long, part int, fam string, chars long, opened boolean, states array<int>, bodies array<string>, blanks array<boolean>, breaks array<int>, tail_blank boolean, tail_breaks int"


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _cut(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """The chunks of each file, each with what its lexer looks back upon."""
    schema = pa.schema([("id", pa.string()), ("k", pa.int64()), ("part", pa.int32()), ("fam", pa.string()), ("head", pa.string()), ("piece", pa.string()), ("chars", pa.int64())])
    for batch in batches:
        for id_, k, body, language, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            fam = family(language, place, body)
            edges = [0, *cuts_of(body, chunk, fam), len(body)]
            yield _as_batch([(id_, k, i, fam, context_of(body, a), body[a:b], len(body)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], schema)


def _lex_piece(head: str, piece: str, fam: str, state: int) -> tuple[str, list[tuple[int, int, int, int]], int, int]:
    """Text, tokens, offset of the piece in the text, and end state of a chunk that starts in ``state``."""
    if state != CODE:
        return piece, *lex(piece, fam, state), 0
    text = head + piece
    tokens, end = lex(text, fam, CODE, min(1, len(head)))
    return text, tokens, end, len(head)


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``ends``: the state function of each chunk, as the end state for every start state."""
    for batch in batches:
        columns = (batch.column(i).to_pylist() for i in (3, 4, 5))
        ends = [[_lex_piece(head, piece, fam, s)[2] for s in range(STATES)] for fam, head, piece in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.list_(pa.int32()))], [*batch.schema.names, "ends"])


def _piece_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The comments and literals of each chunk, now that its start state is known."""
    lists = (("states", pa.int32()), ("bodies", pa.string()), ("blanks", pa.bool_()), ("breaks", pa.int32()))
    schema = pa.schema([
        ("id", pa.string()), ("k", pa.int64()), ("part", pa.int32()), ("fam", pa.string()), ("chars", pa.int64()), ("opened", pa.bool_()),
        *((n, pa.list_(t)) for n, t in lists), ("tail_blank", pa.bool_()), ("tail_breaks", pa.int32()),
    ])
    for batch in batches:
        rows = []
        for id_, k, part, fam, head, piece, chars, state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text, tokens, _, at = _lex_piece(head, piece, fam, state)
            spans = spans_of(text, tokens, at)
            tail = text[tokens[-1][3] if tokens else at :]
            rows.append((id_, k, part, fam, chars, state != CODE, *([s[i] for s in spans] for i in range(4)), not tail.strip(), tail.count("\n")))
        yield _as_batch(rows, schema)


def _rejoined(rows: list[dict]) -> list[Span]:
    """The spans of a file from those of its chunks in order: what a cut parted is one again."""
    spans: list[list] = []
    blank, breaks = True, 0
    for row in rows:
        new = [list(s) for s in zip(row["states"], row["bodies"], row["blanks"], row["breaks"], strict=True)]
        if row["opened"] and new and spans:
            spans[-1][1] += new.pop(0)[1]
            blank, breaks = True, 0
        if new:
            new[0][2], new[0][3] = new[0][2] and blank, new[0][3] + breaks
            spans += new
        if row["states"]:
            blank, breaks = row["tail_blank"], row["tail_breaks"]
        else:
            blank, breaks = blank and row["tail_blank"], breaks + row["tail_breaks"]
    return [tuple(s) for s in spans]


def languages_in(
    df: DataFrame, model: LanguageModel, key: str = "review_id", text: str = "content", lang: str = "lang", path: str = "path", chunk: int = 1 << 14
) -> DataFrame:
    """One row per key and language: ``key``, ``nl_lang``, ``n_phrases``, ``nl_chars``, ``n_chars``, ``share``.

    A language counts if a comment, docstring or literal holds a phrase of at least five words (eight characters in
    Chinese or Japanese) that the model gives to it by a clear lead. Null and empty texts give no rows; files of a null
    language are told by path or text.

    A file of one chunk is lexed where it is read. Longer files are cut into chunks of about ``chunk`` characters that
    are lexed apart from every start state; the state functions are composed in order, the chunks lexed from the states
    they truly start in, and the comments and literals of a file brought together again, so that the result is the same
    for every ``chunk``. Rows of one key (null being a key too) count as one: deliveries of equal texts once, of
    different texts by the greatest count of each language.
    """
    session = df.sparkSession
    shared = session.sparkContext.broadcast(model)
    rows = df.select(F.col(key).cast("long").alias("k"), *(F.col(c).cast("string").alias(n) for c, n in ((text, "t"), (lang, "l"), (path, "p"))))
    schema = pa.schema([("k", pa.int64()), ("nl", pa.string()), *((n, pa.int64()) for n in ("phrases", "nl_chars", "chars"))])

    def tell(keys: list, found: list[tuple]) -> pa.RecordBatch:
        """Labels the phrases ``(row, words, characters, file's characters)`` and sums them by row and language."""
        labels = shared.value.label([w for _, w, _, _ in found])
        sums: dict[tuple, list] = {}
        for (row, _, n, chars), l in zip(found, labels, strict=True):
            if l is not None:
                s = sums.setdefault((row, l), [0, 0, chars])
                s[0] += 1
                s[1] += n
        return _as_batch([(keys[row], l, *s) for (row, l), s in sums.items()], schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, (body, language, place) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                fam = family(language, place, body)
                found += [(i, w, n, len(body)) for _, w, n in phrases_of(spans_of(body, lex(body, fam)[0]), fam)]
            yield tell(batch.column(0).to_pylist(), found)

    def of_file(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda r: r["part"])
        one = parts[0]
        found = [(0, w, n, one["chars"]) for _, w, n in phrases_of(_rejoined(parts), one["fam"])]
        return pa.Table.from_batches([tell([one["k"]], found)], schema)

    small = rows.where(F.length("t").between(1, chunk)).mapInArrow(whole, _FOUND)
    pieces = (
        rows.where(F.length("t") > chunk).select(F.md5(F.to_json(F.struct("k", "t", "l", "p"))).alias("id"), "k", "t", "l", "p")
        .mapInArrow(lambda b: _cut(b, chunk), _PIECES)
        .dropDuplicates(["id", "part"])  # of repeated rows; and the chunks of one file go to many tasks
        .mapInArrow(_functions, f"{_PIECES}, ends array<int>")
    )
    # The composed prefix of a chunk, applied to the state CODE, is the state in which the chunk starts.
    starts = pieces.select("id", "part", "ends").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part", "ends"))).alias("f"))
    composed = F.aggregate(
        "f",
        F.array(F.lit(CODE)),
        lambda acc, x: F.concat(acc, F.array(F.element_at(x["ends"], F.element_at(acc, -1) + 1))),
    )
    begin = starts.select("id", F.posexplode(composed).alias("part", "state"))
    large = (
        pieces.join(begin, ["id", "part"]).select("id", "k", "part", "fam", "head", "piece", "chars", "state")
        .mapInArrow(_piece_spans, _SPANS).groupBy("id").applyInArrow(of_file, _FOUND)
    )
    both = small.unionByName(large).groupBy("k", "nl").agg(F.max("phrases").alias("phrases"), F.max("nl_chars").alias("nl_chars"), F.max("chars").alias("chars"))
    return both.select(
        F.col("k").alias(key), F.col("nl").alias("nl_lang"), F.col("phrases").alias("n_phrases"), "nl_chars", F.col("chars").alias("n_chars"),
        F.round(F.least(F.lit(1.0), F.col("nl_chars") / F.col("chars")), 6).alias("share"),
    )
