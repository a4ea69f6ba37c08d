"""Problem 8: sentence units of documents in many languages and scripts.

Method: ordered pairs of break and no-break regular expressions per language; at every candidate position the first
pair that matches before and after it decides. The pairs are organised as cascading rule tables: quotation and
ellipsis rules for all, then the table of the block's language, then the default table. The language of a block is told
by its script and its function words; where they don't tell it, the rules of all languages of the script are asked.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: the rule tables. (break?, what stands before, what stands after) ----

_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĹĻĽŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽА-ЯЁІЇЄҐ"
_LOW = "a-zß-öø-ÿāăąćčďđēėęěğģīįıķĺļľłńņňōőœŕřśşšţťūůűųźżžа-яёіїєґ"
#: A word in lower case that is no identifier and no mixed-case name: the sentence goes on with it.
_PLAIN_LOW = rf"[{_LOW}][{_LOW}’']*(?![\w(]|[.]\w)"
_CASELESS = "؀-ۿऀ-ॿ぀-ヿ㐀-䶿一-鿿가-힣"
_CLOSE = "\"”’»)\\]）」』】》〉“"
_MARK = ".!?…。！？．｡।॥؟۔"

Rule = tuple[bool, str, str]

#: No rule looks back on more characters than this (a test holds the rules to it).
TAIL = 48

QUOTES: tuple[Rule, ...] = (
    (False, rf"[{_MARK}]\s?[{_CLOSE}]{{1,9}}$", r"\s*[,;:，、；：،]"),
    (False, rf"[{_MARK}]\s?[{_CLOSE}]{{1,9}}$", r"\s+[—–-]\s"),
    (False, rf"[{_MARK}]\s?[{_CLOSE}]{{1,9}}$", rf"\s+{_PLAIN_LOW}"),
    (False, r"[」』]$", r"[ぁ-ゖ]"),
    (False, rf"^[\"“„«‘「『][^”»」』]*[{_CLOSE}]$", rf"\s*[{_CASELESS}]"),
    (False, rf"^[‘“\"«][^’”»]*[{_MARK}][’”\"»]$", rf"\s+[‘“\"«][^’”»\"]{{1,120}}[{_MARK}][’”\"»]\s+{_PLAIN_LOW}"),
    (False, r"(?:…|\.\.\.)$", rf"\s*(?![{_UP}\"“„«¿¡(\s]|$)"),
)


def _latin(words: dict[str, str], more: tuple[Rule, ...] = ()) -> tuple[Rule, ...]:
    """The table of a language: its words that stand before letters, anything, names, numbers and months, then what all share."""

    def before(kind: str, after: str) -> tuple[Rule, ...]:
        return ((False, rf"\b(?:{words[kind]})\.$", after),) if words.get(kind) else ()

    appendix = ((True, rf"\b(?:{words['letter']})\.?\s[A-Z]\.$", rf"\s+[{_UP}\"“(]"),) if words.get("letter") else ()
    return (
        *appendix, *before("anything", r"\s"), *more, *before("name", r"\s+\S"), *before("number", r"\s+[\[(]?\d"), *before("month", rf"\s+(?:\d|{_PLAIN_LOW})"),
        (False, r"\b(?:Inc|Ltd|Co|Corp|Jr|Sr|Bros|LLC|GmbH|al|etc|usw|vb|vs|U\.\s?S|U\.\s?K|E\.\s?U|a\.\s?m|p\.\s?m|Ph\.\s?D)\.$", rf"\s+{_PLAIN_LOW}"),
        (False, rf"(?:^|[\s(“„\"«‘])[{_UP}]\.$", rf"\s?[{_UP}]"),
        *ORDINALS * ("ordinals" in words),
        # Other short words with a full stop, and ordinals, before a word in lower case: abbreviations that no table knows.
        (False, rf"(?<![\w.])[{_LOW}{_UP}]{{1,4}}\.$|\w\.\w\.$|(?<![\w.,])\d{{1,2}}\.$", rf"\s+{_PLAIN_LOW}"),
    )


#: Numbers with a full stop behind a German article or preposition.
ORDINALS: tuple[Rule, ...] = (
    (False, r"\b(?:[IiAa]m|[Zz]um|[Vv]om|[Bb]eim|[Dd]er|[Dd]ie|[Dd]as|[Dd]en|[Dd]em|[Dd]es|[Bb]is|[Aa]b|[Ss]eit|[Jj]eder|[Jj]ede|[Jj]edes|[Ee]in|[Ee]inen|[Ee]inem)\s{1,9}\d{1,3}\.$", r"\s+\S"),
)
GERMAN: tuple[Rule, ...] = ((False, r"\bz\.$|\bZ\.$", r"\s?[BT]\."), (False, r"\b[dD]\.$", r"\s?h\."))
TURKISH: tuple[Rule, ...] = ((False, r"\b(?:ve|bkz\.|Bkz\.)\s{1,9}s\.$", r"\s+\d"),)
_SHARED = {
    "anything": r"i\.\s?e|e\.\s?g|a\.\s?k\.\s?a|cf|Cf|vs|w\.\s?r\.\s?t|viz|n\.\s?b",
    "name": "Dr|Mr|Mrs|Ms|Prof|St|Ing|Rev",
    "number": "No|Nos|Nr|no|N|Fig|fig|Figs|figs|Art|art|Vol|vol|p|pp|Ref|ref|refs|max|min|v|ver|Ver|§",
    "month": "Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec",
}
_OWN = {
    "en": {
        "letter": "App|Appx|Annex|Appendix|Plan|Phase", "anything": "ca|approx|resp|incl",
        "name": "App|Appx|Ste|Gen|Col|Capt|Lt|Sgt|Hon|Pres|Gov|Sen|Rep|Messrs|Sr",
        "number": "nr|sec|Sec|secs|ch|Ch|chap|arts|tab|Tab|Eq|eq|Eqs|S|str|Str|par|ln|lin|line", "month": "Mon|Tue|Tues|Wed|Thu|Thur|Thurs|Fri|Sat|Sun",
    },
    "de": {
        "letter": "Anh|Anl|Anhang|Plan|Phase", "anything": r"z\.\s?B|z\.\s?T|d\.\s?h|u\.\s?a|u\.\s?U|o\.\s?ä|vgl|Vgl|ca|bzw|ggf|evtl|inkl|exkl|sog|resp",
        "name": "Anh|Anl|Hr|Fr|Frl|Dipl", "number": "nr|S|Abb|Abschn|Tab|Kap|Bd|Anm|Ziff|Zeile|str|Str", "month": "Okt|Dez", "ordinals": "",
    },
    "fr": {
        "letter": "Annexe|Plan|Phase", "anything": r"p\.\s?ex|c\.-à-d|env", "name": "Mme|Mlle|MM|Me|Av", "number": "chap|sec|pag|tab|par|lin", "month": "janv|févr|avr|juil|déc",
    },
    "es": {
        "letter": "Anexo|Plan", "anything": r"p\.\s?ej|por|Por|núm|aprox", "name": "Sr|Sra|Srta|Dra|Av|Exc", "number": "núm|Núm|Nro|nro|pág|Pág|págs|cap|Cap|sec|par|lin", "month": "ene|abr|ago|dic",
    },
    "pt": {
        "letter": "Anexo|Plan", "anything": r"p\.\s?ex|p\.\s?e|por|Por|aprox|Exmo|Exma", "name": "Sr|Sra|Srta|Dra|Av|Exc|Me", "number": "núm|Núm|pág|Pág|págs|cap|Cap|sec|par|lin", "month": "abr|ago",
    },
    "pl": {"letter": "Plan", "anything": "np|tj|tzn", "name": "inż|mgr|Mgr|hab|Bn|Sn", "number": "nr|str|Str|rys|Rys|tab|tabl|rozdz|ryc|lin", "month": ""},
    "tr": {"letter": "", "anything": "örn|Örn|bkz|Bkz|krş", "name": "Sn|Bn|Doç|Yrd|Av", "number": "şek|Şek|syf|böl|tab|str", "month": ""},
}
_MORE = {"de": GERMAN, "tr": TURKISH}


def _joined(*lists: str) -> str:
    return "|".join(dict.fromkeys(w for words in lists for w in words.split("|") if w))


def _words_of(langs: tuple[str, ...]) -> dict[str, str]:
    kinds = ("letter", "anything", "name", "number", "month")
    out = {kind: _joined(*(_OWN[l].get(kind, "") for l in langs), _SHARED.get(kind, "")) for kind in kinds}
    return out | ({"ordinals": ""} if any("ordinals" in _OWN[l] for l in langs) else {})


#: The rules of all languages in Latin letters, for blocks whose language is not told.
LATIN: tuple[Rule, ...] = _latin(_words_of(tuple(_OWN)), GERMAN + TURKISH)
CYRILLIC: tuple[Rule, ...] = (
    (False, r"\b(?:т|и)\.$", r"\s?(?:е|д|п|к|н|ч|др|пр)\."),
    (False, r"\b(?:рис|стр|см|См|гл|табл|разд|п|пп|с|ст|напр|ср|т|тт|вып|им|ул|кв|тел|№|д|корп)\.$", r"\s*\S"),
    (False, r"\b(?:г|гг|в|вв|руб|коп|тыс|млн|млрд|т\.\s?[едпк]|др|проч)\.$", r"\s+[а-яёa-z]"),
    (False, rf"(?:^|[\s(«„\"])[{_UP}]\.$", rf"\s?[{_UP}]"),
)
INDIC: tuple[Rule, ...] = ((False, r"(?<![ऀ-ॿ])(?:डॉ|श्री|श्रीमती|प्रो|रु|सं|पं|कु|ई|एम|बी)\.$", r"\s*\S"),)
HAN: tuple[Rule, ...] = ((False, r"\b(?:No|Fig|Dr|Mr|vs|e\.g|i\.e)\.$", r"\s*\S"),)
DEFAULT: tuple[Rule, ...] = (
    (True, r"[。！？．｡।॥][\"”’»)\]）」』】》〉]{0,9}$", r""),
    (True, rf"[{_MARK}]\s?[{_CLOSE}]{{0,9}}$", r"\s"),
    (True, rf"(?:[\w)]{{2}}|\)|\s\d|[ap]\.m)[.!?…][{_CLOSE}]{{0,9}}$", rf"[“„«‘\"¿¡(]{{0,2}}[{_UP}][{_LOW}’']*(?:\.[a-z]{{2,4}})?[.!?…]{{0,3}}[\"”’»]?(?=\s|$)"),
    (True, r"[가-힣]\.$", r"[가-힣]"),
    (True, r"[ء-ي][.؟!]$", r"[ء-ي«]"),
    (True, r"[ऀ-ॿ][.?!]$", r"[ऀ-ॿ]"),
    (False, r"", r""),
)
#: Table by language, or by script where the language is not told or has no table of its own.
TABLES: dict[str, tuple[Rule, ...]] = {
    **{l: _latin(_words_of((l,)), _MORE.get(l, ())) for l in _OWN}, "latin": LATIN, "cyrillic": CYRILLIC + LATIN, "indic": INDIC + LATIN, "han": HAN + LATIN, "other": LATIN,
}
#: Frequent words by which a language in Latin letters is told.
FUNCTION_WORDS = {
    "en": "the of and to is that for with this was are not be by it from which when has have before after as no do all in on can does its",
    "de": "der die das und ist nicht mit den dem ein eine auf für von wird sich auch zu wurde werden bei im",
    "fr": "le la les des et est une dans pour que qui sur pas avec du au ce sont été cette avant il",
    "es": "el la los las y es una en para que por con no del se lo su ha cuando antes fue como",
    "pt": "o os as e é uma em para que por com não do da no na se foi quando antes ao",
    "pl": "i w na nie jest się z do że to przez dla po od jak tylko został przed oraz co",
    "tr": "ve bir bu için ile da de olarak ne çok sonra ama önce her daha olan ise değil gibi kadar",
}
_LANGUAGE_OF: dict[str, list[str]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _word in _words.split():
        _LANGUAGE_OF.setdefault(_word, []).append(_lang)


def _compiled(rules: tuple[Rule, ...]) -> list[tuple[bool, bool, re.Pattern, re.Pattern]]:
    """With a mark for rules that look at the whole sentence; the others look at its last characters."""
    return [(b, before.startswith("^"), re.compile(before.strip("^$") if before.startswith("^") else before), re.compile(after)) for b, before, after in rules]


_CASCADES = {name: _compiled(QUOTES + rules + DEFAULT) for name, rules in TABLES.items()}
_CANDIDATE = re.compile(rf"[{_MARK}]+|(?<=[฀-๿])\s+|\s(?<!\s\s)\s*+(?=[฀-๿])")
_DELIMITER = re.compile(r"[“”„«»‘’\"「」『』（）()]")
_PAIRS = {"“": "”", "„": "“”", "«": "»", "‘": "’", "「": "」", "『": "』", "（": "）", "(": ")", '"': '"'}
_FENCE = re.compile(r"[ \t]*+(?:>[ \t]?)*+[ \t]*+(```|~~~)")
_ITEM = re.compile(r"[ \t]*(?:[-*+•][ \t]+|\d{1,9}[.)][ \t]+)")
_BULLET = re.compile(r"[ \t]*[-*+•][ \t]+")
_HEADING = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]+|$)")
_QUOTE = re.compile(r"[ \t]{0,3}(?:>[ \t]?)+")


_SCRIPTS = tuple((name, re.compile(f"[{letters}]+")) for name, letters in (("han", "぀-ヿ㐀-䶿一-鿿"), ("indic", "ऀ-ॿ"), ("cyrillic", "Ѐ-ӿ"), ("other", "؀-ۿ가-힣"), ("latin", "A-Za-zÀ-ɏ")))
_KNOWN_WORDS = frozenset(_LANGUAGE_OF)


def table_of(text: str) -> str:
    """The table of a block: that of the script of most letters, and in Latin letters that of the language whose function words prevail."""
    if not text.isascii():
        # Names of code are Latin in every language, so a quarter of the letters tells another script.
        counts = {name: sum(map(len, letters.findall(text))) * (1 if name == "latin" else 4) for name, letters in _SCRIPTS}
        script = max(counts, key=counts.__getitem__)
        if script != "latin" and counts[script]:
            return script
    # Words that stand free of marks are enough to count.
    votes = Counter(l for w in _KNOWN_WORDS.intersection(text.lower().split()) for l in _LANGUAGE_OF[w])
    (best, n), (_, second) = (*votes.most_common(2), ("", 0), ("", 0))[:2]
    if n >= 4 and n > 2 * second:
        return best
    others = {name: c for name, c in counts.items() if c and name != "latin"} if not text.isascii() else {}
    return max(others, key=others.__getitem__, default="latin")


class _Delimiters:
    """The quotations and brackets that are open in the sentence that begins at ``start``; every character is read once."""

    def __init__(self, text: str) -> None:
        self.text, self.any = text, bool(_DELIMITER.search(text))
        self.last: dict[str, int] = {}
        self.begin(0)

    def begin(self, start: int) -> None:
        self.at, self.open, self.straight, self.low, self.angle = start, [], 0, False, False

    def read(self, upto: int) -> None:
        if not self.any:
            return
        for m in _DELIMITER.finditer(self.text, self.at, upto):
            c = m.group()
            self.straight += c == '"'
            self.low |= c == "„"
            self.angle |= c == "«"
            if self.open and c in _PAIRS[self.open[-1]]:
                self.open.pop()
            elif c in _PAIRS and not (c == "“" and self.open and self.open[-1] == "„"):
                self.open.append(c)
        self.at = max(self.at, upto)

    def still_open(self, at: int) -> bool:
        """Whether a quotation or bracket that began in this sentence is open at ``at`` and is closed later."""
        self.read(at)
        if self.open and not self.last:
            self.last = {c: self.text.rfind(c) for closers in _PAIRS.values() for c in closers}
        return bool(self.open) and any(self.last[c] >= at for c in _PAIRS[self.open[-1]])


def split_block(text: str) -> list[int]:
    """Offsets of the sentences of one block: a paragraph or list item without its markers."""
    rules = _CASCADES[table_of(text)]
    starts: list[int] = []
    n = len(text.rstrip())
    start = next((i for i, c in enumerate(text) if not c.isspace()), n)
    if start < n:
        starts.append(start)
    marks = _Delimiters(text)
    marks.begin(start)
    for m in _CANDIDATE.finditer(text, start):
        if m.start() < start:
            continue
        end = m.end()
        if m.group()[0].isspace():
            if end >= n:
                break
            if m.start() > start:
                start = end
                starts.append(start)
                marks.begin(start)
            continue
        while end < n:
            c = text[end]
            if c in "”’»)]）」』】》〉":
                end += 1
                continue
            if c in "“\" \u00a0\u202f":
                marks.read(end)
                if c == "“" and marks.low or c == '"' and marks.straight % 2:
                    end += 1
                    continue
                if c not in "“\"" and text[end + 1 : end + 2] == "»" and marks.angle:
                    end += 2
                    continue
            break
        if end >= n:
            break
        if marks.still_open(end):
            continue
        tail = text[max(start, end - TAIL) : end]
        for is_break, entire, before, after in rules:
            if after.match(text, end) and (before.fullmatch(text, start, end) if entire else before.search(tail)):
                if is_break:
                    start = end
                    while text[start].isspace():
                        start += 1
                    starts.append(start)
                    marks.begin(start)
                break
    return starts


def sentence_starts(text: str | None) -> list[tuple[int, int]]:
    """``(start, end)`` of every sentence unit of a document, in order; [] for null and empty texts."""
    if not text:
        return []
    out: list[tuple[int, int]] = []
    block_start, pieces, fence, kind = 0, [], None, ""

    def close() -> None:
        if pieces:
            block = "".join(pieces)
            starts = [next((i for i, c in enumerate(block) if not c.isspace()), 0)] if kind == "heading" else split_block(block)
            for a, b in zip(starts, [*starts[1:], len(block)], strict=True):
                unit = block[a:b].rstrip()
                if any(c.isalnum() for c in unit):
                    out.append((block_start + a, block_start + a + len(unit)))
            pieces.clear()

    at = 0
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        line = text[at:stop]
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1] == fence:
                fence = None
        elif mark:
            close()
            fence = mark[1]
        else:
            quote = _QUOTE.match(line)
            lead = quote.end() if quote else 0
            rest = line[lead:]
            quoted = bool(quote)
            heading = _HEADING.match(rest)
            # A number interrupts no paragraph: "3. Mai" may begin a wrapped line.
            item = (_BULLET if pieces and kind.startswith("text") else _ITEM).match(rest)
            if not rest.strip():
                close()
                kind = ""
            elif heading:
                close()
                kind, block_start = "heading", at
                pieces.append(" " * (lead + heading.end()) + rest[heading.end() :])
                close()
                kind = ""
            elif item:
                close()
                kind, block_start = "item", at
                pieces.append(" " * (lead + item.end()) + rest[item.end() :])
            else:
                if not pieces or kind not in ("item", f"text{quoted}"):
                    close()
                    kind, block_start = f"text{quoted}", at
                pieces.append(("\n" if pieces else "") + " " * lead + rest)
        at = stop + 1
    close()
    return out


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per sentence unit: ``key``, ``sent_no`` (from 1), ``sent_start``, ``sent_end`` (code points), ``sentence``.

    Headings are one unit, list items and quotations begin behind their markers, fenced code holds none. Null and empty
    texts give no rows, and neither do lines without a letter or digit; equal documents under several keys each give
    theirs, a row repeated with key and text gives its sentences once. Very long documents stay one row and are cut in
    one pass over their lines. Sentences are shuffled once, by key and place, so that repeated rows count once; a query
    of places alone shuffles no texts.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(k, i, a, b, body[a:b]) for i, (a, b) in enumerate(sentence_starts(body), 1)]
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["k", "sent_no", "sent_start", "sent_end", "sentence"]
            )

    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    units = rows.mapInArrow(cut, "k long, sent_no int, sent_start int, sent_end int, sentence string").withColumn("d", F.xxhash64("sentence"))
    once = units.groupBy("k", "sent_no", "sent_start", "sent_end", "d").agg(F.any_value("sentence").alias("sentence"))
    return once.drop("d").withColumnRenamed("k", key)
