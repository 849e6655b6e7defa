"""Sentence boundaries across languages and scripts.

Abbreviations, collocations and sentence starters are learned from the texts themselves, without labels, for each
language code and for each script as a whole, by log-likelihood ratios over counts of word types before and after
periods; the counts are made by Spark over all texts, with partial aggregation. Then each mark of each text is
classified by these statistics and by the quotations and brackets it stands in. The script's statistics serve where a
language code is wrong or rare.
"""

from __future__ import annotations

import re
from collections import ChainMap, Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.runtime import checkpoint, spread

# Characters with a part in sentence boundaries.
LINE_BREAKS = "\n\r\v\f\x85  "
COMMAS = ",،，、､፣"
DOTS = ".…"
STRONG = "!?。！？｡．؟।॥።፧፨‼⁇⁈⁉"
GREEK_QUESTION = ";;"
CLOSES = {"“": "”", "„": "“", "«": "»", "»": "«", "‘": "’", "‚": "‘", "(": ")", "[": "]", "（": "）", "［": "］", "「": "」", "『": "』", "【": "】", "《": "》", "〈": "〉", '"': '"', "＂": "＂"}
CLOSING_ONLY = "”’)]）］」』】》〉"
#: Particles that link a quotation to the sentence around it.
LINKS = "と的っ"
THAI_LETTER = "ก-ฮะ-ฺเ-ๅ็-๎"
#: Scripts written without blanks: their letters aren't part of a word before a period.
_NO_BLANKS = "฀-໿぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ"

# a word is what stands between blanks and punctuation; it may hold periods, hyphens, slashes and the like inside
_APART = r"\s!-/:-@\[-`{-~\x80-\xbf×÷\u2000-\u206f\u3000-\u303f\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65।॥\u037e\u0387،؛؟٪-٭۔፠-፨"
_WORD = re.compile(rf"[^{_APART}{_NO_BLANKS}]+(?:[.,٫·'’/-]+[^{_APART}{_NO_BLANKS}]+)*")
_LAST_WORD = re.compile(_WORD.pattern + r"\Z")
_PERIOD = re.compile(r"\.+")
_START = re.compile(rf"(?:^|[{LINE_BREAKS}!?])\s*({_WORD.pattern})")
_SKIPPED = re.compile("[\"”“»«’) \t\xa0\u3000\u202f]*")
_RUNNING = re.compile("[^\"“„«»‘‚(\\[（［「『【《〈＂¿¡ \t\xa0\u3000]")
_EVENT = re.compile("(?P<mark>[" + re.escape(DOTS + STRONG + GREEK_QUESTION) + "]+)|(?P<pair>[" + re.escape("".join(sorted({*CLOSES, *CLOSES.values()}))) + "])")
_THAI_BLANK = re.compile(rf"(?<=[{THAI_LETTER}])\s+(?=[{THAI_LETTER}])")
_LINE = re.compile(f"[^{LINE_BREAKS}]+")
_CASELESS_NO_BLANKS = re.compile(f"[{_NO_BLANKS}]")
_GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
# First and last code points of the letters of each script.
_SCRIPTS = {"latin": ("AZ", "az", "Àɏ"), "greek": ("ͰϿ", "ἀ῿"), "cyrillic": ("Ѐԯ",), "arabic": ("؀ۿ",), "devanagari": ("ऀॿ",), "ethiopic": ("ሀ፿",), "thai": ("฀๿",), "cjk": ("぀ヿ", "㐀鿿")}
_SCRIPT_OF = np.zeros(1 << 16, np.uint8)
for _i, _ranges in enumerate(_SCRIPTS.values()):
    for _a, _b in _ranges:
        _SCRIPT_OF[ord(_a) : ord(_b) + 1] = _i + 1

# Parameters of the statistics.
#: A type longer than this is no abbreviation.
LONGEST_TYPE = 16
#: Least score of an abbreviation, after Kiss and Strunk (2006).
ABBREVIATION = 0.3
#: Learned types that are broadcast, those seen most; the others are joined to the texts that need them.
MAX_BROADCAST = 200_000
#: Share of all texts that a language code must have for a model of its own: at most 1 / RARE of them. Scripts always have one.
RARE = 0.002
#: Rates at which a type's period ends a line, if it can end a sentence and if it can't.
ENDS, NEVER_ENDS = 0.2, 0.01
#: Least log-likelihood ratio of a collocation and a sentence starter.
COLLOCATION, STARTER = 30.0, 30.0


def script_of(text: str) -> str:
    """The script that most of a text's letters have; the first of equal ones, latin if there are none."""
    if text.isascii():
        return "latin"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.bincount(_SCRIPT_OF[codes[codes < 1 << 16]], minlength=len(_SCRIPTS) + 1)[1:]
    return list(_SCRIPTS)[int(n.argmax())]


#: How far before a mark its word is read: a word as long as that is no type, and no rule asks more of it than its last letter.
_BACK = 4 * LONGEST_TYPE


def _last_word(line: str, at: int) -> str:
    """The word that ends at a place, or the end of one longer than any type."""
    tail = line[max(0, at - _BACK) : at]
    if not tail or tail[-1].isspace():
        return ""
    m = _LAST_WORD.search(tail.split()[-1])
    return m.group() if m else ""


def _is_type(word: str) -> bool:
    return len(word) <= LONGEST_TYPE and not (word[0].isdigit() and len(word) > 2)


def _contexts(text: str, pieces: list[str], count: Counter) -> None:
    """Adds a text's pieces between blanks, and counts of words: those with a period (p), with a period at a line's end (e),
    before another word (c), at a certain start in small letters (s) and in any letters (o, the word in small ones)."""
    pieces += text.split()
    for m in _PERIOD.finditer(text):
        at, end = m.span()
        if end - at > 1:
            continue
        after = text[end : end + 1]
        if after and after not in "\"”“»«’)" and not after.isspace():
            continue
        word = _last_word(text, at)
        if not word or not _is_type(word):
            continue
        rest = _SKIPPED.match(text, end).end()
        count[word, "p"] += 1
        if rest == len(text) or text[rest] in LINE_BREAKS:
            count[word, "e"] += 1
        elif (nxt := _WORD.match(text, rest)) and len(nxt.group()) <= LONGEST_TYPE:
            count[f"{word} {nxt.group()}", "c"] += 1
    for word in _START.findall(text):
        if word[0].isalpha():
            count[word.lower(), "o"] += 1
        if word[0].islower():
            count[word, "s"] += 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        groups: dict[tuple[str, str | None], tuple[list[str], Counter]] = {}
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            pieces, count = groups.setdefault((f"*{script_of(text)}", lang), ([], Counter()))
            _contexts(text, pieces, count)
            count["", "d"] += 1
        total: dict[str, Counter] = {}
        for (script, lang), (pieces, count) in groups.items():
            all_types: Counter = Counter()
            for piece, n in Counter(pieces).items():
                for word in _WORD.findall(piece):
                    all_types[word] += n
            count["", "n"] = all_types.total()
            count["", "p"] = sum(n for (_, what), n in count.items() if what == "p")
            count["", "s"] = sum(n for (_, what), n in count.items() if what == "s")
            count["", "o"] = sum(n for (_, what), n in count.items() if what == "o")
            for word, n in all_types.items():
                if _is_type(word):
                    count[word, "n"] = n
                    if (small := word.lower()) != word:
                        count[small, "f"] += n
            for model in (script, lang):
                if model:
                    total.setdefault(model, Counter()).update(count)
        for model, count in total.items():
            keys = list(count)
            yield pa.RecordBatch.from_arrays([pa.array([model] * len(keys), pa.string()), pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(count.values()), pa.int64())], names=["model", "type", "what", "n"])


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return k * F.log(p) + (n - k) * F.log(1 - p)


def _ratio(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Dunning's log-likelihood ratio of two samples having one rate or two."""
    one = (k1 + k2) / (n1 + n2)
    return 2 * (_log_likelihood(k1, n1, k1 / n1) + _log_likelihood(k2, n2, k2 / n2) - _log_likelihood(k1, n1, one) - _log_likelihood(k2, n2, one))


def learn(texts: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """model, kind, type, seen: the abbreviations (kind 'never' or 'ends' a sentence), collocations ('pair', 'a b'), lower-case
    sentence starters ('start') and starters in any case ('opens', in small letters) of each language code and of each script
    (model '*latin' and so on).

    An abbreviation is a type whose periods are explained better by always having one than by the texts' rate of periods,
    short types and ones with inner periods being favoured (Kiss and Strunk 2006); it can end a sentence if its rate at line
    ends is nearer to ENDS than to NEVER_ENDS.
    """
    rows = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = checkpoint(rows.mapInArrow(_counted, "model string, type string, what string, n long").groupBy("model", "type").pivot("what", _COUNTS).agg(F.sum("n")).na.fill(0, _COUNTS))
    kept = counts.where("type = '' OR p > 0 OR s > 2 OR o > 2 OR c > 4")
    per = counts.groupBy("model").agg(F.sum(F.when(F.col("type") == "", F.col("n"))).alias("all_n"), F.sum(F.when(F.col("type") == "", F.col("p"))).alias("all_p"), F.sum(F.when(F.col("type") == "", F.col("s"))).alias("all_s"), F.sum(F.when(F.col("type") == "", F.col("o"))).alias("all_o"), F.max("d").alias("texts"))
    scripts = F.sum(F.when(F.col("model").startswith("*"), F.col("texts"))).alias("docs")
    per = per.join(F.broadcast(per.agg(scripts)), F.expr(f"startswith(model, '*') OR texts >= {RARE} * docs"))
    k = kept.where("type <> ''").join(per, "model")
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    alone = -2 * (_log_likelihood(F.col("p"), F.col("n"), F.col("all_p") / F.col("all_n")) - _log_likelihood(F.col("p"), F.col("n"), F.lit(0.99)))
    score = alone * F.exp(-(F.length("type") - inner).cast("double")) * (inner + 1)
    ends = _log_likelihood(F.col("e"), F.col("p"), F.lit(ENDS)) > _log_likelihood(F.col("e"), F.col("p"), F.lit(NEVER_ENDS))
    short = k.where("p >= 2").where(score >= ABBREVIATION).select("model", F.when(ends, "ends").otherwise("never").alias("kind"), "type", F.col("p").alias("seen"))
    starters = k.where("s > 2 AND n > 0").where(F.col("s") / F.col("n") > 2 * F.col("all_s") / F.col("all_n")).where(_ratio(F.col("s"), F.col("n"), F.col("all_s") - F.col("s"), F.col("all_n") - F.col("n")) >= STARTER).select("model", F.lit("start").alias("kind"), "type", F.col("s").alias("seen"))
    whole = F.col("n") + F.col("f")
    opening = k.where("o > 2 AND n + f >= o").where(F.col("o") / whole > 2 * F.col("all_o") / F.col("all_n")).where(_ratio(F.col("o"), whole, F.col("all_o") - F.col("o"), F.col("all_n") - whole) >= STARTER).select("model", F.lit("opens").alias("kind"), "type", F.col("o").alias("seen"))
    pair = k.where("c >= 5").select("model", "type", "c", "all_n", F.substring_index("type", " ", 1).alias("a"), F.substring_index("type", " ", -1).alias("b"))
    single = counts.where("n > 0")
    a, b = single.select("model", F.col("type").alias("a"), F.col("p").alias("pa")), single.select("model", F.col("type").alias("b"), F.col("n").alias("nb"))
    tied = pair.join(a, ["model", "a"]).join(b, ["model", "b"]).where("c * 10 >= pa AND nb > c AND all_n > pa").where(_ratio(F.col("c"), F.col("pa"), F.greatest(F.col("nb") - F.col("c"), F.lit(0)), F.col("all_n") - F.col("pa")) >= COLLOCATION)
    return short.unionByName(starters).unionByName(opening).unionByName(tied.select("model", F.lit("pair").alias("kind"), "type", F.col("c").alias("seen")))


_COUNTS = ["n", "f", "p", "e", "s", "o", "c", "d"]


class Model:
    """The learned types, by language code and script."""

    #: A language code's statistics of a type count before the script's if they have this share of its periods.
    OWN = 0.2

    def __init__(self, rows: list[tuple[str, str, str, int]]) -> None:
        self.kinds: dict[str, dict[str, tuple[str, int]]] = {}
        self.others: dict[str, set[tuple[str, str]]] = {}
        self.views: dict[tuple[str | None, str], tuple[dict[str, str], set[tuple[str, str]]]] = {}
        for model, kind, word, seen in rows:
            if kind in ("never", "ends"):
                self.kinds.setdefault(model, {})[word] = kind, seen
            else:
                self.others.setdefault(model, set()).add((kind, word))

    def view(self, lang: str | None, script: str) -> tuple[dict[str, str], set[tuple[str, str]]]:
        if (lang, script) not in self.views:
            kinds: dict[str, tuple[str, int]] = dict(self.kinds.get("*latin", {})) if script in ("cjk", "thai") else {}
            kinds |= self.kinds.get(f"*{script}", {})
            for word, (kind, seen) in self.kinds.get(lang or "", {}).items():
                if word not in kinds or seen >= self.OWN * kinds[word][1]:
                    kinds[word] = kind, seen
            self.views[lang, script] = {w: k for w, (k, _) in kinds.items()}, self.others.get(lang or "", set()) | self.others.get(f"*{script}", set())
        return self.views[lang, script]

    def view_with(self, lang: str | None, script: str, rows: list[tuple[str, str, str, int]]) -> tuple[ChainMap, _Either]:
        """The view with further learned rows, as if the model had held them."""
        kinds, others = self.view(lang, script)
        more, own = Model(rows), {}
        for word in {word for _, kind, word, _ in rows if kind in ("never", "ends")}:
            best = None
            for model in (*(["*latin"] if script in ("cjk", "thai") else []), f"*{script}"):
                best = more.kinds.get(model, {}).get(word) or self.kinds.get(model, {}).get(word) or best
            of_lang = more.kinds.get(lang or "", {}).get(word) or self.kinds.get(lang or "", {}).get(word)
            if of_lang and (best is None or of_lang[1] >= self.OWN * best[1]):
                best = of_lang
            if best:
                own[word] = best[0]
        return ChainMap(own, kinds), _Either(others, more.others.get(lang or "", set()) | more.others.get(f"*{script}", set()))


class _Either:
    """What is in one of two sets, without copying them."""

    def __init__(self, a: set, b: set) -> None:
        self.a, self.b = a, b

    def __contains__(self, x: tuple[str, str]) -> bool:
        return x in self.a or x in self.b


def _period_ends(line: str, at: int, end: int, after: int, kinds: dict[str, str], others: set) -> bool:
    """Whether the single period at line[at:end], with its next letter or mark at line[after], ends the sentence."""
    word = _last_word(line, at)
    kind = kinds.get(word)
    joined = after == end and after < len(line)
    c = line[after] if after < len(line) else ""
    if not c:
        return True
    if joined and (c.isdigit() or c.islower() or not c.isalnum() and c in "-/_@"):
        return False
    nxt = _WORD.match(line, after)
    follower = nxt.group() if nxt else ""
    if kind == "never" or kind is None and len(word) == 1 and word.isalpha() and not _CASELESS_NO_BLANKS.match(word):
        # only a word that opens sentences, and doesn't go with this one, begins another after an abbreviation or initial
        return not joined and not c.islower() and ("opens", follower.lower()) in others and ("pair", f"{word} {follower}") not in others
    if joined and c.isalnum() and (len(follower) < 2 or not (word[-1:].isdigit() or len(word) > 1 or kind == "ends") or not c.isupper()):
        return False
    if kind == "ends" and ("pair", f"{word} {follower}") in others:
        return False
    if c.islower():
        return ("start", follower) in others
    return True


class _Last:
    """The last place of each character that is asked for in a line."""

    def __init__(self, line: str) -> None:
        self.line, self.at = line, {}

    def after(self, c: str, at: int) -> bool:
        """Whether c stands at or after a place."""
        if c not in self.at:
            self.at[c] = self.line.rfind(c)
        return self.at[c] >= at


def _lone_close(line: str, at: int, last: _Last) -> bool:
    """Whether the character right after a mark closes something that wasn't opened in the line."""
    c = line[at]
    if c in CLOSING_ONLY:
        return True
    if c == "»":
        return not last.after("«", at + 1)
    return c in '"＂' and (at + 1 == len(line) or line[at + 1].isspace()) and not last.after(c, at + 1)


class _Open:
    """What is open at a place of a line: closing marks, and whether each was opened inside a running sentence."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool]] = []
        self.waiting: Counter = Counter()
        self.running = 0

    def push(self, close: str, running: bool) -> None:
        self.stack.append((close, running))
        self.waiting[close] += 1
        self.running += running

    def pop(self) -> str:
        close, running = self.stack.pop()
        self.waiting[close] -= 1
        self.running -= running
        return close


def _line_sentences(line: str, kinds: dict[str, str], others: set, out: list[tuple[int, int]], base: int) -> None:
    """Adds the sentences of a line. Each character is looked at a bounded number of times, however long the line is."""
    n, start, last, held = len(line), 0, _Last(line), _Open()
    cuts: list[int] = []
    pos = body = greek = 0
    body_of = greek_of = -1  # the sentence start that body and greek are of
    is_greek = False
    while (e := _EVENT.search(line, pos)) is not None:
        at, pos = e.start(), e.end()
        if e.lastgroup == "pair":
            c = e.group()
            if held.waiting[c]:
                while held.pop() != c:
                    pass
            elif c in CLOSES and last.after(CLOSES[c], pos):
                if body_of != start:
                    m = _RUNNING.search(line, start)
                    body, body_of = m.start() if m else n, start
                held.push(CLOSES[c], body < at)
            continue
        mark = e.group()
        if mark[0] in GREEK_QUESTION and not mark.strip(GREEK_QUESTION):
            # a question in Greek: a Greek letter in the sentence so far
            if greek_of != start:
                greek, greek_of, is_greek = start, start, False
            is_greek = is_greek or _GREEK.search(line, greek, at) is not None
            greek = at
            if not is_greek:
                continue
        if mark == "．" and line[at - 1 : at].isdigit() and line[pos : pos + 1].isdigit():
            continue
        # closing marks, also behind a blank if they close what is open
        close, closed, inner = pos, False, held.running > 0
        while close < n:
            look = close
            while look < n and line[look].isspace():
                look += 1
            if look < n and held.stack and line[look] == held.stack[-1][0] and (look == close or line[look] not in "\"'"):
                held.pop()
                close, closed = look + 1, True
            elif look < n and look == close and (closed and line[look] in STRONG + DOTS or _lone_close(line, look, last)):
                # also a closing mark whose opening one is in another line or missing
                close, closed = look + 1, True
            else:
                break
        after = close
        while after < n and line[after].isspace():
            after += 1
        c = line[after] if after < n else ""
        if not c:
            ends = True
        elif c in COMMAS or c in "])）］」』】" or c in STRONG + DOTS:
            ends = False
        else:
            nxt = _WORD.match(line, after)
            starter = bool(nxt) and ("start", nxt.group()) in others
            small = c.islower() and not starter
            period = mark == "."
            if closed:
                if inner:
                    ends = not (small or starter) and not (c in LINKS and after == close) and (c.isupper() or bool(_CASELESS_NO_BLANKS.match(c)) or not c.isalpha()) and not held.running
                else:
                    ends = not small and not (c in LINKS and after == close)
            elif inner:
                ends = False
            elif period:
                ends = _period_ends(line, at, pos, after, kinds, others)
            elif not mark.strip(DOTS):
                ends = not small
            else:
                ends = True
        if ends:
            cuts.append(close)
            start = close
        pos = close
    for t in _THAI_BLANK.finditer(line):
        cuts.append(t.start())
    cuts.append(n)
    begin = 0
    for cut in sorted(set(cuts)):
        piece = line[begin:cut]
        if body_text := piece.strip():
            left = begin + len(piece) - len(piece.lstrip())
            out.append((base + left, base + left + len(body_text)))
        begin = cut


def split(text: str, lang: str | None, model: Model, more: list[tuple[str, str, str, int]] | None = None) -> list[tuple[int, int]]:
    """Start and end of the sentences of a text, in code points. more: learned rows that the model doesn't hold."""
    kinds, others = model.view_with(lang, script_of(text), more) if more else model.view(lang, script_of(text))
    out: list[tuple[int, int]] = []
    for m in _LINE.finditer(text):
        _line_sentences(m.group(), kinds, others, out, m.start())
    return out


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, model, type of all types that splitting a text may look up: words before and after its marks, and pairs of them."""
    for b in batches:
        out: list[tuple[int, str, str]] = []
        for key, text, lang in zip(*(c.to_pylist() for c in b.columns)):
            types: set[str] = set()
            for m in _LINE.finditer(text):
                line = m.group()
                for e in _EVENT.finditer(line):
                    if e.lastgroup == "mark":
                        word, nxt = _last_word(line, e.start()), _WORD.search(line, e.end())
                        types |= {word, nxt.group(), f"{word} {nxt.group()}"} if nxt else {word}
            script = script_of(text)
            for model in {lang or "", f"*{script}", *(["*latin"] if script in ("cjk", "thai") else [])} - {""}:
                out += [(key, model, t) for t in types]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.string())], names=["key", "model", "type"])


def _with_tail(rows: DataFrame, tail: DataFrame, text: str, lang: str) -> DataFrame:
    """rows with more: the rows of tail that a text may look up. Texts are told apart by a hash: where two share one, either
    gets the other's types too, which are learned ones all the same."""
    keyed = rows.withColumn("_key", F.xxhash64(text, lang))
    wanted = keyed.select("_key", text, lang).mapInArrow(_wanted, "key long, model string, type string").distinct()
    found = wanted.join(tail, ["model", "type"]).groupBy(F.col("key").alias("_key")).agg(F.collect_set(F.struct("model", "kind", "type", "seen")).alias("more"))
    return keyed.join(found, "_key", "left").drop("_key")


def _split_rows(model, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, start, end = [], [], []
            tails = ([tuple(r.values()) for r in x or []] for x in b.column(3).to_pylist()) if b.num_columns > 3 else repeat(None)
            for i, (text, lang, more) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), tails)):
                for s, e in split(text, lang, model.value, more):
                    row.append(i)
                    start.append(s)
                    end.append(e)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int32())).cast(id_type), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["id", "sent_start", "sent_end"])

    return run


def sentences(texts: DataFrame, text_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """text_id, sent_start, sent_end: the sentences of every text, in code points, 0-based and half-open.

    texts: other columns are ignored. A sentence has no blanks at its edges; each other character is in exactly one. Null,
    empty and blank texts give no row; a null lang uses the script's statistics; rows with repeated or null ids are split
    each by itself. The learned types are gathered by the driver and broadcast, up to MAX_BROADCAST of them, those seen
    most; where there are more, the others are joined to the texts by model and type.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = texts.sparkSession
    texts = spread(texts.select(text_id, text, lang))
    learned = checkpoint(learn(texts, text, lang).select("model", "kind", "type", "seen"))
    head = learned.orderBy(F.desc("seen"), "model", "kind", "type").limit(MAX_BROADCAST)
    seen = [tuple(r) for r in head.collect()]
    model = spark.sparkContext.broadcast(Model(seen))
    rows = texts.where(F.length(text) > 0).select(text_id, text, lang)
    if len(seen) == MAX_BROADCAST:
        rows = _with_tail(rows, learned.join(head, ["model", "kind", "type"], "left_anti"), text, lang)
    kind = texts.schema[text_id].dataType
    return rows.mapInArrow(_split_rows(model, to_arrow_type(kind)), f"id {kind.simpleString()}, sent_start int, sent_end int").withColumnRenamed("id", text_id)
