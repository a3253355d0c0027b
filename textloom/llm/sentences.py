"""Problem 2: sentence boundaries across languages and scripts.

Method: document-centred disambiguation. Whether a full stop ends a sentence is decided by what stands unambiguously
elsewhere. First the document itself is asked: a token it has before a stop and then a small letter or a comma is an
abbreviation, a word with its capital inside sentences is a name, one in small letters elsewhere owes its capital to a beginning.
Then the whole collection: a token that is often followed by a stop but hardly ever ends a block, where sentences surely
end, nor stands before words that are small elsewhere in its document, is an abbreviation (and leads on to a capital if it mostly stands before one, as titles do); one that ends blocks as
often as any other word is none; first words of blocks begin sentences. Only where both are silent, as in small collections, short lists
of common abbreviations are asked. Script rules cover the rest: full-width marks and dandas end at once, Thai ends at the space
between two statements, a stop after Devanagari marks an abbreviation.

Layout: a blank line ends everything. A single line break is a wrap if the next word would not have fitted into the
line, else it sets a heading or a line apart. Quotations and brackets inside a sentence do not end it.

Counts cover every text. Tokens are judged on the executors from their full counts; what is sent around are the judged ones that
make up at least `SHARE` of all stops, so 1 / SHARE at most, first words of blocks likewise, and the words that stand after short tokens' stops.

Defined cases: null, empty and blank texts have no sentences; rows repeated with one id count once; rows with a null
id are left out. Positions are code points; spans have no white space at their ends and cover everything else.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import checkpoint

#: What counts as a heading for those who leave headings out: a line that stands alone, without a final mark and up to this long. It
#: is a row of the sentences like any other.
HEADING = 80
#: Least share of all stops or blocks that a token the collection judges, or a first word, has.
SHARE = 5e-7
#: A token is judged by how many of its stops would end a block if it were a word like others: so many are enough to tell, or
#: fewer if half of its stops are followed by what no sentence begins with.
TELLING, TELLING_WITH_SIGNS = 14.0, 6.0

# Common abbreviations, lower case. Those that stand before what they belong to never end a sentence;
# those that can stand last do so before a capital letter.
BEFORE = frozenset(
    """dr dra prof mr mrs ms st sr sra fr hr hrn dipl ing rev gen col capt fig figs sec abb abs kap tab vol no nr nos p pp s bd ed eds
    cf vgl vs viz ca approx e.g i.e z. b z.b d. h d.h u. a u.a p. ej p.ej p. ex p.ex bzw sog ggf evtl inkl pág págs pag núm num ap av cap art
    séc sec str véase проф д-р см рис стр табл ул пр пл им гл ст п пп т. е т.е тыс млн млрд др. гр акад доц просп див мал табл вул
    ris ul sm tabl tys mln gl
    डॉ प्रो पृ सं श्री ดร นพ พญ ศ รศ ผศ""".replace("\n", " ").replace("z. b ", "z.b ").split()
) | frozenset(["z. b", "d. h", "u. a", "p. ej", "p. ex", "т. е", "i. e", "e. g", "o. ä", "м", "об", "оп"])
# Of these, the ones that always lead on to what follows: titles, kinds of streets, words of comparison.
LEADS_ON = frozenset(
    """dr dra prof mr mrs ms st sr sra fr hr hrn dipl ing rev gen col capt cf vgl vs viz ca approx e.g i.e z.b d.h u.a p.ej p.ex bzw sog ggf evtl av
    véase проф д-р см ул пр пл им т.е др. гр акад доц див вул ul sm डॉ प्रो ดร นพ พญ ศ รศ ผศ""".split()
) | frozenset(["z. b", "d. h", "u. a", "p. ej", "p. ex", "т. е", "i. e", "e. g", "o. ä"])
LAST = frozenset(["etc", "usw", "inc", "ltd", "co", "al", "p.m", "a.m", "p. m", "a. m", "aprox", "т. д", "т.д", "т. п", "т.п", "др", "пр", "ін", "н. э", "н.э", "н. е", "н.е", "руб", "коп", "std", "min", "sek", "jr", "u. s. w", "і т. д", "грн", "t. d", "t. p"])
LISTS = frozenset(["etc", "usw", "т. д", "т.д", "т. п", "т.п", "t. d", "t. p", "u. s. w"])
# Words that report direct speech, and words that go on after dots.
SPEECH = frozenset("asked cried said replied answered shouted fragte rief sagte antwortete preguntó dijo gritó respondió perguntou disse gritou respondeu спросил спросила крикнул крикнула сказал сказала ответил ответила спитав спитала крикнув крикнула сказав сказала pregunto grito krikнул sprosil kriknul".split())
GOES_ON = frozenset("and und y e и і й та або und et और i then".split())
GOES_ON_CJK = ("随后", "然后", "接着", "そして", "それから")
EXTENSIONS = frozenset("csv txt pdf doc docx xls xlsx json xml html htm md zip png jpg example com org net".split())
ORDINAL_AFTER = frozenset("am im zum vom beim der dem den das des zur die ab bis".split())
_SPOKEN = re.compile(r"\s*(?:[^\s。！？，：:“”।]{1,40}\s+ने\s+(?:पूछा|कहा)(?!\s*[:：])|[^。！？，：:“”\s]{1,24}?(?:问道|说道|喊道|答道|问|喊|(?<!来)说)(?=[，。])|と(?!は)|って)")

_LINK = re.compile(r"https?://[^\s。！？，]+", re.I)
_MARK = re.compile(r"[.!?…。！？।॥｡؟]+")
_THAI = re.compile(r"[฀-๿]")
_DEVANAGARI = re.compile(r"[ऀ-ॿ]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_QUOTE = re.compile(r"[()\[\]（）［］「」『』【】«»“”„\"]")
_PAIR = {"(": ")", "[": "]", "（": "）", "［": "］", "「": "」", "『": "』", "【": "】"}
_OPENER_OF = {close: open_ for open_, close in _PAIR.items()}
_CLOSERS = ")]»”\"'’）］」』】“«"
_FULL = set("。！？।॥｡")
_OPENERS = re.compile("[\\s“„\"«»(（「『\\[¿¡—–’'-]*")
_SPACES = re.compile(r"\s*")
_NOT_LEADING = re.compile("[^\\s—–\\-¿¡“„\"«(（]")
_STILL_CLOSING = re.compile("[)\\]»”\"'’）］」』】“« ]*")
_TOKEN = re.compile(r"((?:[^\W\d_]\.\s?)*[^\W_]*(?:[ऀ-ॿ]*))\Z")
_WORD_AFTER = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_ENDS = re.compile(r"[.!?…。！？।॥｡][»”\"'’)\]）］」』】“«\s]*\Z")


@dataclass
class Evidence:
    """What the whole collection says of tokens before a stop ("title", "before" or "word"), of words that begin blocks, and the words
    after a short token's stop that have a small letter elsewhere and hardly ever a capital inside sentences."""

    kinds: dict[str, str] = field(default_factory=dict)
    starts: set[str] = field(default_factory=set)
    small: set[str] = field(default_factory=set)


def _lines(text: str) -> Iterator[list[tuple[int, int]]]:
    """Blocks: runs of lines that are not blank, as (start, end) of each line."""
    block: list[tuple[int, int]] = []
    at = 0
    for line in text.split("\n"):
        if line.strip():
            block.append((at, at + len(line)))
        elif block:
            yield block
            block = []
        at += len(line) + 1
    if block:
        yield block


def _segments(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that no sentence crosses: blocks, cut at the line breaks that are not wraps."""
    blocks = list(_lines(text))
    width = max((e - s for b in blocks for s, e in b), default=0)
    room = width if width < 50 else min(width, 76) - 8 if width <= 84 else width - 8  # nobody wraps at less than 50
    for block in blocks:
        start = block[0][0]
        for (s, e), (s2, e2) in zip(block, block[1:]):
            line, after = text[s:e].rstrip(), text[s2:e2].lstrip()
            first = after.split(None, 1)[0]
            need = 1 if _CJK.match(first) else len(first)
            if (width < 50 or len(line) + 1 + need <= room) and not _ENDS.search(line) and not (len(block) > 2 and line[-1:] in ",;"):
                yield start, e
                start = s2
        yield start, block[-1][1]


def _quotes(seg: str) -> list[tuple[int, int]]:
    """Outermost quotations and brackets that are closed."""
    stack: list[tuple[str, int]] = []
    of_kind: dict[str, list[int]] = {}  # places in the stack of each kind of opener
    out: list[tuple[int, int]] = []

    def push(c: str, at: int) -> None:
        of_kind.setdefault(c, []).append(len(stack))
        stack.append((c, at))

    def close(kinds: str, at: int) -> bool:
        """Closes the last opener of the kinds and forgets those within."""
        k = max((of_kind[c][-1] for c in kinds if of_kind.get(c)), default=-1)
        if k < 0:
            return False
        opened = stack[k][1]
        while len(stack) > k:
            of_kind[stack.pop()[0]].pop()
        while out and out[-1][0] > opened:
            out.pop()
        out.append((opened, at))
        return True

    for m in _QUOTE.finditer(seg):
        c, at = m.group(), m.start()
        if c == "“":
            if not (stack and stack[-1][0] == "„" and close("„", at)):
                push(c, at)
        elif c == "”":
            close("“„", at)
        elif c in "«»":
            if not close("»" if c == "«" else "«", at):
                push(c, at)
        elif c == '"':
            if not close(c, at):
                push(c, at)
        elif c in _PAIR or c == "„":
            push(c, at)
        else:
            close(_OPENER_OF.get(c, ""), at)
    return out


def _is_upper(c: str) -> bool:
    return c.isupper() or c.istitle()


def _uncased(c: str) -> bool:
    return c.isalpha() and c.lower() == c.upper()


class Splitter:
    def __init__(self, evidence: Evidence | None = None):
        self.evidence = evidence or Evidence()
        self.longest = max(map(len, [*self.evidence.kinds, *BEFORE, *LAST, "x" * 24]))

    def split(self, text: str | None) -> list[tuple[int, int]]:
        """(start, end) of every sentence and standing line."""
        if not text or text.isspace():
            return []
        letters = {c: n for c, n in Counter(text).items() if c.isalpha() and c.lower() != c.upper()}
        total = sum(letters.values())
        self.capitals = total > 20 and sum(n for c, n in letters.items() if c.isupper()) > 0.8 * total
        self.own = {w for w, kind, _ in stops(text) if kind == "on"}
        self.reach = max(self.longest, *map(len, self.own), 0) + 2 if self.own else self.longest + 2
        self.text, self.words = text, None
        out: list[tuple[int, int]] = []
        self.headings: list[bool] = []  # of each span: it stands alone and has no final mark
        for s, e in _segments(text):
            pieces = self._split_segment(text[s:e])
            for a, b in pieces:
                piece = text[s + a : s + b]
                left = len(piece) - len(piece.lstrip())
                right = len(piece.rstrip())
                if right > left:
                    out.append((s + a + left, s + a + right))
                    self.headings.append(len(pieces) == 1 and right - left <= HEADING and not _ENDS.search(piece))
        return out

    def _begins(self, word: str) -> bool | None:
        """Whether the capital of a word after an abbreviation comes from the start of a sentence; None if nothing tells."""
        if self.capitals or not word:
            return None
        if self.words is None:
            first = {m.group(1).lower() for m in _AFTER_END.finditer(self.text)}
            self.words = small_words(self.text), {w.lower() for w in names(self.text)}, first
        small, name, first = self.words
        if (word in small) == (word in name):  # the document doesn't tell
            if word not in self.evidence.small:
                return False if word in name else None
        elif word in name:
            return False
        return True if word in first or word in self.evidence.starts else None

    def _split_segment(self, seg: str) -> list[tuple[int, int]]:
        quotes = _quotes(seg)
        open_end = not _ENDS.search(seg)
        links = [m.span() for m in _LINK.finditer(seg)]
        cuts: list[int] = []
        start = 0
        q = 0
        thai = _THAI.search(seg) is not None
        marks = [(m.start(), m.end()) for m in _MARK.finditer(seg)]
        if thai:
            marks = sorted(marks + [(m.start(), m.start()) for m in re.finditer(r"(?<=\S)\s+(?=\S)", seg)])
        for s, e in marks:
            while links and links[0][1] <= s:
                del links[0]
            if e <= start and s != e or links and links[0][0] <= s and e < links[0][1]:
                continue
            while q < len(quotes) and quotes[q][1] < s:
                q += 1
            inside = q < len(quotes) and quotes[q][0] < s < quotes[q][1]
            if s == e:
                cut = None if inside or s <= start else self._thai_space(seg, s)
            elif inside:
                cut = self._quoted_end(seg, start, e, quotes[q])
            else:
                cut = self._end(seg, start, s, e, open_end and len(seg) - start <= 120)
            if cut is not None and cut > start:
                cuts.append(cut)
                start = cut
        while cuts and not seg[cuts[-1] :].strip():
            cuts.pop()
        edges = [0, *cuts, len(seg)]
        return list(zip(edges, edges[1:]))

    def _thai_space(self, seg: str, at: int) -> int | None:
        right = _SPACES.match(seg, at).end()
        left = at
        while left and not seg[left - 1].isspace() and not _THAI.match(seg, left - 1):
            left -= 1
        if right >= len(seg) or not left or seg[left - 1].isspace():  # no Thai letter in the word before
            return None
        if _is_upper(seg[_OPENERS.match(seg, right).end() :][:1]):
            return at
        while right < len(seg) and not seg[right].isspace():
            if _THAI.match(seg, right):
                return at
            right += 1
        return None

    def _next(self, seg: str, at: int) -> tuple[int, str, str]:
        """(white space, first significant character after opening marks, first word) of what follows."""
        gap = _SPACES.match(seg, at).end() - at
        inner = _OPENERS.match(seg, at).end()
        word = _WORD_AFTER.match(seg, inner)
        return gap, seg[inner : inner + 1], word.group().lower() if word else ""

    def _quoted_end(self, seg: str, start: int, e: int, span: tuple[int, int]) -> int | None:
        opened, closed = span
        if _STILL_CLOSING.match(seg, e, closed).end() < closed:
            return None
        end = closed + 1
        while end < len(seg) and seg[end] in ")]”’）］」』】":
            end += 1
        last = opened
        while last > start and seg[last - 1].isspace():
            last -= 1
        if _NOT_LEADING.search(seg, start, opened) and seg[max(start, last - 1) : last] not in tuple(":：,，、"):
            return None
        gap, c, word = self._next(seg, end)
        following = seg[end + gap : end + gap + 1]
        if not following or following in ",;:.，、；：。!?！？…":
            return None
        if c.islower() or _SPOKEN.match(seg, end) or word in SPEECH and (self.capitals or not _is_upper(c)):
            return None
        return end

    def _end(self, seg: str, start: int, s: int, e: int, heading: bool) -> int | None:
        mark = seg[s:e]
        end = e
        while end < len(seg) and seg[end] in _CLOSERS and not (seg[end] in "“«\"'" and end + 1 < len(seg) and seg[end + 1].isalnum()):
            end += 1
        if end >= len(seg):
            return None
        gap, c, word = self._next(seg, end)
        following = seg[end : end + gap + 1].strip()[:1]
        if following and following in ",;:，、；：)）]":
            return None
        if mark[-1] in _FULL or mark[0] in _FULL:
            return None if _SPOKEN.match(seg, end) and end > e else end
        if c.islower():
            return None
        if set(mark) & set("!?؟"):
            if not gap and not (_uncased(c) or _is_upper(c) and (seg[s - 1 : s].isalnum() or end > e)):
                return end if following and following in "“„«(¿¡—" else None
            return None if word in SPEECH and self.capitals else end
        if len(mark) > 1 or mark == "…":
            if (self.capitals or _uncased(c)) and (word in GOES_ON or seg.startswith(GOES_ON_CJK, end + gap)):
                return None
            if not gap and c.isdigit() and not _CJK.match(seg[s - 1 : s]) or not c and not following:
                return None
            return end
        return self._stop(seg, start, s, end, gap, c, word, following, heading)

    def _stop(self, seg: str, start: int, s: int, end: int, gap: int, c: str, word: str, following: str, heading: bool) -> int | None:
        token = _TOKEN.search(seg[max(start, s - self.reach) : s]).group(1)  # no known token is longer
        low = re.sub(r"\s+", " ", token.lower())
        short = low.rsplit(" ", 1)[-1].rsplit(".", 1)[-1]
        if _DEVANAGARI.search(token):
            return None
        if not gap and end == s + 1:
            if following and following in "“„«¿¡(—" and len(short) > 1:
                return end
            if not _is_upper(c) or not (len(short) > 1 or short.isdigit() or low in LAST):
                return None
            after = seg[end + 1 : end + 2]
            if self._kind(low) in ("title", "before") or word in EXTENSIONS or not (after.islower() or after.isspace() or self.capitals):
                return None
            return end
        if heading and re.fullmatch(r"\W*(?:[^\W\d_]+\s+)?\d+", seg[start:s]):
            return None
        kind = self._kind(low) or (self._kind(short) if short != low else None)
        if c.isdigit():
            return None if low.endswith("str") or kind in ("title", "before") or len(short) == 1 and not short.isdigit() else end
        if not (_is_upper(c) or _uncased(c)):
            return end if following in "“„«\"¿¡(（" else None
        if short.isdigit():
            if len(short) <= 3 and short == low and not re.search(r"[\d.,]\Z", seg[max(0, s - len(short) - 1) : s - len(short)]):
                before = seg[start : s - len(short)].split()
                if before and before[-1].lower().strip("„“»«(") in ORDINAL_AFTER and _is_upper(c) and word not in self.evidence.starts:
                    return None
            return end
        if low in LISTS and self.capitals:
            return end if word in self.evidence.starts or not self.evidence.starts else None
        begins = self._begins(word) if _is_upper(c) else None
        if low == "г" or low == "р":
            return end if seg[start:s].rstrip("гр ").endswith(tuple("0123456789")) and (begins or begins is None and word in self.evidence.starts) else None
        if kind == "last":
            return None if self.capitals or low in ("al", "inc", "co", "ltd") and word in SPEECH else end
        if kind == "title":
            return None
        if kind == "before" or len(short) == 1 and short.isalpha():
            return end if begins else None
        if low in self.own and not begins and (begins is False or word not in self.evidence.starts):
            return None
        return end

    def _kind(self, low: str) -> str | None:
        """What a token before a stop is: "title" (leads on to a capital), "before" (does not end), "last" (can end), "word" or unknown. The
        document says that it is an abbreviation, the collection and then the lists say of which kind."""
        known = self.evidence.kinds.get(low)
        if known == "title":
            return known
        listed = "title" if low in LEADS_ON else "last" if low in LAST else "before" if low in BEFORE else None
        if known == "word":
            return "last" if listed == "last" else known
        if known == "before":
            return listed or known
        return listed


_STOP = re.compile(r"(?<![^\W_])((?:[^\W\d_]\.\s?)*[^\W\d_]+)\.(?:(\s*)(\S?))")
_AFTER_END = re.compile(r"(?:\A|\n\s*\n|[^\W\d_]{7}\.\s+|[!?…]\s+)[\s“„\"«»(¿¡—–-]*([^\W\d_]+(?:['’-][^\W\d_]+)*)")
_AFTER_SHORT = re.compile(r"(?<![^\W\d_])[^\W\d_]{1,6}\.\s+[“„\"«»(¿¡—–-]*([^\W\d_]+(?:['’-][^\W\d_]+)*)")
_INSIDE = re.compile(r"(?<=[\w,;] )[^\W\d_]+(?:['’-][^\W\d_]+)*")
_SPACED = re.compile(r"\s+")
_FIRST = re.compile(r"\W*([^\W\d_]+)")


def stops(text: str) -> Iterator[tuple[str, str, int]]:
    """Tokens before a stop, what comes then, and where: "on" (a small letter or comma, so this is not the end), "number", "final" (the
    end of a block) or "other". Stops before closing marks say nothing."""
    for m in _STOP.finditer(text):
        gap, c = m.group(2), m.group(3)
        kind = "final" if not c or gap.count("\n") > 1 else "on" if c in ",;" or gap and c.islower() else "number" if gap and c.isdigit() else "other" if gap else ""
        if kind:
            yield _SPACED.sub(" ", m.group(1).lower()), kind, m.end(2)


def small_words(text: str) -> set[str]:
    """Words that stand in small letters somewhere."""
    return {w for w in _WORD_AFTER.findall(text) if w.islower()}


def names(text: str) -> Iterator[str]:
    """Words that have a capital inside a sentence."""
    return (w for w in _INSIDE.findall(text) if _is_upper(w[0]) and not w[1:].isupper() and len(w) > 1)


def _count(texts: list[str | None]) -> Counter[tuple[str, str]]:
    counts: Counter[tuple[str, str]] = Counter()
    for text in texts:
        if not text:
            continue
        small = small_words(text)
        counts.update(("small", word) for word in small)
        for word, kind, at in stops(text):
            after = _WORD_AFTER.match(text, _OPENERS.match(text, at).end()) if kind == "other" else None
            counts["begin" if after and after.group().lower() in small else kind, word] += 1
        counts.update(("name", word) for word in {w.lower() for w in names(text)})
        counts.update(("after", word) for word in {w.lower() for w in _AFTER_SHORT.findall(text) if _is_upper(w[0])})
        for block in _lines(text):
            body = text[block[0][0] : block[-1][1]]
            first = _FIRST.match(body)
            if first and _ENDS.search(body):
                counts["start", first.group(1).lower()] += 1
    return counts


def gather_evidence(texts: DataFrame, column: str) -> Evidence:
    """Counts over every text, judged word by word; see `Evidence`, `SHARE` and `TELLING`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _count(batch.column(0).to_pylist())
            kinds, words, numbers = [k for k, _ in counts], [w for _, w in counts], list(counts.values())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(words, pa.string()), pa.array(numbers, pa.int64())], names=["kind", "word", "n"])

    number = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).alias(kind)
    kinds = ("on", "number", "final", "other", "begin", "small", "name", "after", "start")
    rows = checkpoint(texts.select(column).mapInArrow(run, "kind string, word string, n long").groupBy("word").agg(*[number(k) for k in kinds]))
    stopped = F.col("on") + F.col("number") + F.col("final") + F.col("other") + F.col("begin")
    total = rows.agg(F.sum(stopped).alias("stops"), F.sum("final").alias("final"), F.sum("start").alias("start")).first()
    if not total["stops"]:
        return Evidence()
    usual = F.lit(total["final"] / total["stops"]) * stopped  # block ends the token would have as a word like others
    signs = F.col("on") + F.col("number") >= stopped / 2
    short_of = (F.col("final") <= usual / 10) & (F.col("begin") <= stopped / 20)  # nor is it followed by words that owe their capital to a beginning
    told = (usual >= TELLING) | ((usual >= TELLING_WITH_SIGNS) & signs)
    kind = F.when(told & short_of & (F.col("other") >= stopped / 2), "title").when(told & short_of, "before").when((usual >= TELLING_WITH_SIGNS) & (F.col("final") >= usual / 2), "word")
    judged = rows.where(stopped >= SHARE * total["stops"]).select("word", kind.alias("kind")).where("kind is not null").collect()
    starts = rows.where((F.col("start") >= 2) & (F.col("start") >= SHARE * total["start"])).select("word").collect()
    small = rows.where("after > 0 and small >= 3 and small > 4 * name").select("word").collect()
    return Evidence({w: k for w, k in judged}, {r[0] for r in starts}, {r[0] for r in small})


def split_rows(rows: DataFrame, evidence: Evidence) -> DataFrame:
    """(origin, rec_id, sent_start, sent_end) of rows (origin, rec_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(evidence)
        for batch in batches:
            spans = [splitter.split(t) for t in batch.column(2).to_pylist()]
            index = np.repeat(np.arange(len(spans)), [len(s) for s in spans])
            flat = np.array([x for s in spans for x in s], dtype=np.int32).reshape(-1, 2)
            take = pa.array(index)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["origin", "rec_id", "sent_start", "sent_end"])

    return rows.select("origin", "rec_id", "text").mapInArrow(run, "origin string, rec_id long, sent_start int, sent_end int")


def sentences(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """The sentences of documents.content and translation_runs.source_text."""
    one = documents.where("doc_id is not null and content is not null").select(F.lit("documents").alias("origin"), F.col("doc_id").cast("long").alias("rec_id"), F.col("content").alias("text"))
    other = runs.where("id is not null and source_text is not null").dropDuplicates(["id"]).select(F.lit("translation_runs").alias("origin"), F.col("id").cast("long").alias("rec_id"), F.col("source_text").alias("text"))
    evidence = gather_evidence(one.select("text").unionByName(runs.select(F.col("source_text").alias("text"))), "text")
    return split_rows(one.unionByName(other), evidence)
