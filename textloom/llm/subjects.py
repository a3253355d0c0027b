"""Problem 5: subject areas of documents.

Method: class-association rules. A transaction is a sentence of a labelled document: its most telling items (words, or
character n-grams in scripts without spaces) and the subjects its document is labelled with. Frequent item sets are mined with
parallel frequent-pattern growth (Spark ML's FPGrowth); sets with a subject give rules "items -> subject", whose confidence
is the share of such sentences that stand in documents of the subject.

A rule weighs its log odds against the subject's base rate, a rule of several items by how much they exceed what the
rules within it add up to; one that does not exceed it says nothing new and is pruned. A sentence is scored by all rules it
matches. The evidence is calibrated on every tenth document, which takes no part in mining, to the probability that
the sentence's document has the subject, against the surest evidence (labels are wrong and documents have sentences on other
matters, so even that falls short of 1). A document deals with a subject if at least a quarter of its sentences do.

The rules are fitted on at most about `SAMPLE` documents: those with labels of the annotators first, `none` included, then some whose domain
names a subject. Everything else covers every document with content.

Defined cases: null and blank contents have no rows; headings do not count; a document with headings only has none.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.languages import romanised
from textloom.llm.sentences import Splitter
from textloom.session import checkpoint

SAMPLE = 12_000
#: Items of a transaction for mining (scoring looks at all), and of a rule.
ITEMS, RULE_ITEMS = 6, 3
#: An item counts if it stands in this many documents of the sample (or its share of them), and some subject's share p of
#: them is above its share b of all documents: the gain (p - b) / (1 - b) is at least MIN_GAIN, or WEAK_GAIN in WEAK_DOCUMENTS or more.
MIN_DOCUMENTS, MIN_DOCUMENT_SHARE, MIN_GAIN = 3, 1 / 1500, 0.235
WEAK_GAIN, WEAK_DOCUMENTS = 0.12, 40
#: Gain of a rule's confidence over the subject's base rate.
RULE_GAIN = 0.235
#: One document in so many is held out of mining, for calibration; sentences of a bin of evidence.
HELD, BIN = 10, 50
QUARTER = 0.25

# Further names of the subjects in the field `domain`.
OTHER_NAMES = {
    "software": "computer_science computer science it programming программирование software entwicklung informatik informática",
    "medicine": "health медицина здоровье medizin medicina",
    "law": "legal право recht derecho direito",
    "sport": "sports спорт deporte desporto",
    "science": "natural_science natural science наука wissenschaft ciencia ciência",
    "art": "fine art fine_art arts искусство kunst arte",
    "literature": "fiction литература literatur literatura",
    "economy": "finance economics экономика wirtschaft economía economia",
}
_PHRASES = {"computer science", "natural science", "fine art"}
_WORD = re.compile(r"[^\W\d_]+(?:['’ʼ][^\W\d_]+)*")
_SPACELESS = re.compile(r"[぀-ヿ㐀-鿿々ー]+|[฀-๿]+")
_THAI = re.compile(r"[฀-๿]")
_MARKED = re.compile(r"[À-ɏ̀-ͯЀ-ӿ]")
_INDIC = re.compile(r"[ऀ-ॿ]+")


@lru_cache(maxsize=200_000)
def _simple(word: str) -> str:
    """Lower case, Latin letters, no accents: the same for the usual, the plain and the romanised way of writing."""
    word = word.lower()
    if _MARKED.search(word):
        word = "".join(c for c in unicodedata.normalize("NFD", romanised(unicodedata.normalize("NFC", word))) if not unicodedata.combining(c))
    return word.replace("'", "").replace("’", "").replace("ʼ", "")


def items_of(sentence: str) -> set[str]:
    """Words of at least three letters; n-grams in Chinese, Japanese and Thai."""
    out: set[str] = set()
    rest = sentence
    if _SPACELESS.search(sentence):
        for m in _SPACELESS.finditer(sentence):
            run, n = m.group(), 4 if _THAI.match(m.group()) else 3
            out.update(run[i : i + n] for i in range(len(run) - n + 1))
        rest = _SPACELESS.sub(" ", sentence)
    if _INDIC.search(rest):
        out.update(w for w in _INDIC.findall(rest) if len(w) > 1)
        rest = _INDIC.sub(" ", rest)
    for w in _WORD.findall(rest):
        simple = _simple(w)
        if len(simple) >= 3:
            out.add(simple)
    return out


def domain_names(subjects: Iterable[tuple[str, ...]]) -> dict[str, str]:
    """Lower-case names -> subject, from the table of subjects and the further names."""
    names: dict[str, str] = {}
    for row in subjects:
        subject = row[0]
        other = OTHER_NAMES.get(subject, "")
        for phrase in _PHRASES:
            if phrase in other:
                names[phrase] = subject
                other = other.replace(phrase, "")
        for name in [*row, *other.split()]:
            if name:
                names[name.strip().lower()] = subject
    return names


@dataclass
class Rules:
    subjects: list[str]
    rules: dict[frozenset[str], list[tuple[int, float]]]
    edges: list[float]
    chance: list[float]

    def __post_init__(self) -> None:
        self.single = {next(iter(s)): rule for s, rule in self.rules.items() if len(s) == 1}
        uses = Counter(i for s in self.rules if len(s) > 1 for i in s)
        self.joint: dict[str, list[tuple[frozenset[str], list[tuple[int, float]]]]] = {}  # each by its rarest item
        for s, rule in self.rules.items():
            if len(s) > 1:
                self.joint.setdefault(min(s, key=lambda i: (uses[i], i)), []).append((s, rule))

    def evidence(self, items: set[str]) -> tuple[int, float]:
        """The subject with the most evidence, and how far it is ahead: weights of all matching rules, added up."""
        total = [0.0] * len(self.subjects)
        for item in items & self.single.keys():
            for subject, weight in self.single[item]:
                total[subject] += weight
        for item in items & self.joint.keys():
            for some, rule in self.joint[item]:
                if some <= items:
                    for subject, weight in rule:
                        total[subject] += weight
        best = max(total)
        first = total.index(best)
        return first, best - max(total[:first] + total[first + 1 :], default=0.0)

    def probability(self, amount: float) -> float:
        return self.chance[int(np.searchsorted(self.edges, amount, side="right"))]


def _told(items: Iterable[str], confidence: dict[str, float]) -> list[str]:
    """The most telling items of a sentence, in a fixed order."""
    return sorted((i for i in items if i in confidence), key=lambda i: (-confidence[i], i))[:ITEMS]


def _item_shares(sentences: DataFrame, n_subjects: int) -> tuple[dict[str, list[float]], list[float]]:
    """(items that count -> share of their documents with each subject, shares of all documents); the former smoothed by the latter.

    Counted over documents, on the executors; only items that one subject has enough of come to the driver."""
    documents = sentences.select("doc_id", "classes").dropDuplicates(["doc_id"])
    of = [F.sum(F.array_contains("classes", k).cast("int")).alias(f"s{k}") for k in range(n_subjects)]
    total = documents.agg(F.count("*").alias("n"), *of).first()
    n = total["n"]
    if not n:
        return {}, []
    base = [(total[f"s{k}"] or 0) / n for k in range(n_subjects)]
    each = sentences.select("doc_id", "classes", F.explode("items").alias("item")).dropDuplicates(["doc_id", "item"])
    counts = each.groupBy("item").agg(F.count("*").alias("n"), *of).where(F.col("n") >= max(MIN_DOCUMENTS, n * MIN_DOCUMENT_SHARE))
    share = [((F.col(f"s{k}") + 2 * base[k]) / (F.col("n") + 2)).alias(f"s{k}") for k in range(n_subjects)]
    gains = [(F.col(f"s{k}") - base[k]) / (1 - min(base[k], 0.99)) for k in range(n_subjects)]
    gain = F.greatest(*gains, F.lit(-1.0))
    kept = counts.select("item", "n", *share).where((gain >= MIN_GAIN) | ((gain >= WEAK_GAIN) & (F.col("n") >= WEAK_DOCUMENTS))).drop("n")
    return {r[0]: list(r[1:]) for r in kept.collect()}, base


def _gains(share: dict[str, list[float]], base: list[float]) -> dict[str, float]:
    return {i: max((p - b) / (1 - min(b, 0.99)) for p, b in zip(ps, base)) for i, ps in share.items()}


def _transactions(sentences: DataFrame, gains: dict[str, float]) -> DataFrame:
    """(items): the telling items of each sentence and the subjects of its document, as "\\t" and their number."""
    sent = sentences.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            told = [(_told(items, gain), classes) for items, classes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            out = [[*items, *(f"\t{k}" for k in sorted(set(classes)))] for items, classes in told if items]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], names=["items"])

    return sentences.select("items", "classes").mapInArrow(run, "items array<string>")


def _mined(transactions: DataFrame) -> tuple[list[tuple[list[str], int, int, int]], dict[int, float]]:
    """((items, subject, occurrences with the subject, occurrences) of every frequent set sure enough to be a rule, base rates of the subjects)."""
    n = transactions.count()
    if not n:
        return [], {}
    least = max(3.0, n / 20_000)
    frequent = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n)).fit(transactions).freqItemsets
    mark = lambda x: x.startswith("\t")
    split = frequent.select(F.array_sort(F.filter("items", lambda x: ~mark(x))).alias("left"), F.filter("items", mark).alias("marks"), "freq")
    split = checkpoint(split.where((F.size("left") <= RULE_ITEMS) & (F.size("marks") <= 1)))
    subject = F.substring(F.col("marks")[0], 2, 9).cast("int").alias("subject")
    heads = split.where("size(marks) = 1 and size(left) > 0").select("left", subject, F.col("freq").alias("hits"))
    base = {r[0]: r[1] / n for r in split.where("size(marks) = 1 and size(left) = 0").select(subject, "freq").collect()}  # one row a subject
    bodies = split.where("size(marks) = 0 and size(left) > 0").select("left", F.col("freq").alias("all"))
    rate = F.coalesce(*[F.when(F.col("subject") == k, F.lit(b)) for k, b in base.items()], F.lit(0.0))
    p = (F.col("hits") + 2 * rate) / (F.col("all") + 2)
    sure = heads.join(bodies, "left").where((p - rate) / (1 - rate) >= RULE_GAIN)
    return [(list(r[0]), r[1], r[2], r[3]) for r in sure.select("left", "subject", "hits", "all").collect()], base


def _pruned(mined: list[tuple[list[str], int, int, int]], base: dict[int, float]) -> dict[frozenset[str], list[tuple[int, float]]]:
    """Rules with their weights for each subject; a rule that tells no more than the rules within it together is left out."""
    weight: dict[tuple[frozenset[str], int], float] = {}
    for items, subject, hits, everything in sorted(mined, key=lambda m: (len(m[0]), m[0], m[1])):
        b = min(max(base[subject], 1e-6), 0.99)
        p = min((hits + 2 * b) / (everything + 2), 1 - 1e-6)
        within = sum(weight.get((frozenset(part), subject), 0.0) for size in range(1, len(items)) for part in combinations(items, size))
        more = math.log(p / (1 - p)) - math.log(b / (1 - b)) - within
        if more > 1e-9:
            weight[frozenset(items), subject] = more
    rules: dict[frozenset[str], list[tuple[int, float]]] = {}
    for (items_of_rule, subject), w in weight.items():
        rules.setdefault(items_of_rule, []).append((subject, w))
    return rules


def _amounts(sentences: DataFrame, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Evidence of each sentence of the sample, and whether the subject is one of its document's."""
    sent = sentences.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = sent.value
        for batch in batches:
            told = [mine.evidence(set(items)) for items in batch.column(0).to_pylist()]
            hits = [best in classes for (best, _), classes in zip(told, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([x for _, x in told], pa.float64()), pa.array(hits, pa.bool_())], names=["amount", "hit"])

    found = sentences.select("items", "classes").mapInArrow(run, "amount double, hit boolean").where("amount > 0").toPandas()
    return found["amount"].to_numpy(dtype=float), found["hit"].to_numpy(dtype=bool)


def fit(sample: DataFrame, subjects: list[str]) -> Rules:
    """Rules from a sample (doc_id, content, classes), classes being numbers of subjects."""
    sentences = checkpoint(_sentence_items(sample.select("doc_id", "content", "classes")))
    held = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(HELD)) == 0
    seen = sentences.where(~held)
    share, base = _item_shares(seen, len(subjects))
    mined, rates = _mined(checkpoint(_transactions(seen, _gains(share, base)))) if share else ([], {})
    made = Rules(subjects, _pruned(mined, rates), [1e-9], [0.0, 1.0])
    if made.rules:
        made.edges, made.chance = _calibrated(*_amounts(sentences.where(held), made))
    return made


def _calibrated(amounts: np.ndarray, hits: np.ndarray, per_bin: int = BIN) -> tuple[list[float], list[float]]:
    """Steps from evidence to probability: shares of hits in equal bins of held-out sentences, neighbours that fall joined (isotonic
    regression), against the surest bin's."""
    bins = min(100, len(amounts) // per_bin)
    if bins < 2:
        return [1e-9], [0.0, 1.0]
    edges = np.unique(np.quantile(amounts, np.arange(1, bins) / bins))
    where = np.searchsorted(edges, amounts, side="right")
    blocks: list[list[float]] = []  # hits, sentences, bins
    for k in range(len(edges) + 1):
        blocks.append([float(hits[where == k].sum()), float((where == k).sum()), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last)]
    share = np.concatenate([np.full(int(n), h / max(m, 1.0)) for h, m, n in blocks])
    return [1e-9, *edges.tolist()], [0.0, *(share / max(share[-1], 1e-9)).tolist()]


def _sentence_items(rows: DataFrame) -> DataFrame:
    """(doc_id, sent_no, items, classes) of the sentences of rows (doc_id, content, classes), headings left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter()
        for batch in batches:
            out: list[tuple] = []
            for doc, text, classes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans = splitter.split(text)
                out += [(doc, n, sorted(items_of(text[a:b])), classes) for n, ((a, b), head) in enumerate(zip(spans, splitter.headings if spans else [])) if not head]
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=["doc_id", "sent_no", "items", "classes"])

    return rows.mapInArrow(run, "doc_id long, sent_no int, items array<string>, classes array<int>")


def labelled(documents: DataFrame, labels: DataFrame, subjects: DataFrame, sample: int) -> tuple[DataFrame, list[str]]:
    """((doc_id, content, classes) of about `sample` labelled documents, names of the subjects)."""
    rows = sorted(tuple(r) for r in subjects.where("subject is not null").select("subject", "title", "title_ru").distinct().collect())  # the subject areas to use
    names = [r[0] for r in rows]
    number = {s: i for i, s in enumerate(names)}
    by_name = domain_names(rows)
    known = F.create_map(*[x for name, s in sorted(by_name.items()) for x in (F.lit(name), F.lit(number[s]))])
    given = F.create_map(*[x for s, i in number.items() for x in (F.lit(s), F.lit(i))])
    annotated = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.array_compact(F.collect_set(given[F.col("subject")])).alias("said"))
    docs = documents.where("doc_id is not null and content is not null").select(F.col("doc_id").cast("long"), "content", known[F.lower(F.trim("domain"))].alias("named"))
    told = docs.join(annotated, "doc_id", "left")
    size = told.agg(F.sum(F.col("said").isNotNull().cast("int")).alias("said"), F.sum((F.col("said").isNull() & F.col("named").isNotNull()).cast("int")).alias("named")).first()
    first = min(1.0, sample / max(size["said"] or 0, 1))
    then = min(1.0, max(0, sample - (size["said"] or 0)) / max(size["named"] or 0, 1))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    drawn = told.where(place <= F.when(F.col("said").isNotNull(), first).when(F.col("named").isNotNull(), then).otherwise(-1.0))
    return drawn.select("doc_id", "content", F.coalesce("said", F.array("named")).alias("classes")), names


def train(documents: DataFrame, labels: DataFrame, subjects: DataFrame, sample: int = SAMPLE) -> Rules:
    drawn, names = labelled(documents, labels, subjects, sample)
    return fit(drawn, names)


def document_subjects(documents: DataFrame, rules: Rules, least: float = QUARTER) -> DataFrame:
    """(doc_id, subject, sentences, of_sentences, share): subjects that at least the share `least` of the sentences deal with."""
    shared = documents.sparkSession.sparkContext.broadcast(rules)  # as large as the bounded sample makes it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, splitter = shared.value, Splitter()
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = splitter.split(text)
                if not spans:
                    continue
                counts: Counter[int] = Counter()
                total = 0
                for (a, b), head in zip(spans, splitter.headings):
                    if head:
                        continue
                    total += 1
                    best, amount = mine.evidence(items_of(text[a:b]))
                    if amount > 0 and mine.probability(amount) >= 0.5:
                        counts[best] += 1
                out += [(doc, mine.subjects[s], n, total, n / total) for s, n in sorted(counts.items()) if n >= least * total - 1e-9]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=["doc_id", "subject", "sentences", "of_sentences", "share"])

    rows = documents.where("doc_id is not null and content is not null").select(F.col("doc_id").cast("long"), "content")
    return rows.mapInArrow(run, "doc_id long, subject string, sentences int, of_sentences int, share double")


def composition(found: DataFrame, documents: DataFrame) -> DataFrame:
    """(subject, documents, share) over the documents with content."""
    n = documents.where("doc_id is not null and content is not null").where(F.col("content").rlike(r"(?U)\S")).agg(F.count("*").alias("n"))
    per = found.groupBy("subject").agg(F.count("*").alias("documents"))
    return per.join(F.broadcast(n)).select("subject", "documents", (F.col("documents") / F.col("n")).alias("share"))
