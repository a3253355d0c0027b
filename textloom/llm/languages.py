"""Problem 3: missing or wrong language labels, and documents of several languages.

Method: string kernels. A sentence is the set of its character n-grams (blended spectrum, n = 1..4, lower case); the
kernel of two sentences is the number of n-grams both have, normalised by the roots of their sizes. One-versus-rest
kernel ridge regression is fitted on Nyström landmarks. As the kernel is linear in the presence of n-grams, the
products with the landmarks collapse to one table of weights (n-gram x language), and a batch of sentences is scored
as the product of its presence matrix with that table.

The model is fitted here, on at most `SAMPLE` documents whose hand-set label names a language, a few of which are
wrong: after a first fit the examples it firmly contradicts are left out. A few sentences of each language, versions
without accents and romanised ones are added, so that every language is known at any size of the sample. Everything
else covers every document.

Documents are cut into sentences, each is scored, and the best path with a price for changing the language gives the
stretches. The confidence is the calibrated probability of the stretch's language.

Defined cases: previews that are null, blank or without words of a language have no stretch; a sentence cut off at the end of a
preview that is shorter than its text makes no stretch of its own; labels that name no known language count as missing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.hashing import codes, mix
from textloom.llm.sentences import _ENDS, Splitter

LANGUAGES = ("en", "ru", "es", "de", "pt", "uk", "zh", "ja", "hi", "th")
SAMPLE = 4000
EXAMPLES_PER_LANGUAGE = 600
LANDMARKS_PER_LANGUAGE = 50
DIM = 1 << 18
ORDERS = (1, 2, 3, 4)
RIDGE = 1e-3
PREVIEW = 600
#: Price of a change of language, in units of log probability, and what a sentence gives at most. A sentence between two of
#: another language pays the price twice, so twice the price stays well below what a sure sentence gives.
CHANGE = 2.75
MOST = 8.0
#: Letters from which a sentence counts in full, and how many letters one of a denser script stands for.
FULL, IDEOGRAPH, SYLLABLE = 30.0, 5, 3
#: A sentence whose best score stays below the first has no language, nor has a text whose mean score stays below the second.
FLOOR, MEAN_FLOOR = 0.15, 0.33

# Names of the ten languages as labels write them.
NAMES = {
    "en": "en eng english английский англійська inglés ingles inglês englisch anglais",
    "ru": "ru rus russian русский російська ruso russo russisch",
    "es": "es spa spanish español espanol espanhol испанский іспанська spanisch castellano",
    "de": "de deu ger german deutsch немецкий німецька alemán aleman alemão",
    "pt": "pt por portuguese português portugues португальский португальська portugués portugiesisch",
    "uk": "uk ukr ukrainian українська украинский ucraniano ukrainisch",
    "zh": "zh zho chi cmn chinese 中文 汉语 漢語 китайский китайська chino chinês chinesisch",
    "ja": "ja jpn japanese 日本語 японский японська japonés japonês japanisch",
    "hi": "hi hin hindi हिन्दी हिंदी хинди гінді",
    "th": "th tha thai ไทย ภาษาไทย тайский тайська tailandés tailandês",
}
# A few plain sentences of our own in each language.
SEEDS = {
    "en": "The house by the river was sold last year, and nobody knows who lives there now. It is not clear why they did this. For this reason we have to wait until the end of the month. Most of the people who came were from other towns.",
    "ru": "Дом у реки продали в прошлом году, и никто не знает, кто там теперь живёт. Непонятно, почему они это сделали. По этой причине нам нужно ждать до конца месяца. Большинство людей приехали из других городов.",
    "es": "La casa junto al río se vendió el año pasado y nadie sabe quién vive allí ahora. No está claro por qué lo hicieron. Por eso tenemos que esperar hasta el final del mes. La mayoría de las personas vinieron de otras ciudades.",
    "de": "Das Haus am Fluss wurde letztes Jahr verkauft, und niemand weiß, wer jetzt dort wohnt. Es ist nicht klar, warum sie das getan haben. Deshalb müssen wir bis zum Ende des Monats warten. Die meisten Leute kamen aus anderen Städten.",
    "pt": "A casa junto ao rio foi vendida no ano passado e ninguém sabe quem mora lá agora. Não está claro por que fizeram isso. Por isso temos de esperar até ao fim do mês. A maioria das pessoas veio de outras cidades.",
    "uk": "Будинок біля річки продали минулого року, і ніхто не знає, хто там тепер живе. Незрозуміло, чому вони це зробили. Через це нам треба чекати до кінця місяця. Більшість людей приїхали з інших міст.",
    "zh": "河边的房子去年卖掉了，没有人知道现在谁住在那里。不清楚他们为什么这样做。因此我们必须等到月底。大多数人来自其他城市。",
    "ja": "川のそばの家は去年売られて、今だれが住んでいるのか分からない。なぜそうしたのかは明らかではない。そのため月末まで待たなければならない。多くの人はほかの町から来た。",
    "hi": "नदी के किनारे वाला घर पिछले साल बिक गया और कोई नहीं जानता कि अब वहाँ कौन रहता है। यह साफ़ नहीं है कि उन्होंने ऐसा क्यों किया। इसलिए हमें महीने के अंत तक इंतज़ार करना होगा। ज़्यादातर लोग दूसरे शहरों से आए थे।",
    "th": "บ้านริมแม่น้ำถูกขายไปเมื่อปีที่แล้วและไม่มีใครรู้ว่าตอนนี้ใครอาศัยอยู่ที่นั่น ไม่ชัดเจนว่าทำไมพวกเขาจึงทำเช่นนี้ ดังนั้นเราต้องรอจนถึงสิ้นเดือน คนส่วนใหญ่มาจากเมืองอื่น",
}
_CYRILLIC = "а a б b в v г g ґ g д d е e ё e є ye ж zh з z и i і i ї yi й y к k л l м m н n о o п p р r с s т t у u ф f х h ц ts ч ch ш sh щ shch ъ  ы y ь ' э e ю yu я ya"
_BY_NAME = {name: code for code, names in NAMES.items() for name in names.split()}
_WORDS = re.compile(r"[^\W\d_]+")


def named_language(label: str | None) -> str | None:
    """The code a label means, None if it names none of the languages."""
    if not label:
        return None
    low = unicodedata.normalize("NFC", label.strip().lower())
    return _BY_NAME.get(low) or _BY_NAME.get(re.split(r"[-_ (,;/]", low)[0])


def romanised(text: str) -> str:
    parts = _CYRILLIC.split(" ")
    table = dict(zip(parts[::2], parts[1::2]))
    return "".join(table.get(c, c) for c in text.lower())


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


_SPACE = re.compile(r"[\W\d_]+")
_IDEOGRAPHS = re.compile(r"[぀-ヿ㐀-鿿]")
_SYLLABLES = re.compile(r"[ऀ-ॿ฀-๿]")
_MARKS = re.compile(r"[\s\d_!-/:-@\[-`{-~«»“”„…—–。，、！？（）「」]+")


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): the distinct n-grams of each text, hashed to `DIM` values; text k has hashes[starts[k]:starts[k+1]]."""
    padded = [" " + _MARKS.sub(" ", t.lower()).strip() + " " for t in texts]
    sizes = np.array([len(p) for p in padded], dtype=np.int64)
    points = codes("".join(padded)).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    keys = []
    rolling = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        rolling = rolling[:m] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            inside = owner[:m] == owner[n - 1 :]
            keys.append((owner[:m] * DIM + (mix(rolling) >> np.uint64(46)).astype(np.int64))[inside])
    flat = np.sort(np.concatenate(keys)) if keys else np.empty(0, dtype=np.int64)
    flat = flat[np.flatnonzero(np.diff(flat, prepend=-1))]
    starts = np.searchsorted(flat, np.arange(len(texts) + 1, dtype=np.int64) * DIM)
    return flat & (DIM - 1), starts


def _sums(table: np.ndarray, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Presence matrix of the texts times the table."""
    out = np.zeros((len(starts) - 1, table.shape[1]), dtype=table.dtype)
    step = max(1, 4_000_000 // table.shape[1])
    k = 0
    while k < len(starts) - 1:
        end = int(np.searchsorted(starts, starts[k] + step, side="right")) - 1
        end = min(max(end, k + 1), len(starts) - 1)
        if starts[end] > starts[k]:
            rows = np.flatnonzero(np.diff(starts[k : end + 1])) + k
            out[rows] = np.add.reduceat(table[hashes[starts[k] : starts[end]]], starts[rows] - starts[k], axis=0)
        k = end
    return out


def _extent(text: str, letters: int) -> int:
    """Letters of a text, as many as it would have in an alphabet."""
    return letters + (IDEOGRAPH - 1) * len(_IDEOGRAPHS.findall(text)) + (SYLLABLE - 1) * len(_SYLLABLES.findall(text))


@dataclass
class Model:
    weights: np.ndarray
    sharpness: float

    def scores(self, texts: list[str]) -> np.ndarray:
        hashes, starts = grams(texts)
        return _sums(self.weights, hashes, starts) / np.sqrt(np.maximum(np.diff(starts), 1))[:, None]

    def log_probabilities(self, scores: np.ndarray) -> np.ndarray:
        z = scores * self.sharpness
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _ridge(hashes: np.ndarray, starts: np.ndarray, labels: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Weights of the n-grams: kernel ridge regression on Nyström landmarks, collapsed."""
    sizes = np.sqrt(np.maximum(np.diff(starts), 1))
    marks = np.concatenate([rng.permutation(np.flatnonzero(labels == c))[:LANDMARKS_PER_LANGUAGE] for c in range(len(LANGUAGES))])
    used = np.unique(np.concatenate([hashes[starts[i] : starts[i + 1]] for i in marks]))
    place = np.full(DIM, len(used), dtype=np.int64)
    place[used] = np.arange(len(used))
    inner = place[hashes]
    kernel = np.empty((len(labels), len(marks)), dtype=np.float32)
    for k in range(0, len(marks), 64):
        block = np.zeros((len(used) + 1, len(marks[k : k + 64])), dtype=np.float32)
        for j, i in enumerate(marks[k : k + 64]):
            block[inner[starts[i] : starts[i + 1]], j] = 1 / sizes[i]
        kernel[:, k : k + 64] = _sums(block, inner, starts) / sizes[:, None]
    weight = 1 / np.sqrt(np.maximum(np.bincount(labels, minlength=len(LANGUAGES)), 1))[labels]
    target = (labels[:, None] == np.arange(len(LANGUAGES))).astype(np.float64)
    left = kernel.astype(np.float64) * weight[:, None]
    gram = kernel[marks].astype(np.float64)
    alpha = np.linalg.solve(kernel.T.astype(np.float64) @ left + RIDGE * weight.sum() * gram + 1e-6 * np.eye(len(marks)), left.T @ target)
    table = np.zeros((DIM, len(LANGUAGES)), dtype=np.float64)
    for j, i in enumerate(marks):
        table[hashes[starts[i] : starts[i + 1]]] += alpha[j] / sizes[i]
    return table.astype(np.float32)


def fit(labelled: list[tuple[str, str]]) -> Model:
    """A model from (text, label) pairs; texts are cut into sentences, labels name languages and may be wrong now and then."""
    rng = np.random.default_rng(5)
    splitter = Splitter()
    by: dict[str, list[str]] = {c: [] for c in LANGUAGES}
    for text, label in labelled:
        code = named_language(label)
        if code and len(by[code]) < 3 * EXAMPLES_PER_LANGUAGE:
            by[code] += [text[a:b] for a, b in splitter.split(text) if b - a >= 12]
    texts: list[str] = []
    labels: list[int] = []
    for k, code in enumerate(LANGUAGES):
        mine = [by[code][i] for i in rng.permutation(len(by[code]))[:EXAMPLES_PER_LANGUAGE]]
        seeds = [SEEDS[code][a:b] for a, b in splitter.split(SEEDS[code])]
        extra = []
        if code in ("es", "pt", "de"):
            extra = [_plain(t) for t in seeds + mine[:200]]
        if code in ("ru", "uk"):
            extra = [romanised(t) for t in seeds + mine[:400] if re.search("[а-яіїєґ]", t.lower())]
        all_of = seeds * 3 + mine + extra
        texts += all_of
        labels += [k] * len(all_of)
    y = np.array(labels)
    hashes, starts = grams(texts)
    model = Model(_ridge(hashes, starts, y, rng), 1.0)
    scores = _sums(model.weights, hashes, starts) / np.sqrt(np.maximum(np.diff(starts), 1))[:, None]
    own = scores[np.arange(len(y)), y]
    keep = scores.max(axis=1) - own < 0.2
    index = np.flatnonzero(keep)
    hashes, starts = grams([texts[i] for i in index])
    y = y[index]
    sharpness = _held_out_sharpness([texts[i] for i in index], y)
    return Model(_ridge(hashes, starts, y, rng), sharpness)


def _held_out_sharpness(texts: list[str], labels: np.ndarray) -> float:
    """How sharp probabilities are to be, judged on every fifth example by a model fitted on the others."""
    held = np.arange(len(labels)) % 5 == 0
    rest = np.flatnonzero(~held)
    model = Model(_ridge(*grams([texts[i] for i in rest]), labels[rest], np.random.default_rng(5)), 1.0)
    scores, y = model.scores([texts[i] for i in np.flatnonzero(held)]), labels[held]
    fits = []
    for model.sharpness in (4.0, 6.0, 8.0, 10.0, 12.0, 16.0, 20.0):
        fits.append((model.log_probabilities(scores)[np.arange(len(y)), y].mean(), model.sharpness))
    return max(fits)[1]


def stretches(model: Model, splitter: Splitter, texts: list[str | None], cut: list[bool] | None = None) -> list[list[tuple[int, int, int, float]]]:
    """(start, end, language, confidence) of the maximal stretches of each text; `cut` tells which texts are beginnings of longer ones."""
    cut = cut or [False] * len(texts)
    spans = [splitter.split(t) for t in texts]
    pieces = [t[a:b] for t, s in zip(texts, spans) for a, b in s]
    if not pieces:
        return [[] for _ in texts]
    scores = model.scores(pieces)
    best = scores.max(axis=1)
    logs = np.maximum(model.log_probabilities(scores), -MOST)
    letters = np.array([sum(map(len, _WORDS.findall(p))) for p in pieces])
    speaks = (best >= FLOOR) & (letters >= 3)
    first = scores.argmax(axis=1)
    strength = np.minimum(np.array([_extent(p, n) for p, n in zip(pieces, letters)]) / FULL, 1.0)
    out: list[list[tuple[int, int, int, float]]] = []
    at = 0
    for text, mine, part in zip(texts, spans, cut):
        index = [at + k for k in range(len(mine)) if speaks[at + k]]
        at0, at = at, at + len(mine)
        if not index or np.average(best[index], weights=letters[index]) < MEAN_FLOOR:
            out.append([])
            continue
        path = [int(first[i]) for i in index]
        if len(set(path)) > 1:
            path = _path(logs[index] * strength[index][:, None])
            broken = part and not _ENDS.search(text[mine[index[-1] - at0][0] : mine[index[-1] - at0][1]])
            if broken and len(path) > 1 and path[-1] != path[-2]:
                path, index = path[:-1], index[:-1]
        merged: list[tuple[int, int, int, float]] = []
        k = 0
        while k < len(path):
            j = k
            while j + 1 < len(path) and path[j + 1] == path[k]:
                j += 1
            mean = logs[index[k : j + 1]].mean(axis=0)
            e = np.exp(mean - mean.max())
            merged.append((mine[index[k] - at0][0], mine[index[j] - at0][1], path[k], float(e[path[k]] / e.sum())))
            k = j + 1
        out.append(merged)
    return out


def _path(gain: np.ndarray) -> list[int]:
    """The best sequence of languages when every change costs CHANGE."""
    total, back = gain[0].copy(), []
    for row in gain[1:]:
        top = int(total.argmax())
        change = total[top] - CHANGE
        move = total < change
        back.append(np.where(move, top, np.arange(len(total))))
        total = np.maximum(total, change) + row
    path = [int(total.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def train(documents: DataFrame, text: str = "text_preview", label: str = "true_language", sample: int = SAMPLE) -> Model:
    """Fits the model on about `sample` labelled documents, drawn by a hash of the id."""
    labelled = documents.where(F.col(text).isNotNull() & F.col(label).isNotNull() & (F.length(F.trim(label)) > 0))
    n = labelled.count()
    share = min(1.0, sample / max(n, 1))
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
    rows = drawn.select(F.substring(text, 1, PREVIEW), label, "doc_id").limit(2 * sample).collect()
    return fit([(r[0], r[1]) for r in sorted(rows, key=lambda r: (r[2] is None, r[2]))])


def languages(documents: DataFrame, text: str = "text_preview", label: str = "true_language", model: Model | None = None, whole: str = "n_chars", every: bool = False) -> DataFrame:
    """(doc_id, seg_no, seg_start, seg_end, lang, confidence, is_case) of every stretch of every document.

    is_case: the label is missing, names another language than the text's, or the text has stretches in several. `whole` names the column
    with the length of the whole text, if there is one: where it is greater, the text is a beginning and its last sentence may be
    cut off. With `every`, documents without a stretch have one row too, without a language and with confidence 0."""
    model = model or train(documents, text, label)
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.sharpness))  # DIM x 10 numbers, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, splitter = Model(*shared.value), Splitter()
        for batch in batches:
            ids, labels = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            texts, cuts = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            for k in range(0, len(ids), 1000):
                rows = []
                for doc, given, parts in zip(ids[k : k + 1000], labels[k : k + 1000], stretches(mine, splitter, texts[k : k + 1000], cuts[k : k + 1000])):
                    if every and not parts:
                        rows.append((doc, 1, None, None, None, 0.0, False))
                    case = len({p[2] for p in parts}) > 1 or bool(parts) and named_language(given) != LANGUAGES[parts[0][2]]
                    rows += [(doc, n, a, b, LANGUAGES[c], p, case) for n, (a, b, c, p) in enumerate(parts, 1)]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["doc_id", "seg_no", "seg_start", "seg_end", "lang", "confidence", "is_case"])

    cut = F.coalesce(F.col(whole) > F.length(text), F.lit(False)) if whole in documents.columns else F.lit(False)
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col(text).alias("text"), F.col(label).alias("label"), cut.alias("cut"))
    return rows.mapInArrow(run, "doc_id long, seg_no int, seg_start int, seg_end int, lang string, confidence double, is_case boolean")
