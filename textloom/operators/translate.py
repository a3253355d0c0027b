"""English-German translation with a dictionary: lookup, phrases, direct and transfer method, frequency dictionary, chunk trees.

A text is a table of tokens: (id, span, j, gap, word), `gap` being what stands before the word. Sentences and whatever lies
between them are numbered spans that tile the text; a span ends with a token without a word, whose gap is the rest. Tags,
dictionary entries and phrases are joined to the tokens, and the output is put together from them in order, so no
dictionary is gathered anywhere and no word is handled outside the engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import words
from textloom.functions.text import SPACE, WORD_RX, let, meaning, strip, translation_spans, word_forms
from textloom.session import checkpoint, small

#: Rows of phrases up to which they are broadcast.
BROADCAST_ROWS = 100_000
#: Words a phrase of the dictionary has.
PHRASE_WORDS = (2, 3, 4)
#: Any other tagger: the tags of the words of one sentence.
Tagger = Callable[[list[str]], list[str]]
#: Tiles of a text: sentences, unfinished lines with their line break, stray marks.
_TILE = r"[^.!?\n]+(?:[.!?]+|$)|[^.!?\n]*\n|[.!?]+"


def overlay(entries: DataFrame, domain: str) -> DataFrame:
    """(english, pos, german) in effect for a domain: its entries before the general ones, but an empty translation
    hides none. Of equal keys the first by id counts."""
    mine = entries.where(F.col("domain").isin("general", domain) & F.col("english").isNotNull())
    keyed = mine.select("english", F.col("pos_tag").alias("pos"), F.coalesce("german", F.lit("")).alias("german"), "domain", "id")
    order = W.partitionBy("english", "pos").orderBy((F.col("german") != "").desc(), (F.col("domain") == domain).desc(), "id")
    return keyed.withColumn("r", F.row_number().over(order)).where("r = 1").select("english", "pos", "german", "id")


def lookup(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, tag, german) of distinct (word, tag): the entry of the first form and key in order that has a translation:
    for each form the tag itself, any tag (*), then the tags it can fall back on; after all of these the form under
    whatever tag, in the order of the entries. Empty where nothing is found."""
    asked = tokens.select("word", "tag").distinct()
    forms = asked.select("word", "tag", F.posexplode(word_forms(F.col("word"))).alias("form_no", "form"))
    fallback = F.create_map(*[x for tag, others in words.TAG_FALLBACKS.items() for x in (F.lit(tag), F.array(*[F.lit(o) for o in others]))])
    keys = F.concat(F.array(F.col("tag"), F.lit("*")), F.coalesce(F.try_element_at(fallback, F.col("tag")), F.array().cast("array<string>")))
    exact = forms.select("word", "tag", "form_no", "form", F.posexplode(keys).alias("key_no", "pos"))
    full = dictionary.where("german <> ''")
    first = exact.join(full, (exact["form"] == full["english"]) & (exact["pos"] == full["pos"])).select("word", "tag", F.struct(F.lit(0).alias("pass"), "form_no", F.col("key_no").cast("long").alias("k")).alias("rank"), "german")
    other = forms.join(full, forms["form"] == full["english"]).select("word", "tag", F.struct(F.lit(1).alias("pass"), "form_no", F.col("id").alias("k")).alias("rank"), "german")
    found = first.unionByName(other).groupBy("word", "tag").agg(F.min_by("german", "rank").alias("german"))
    return asked.join(found, ["word", "tag"], "left").select("word", "tag", F.coalesce("german", F.lit("")).alias("german"))


# Endings and the tags they suggest, the first that fits.
_ENDINGS = (("ing", "VBG"), ("ed", "VBD"), ("ly", "RB"), ("ous", "JJ"), ("ful", "JJ"), ("ive", "JJ"), ("able", "JJ"), ("ical", "JJ"), ("est", "JJS"), ("s", "NNS"))
# Closed classes of English.
_CLOSED = {
    "DT": "a an the this that these those each every some any no",
    "IN": "in on at of by for from with to because although while if as since until after before under over near",
    "PRP": "i you he she it we they me him us them",
    "PRP$": "my your his her its our their",
    "MD": "can could may might must shall should will would",
    "CC": "and or but nor yet",
    "VBZ": "is has does",
    "VBP": "are have do am",
    "VBD": "was were had did",
    "RB": "not very also only never always often",
    "WP": "who what",
    "WRB": "when where why how",
}


def tokens(texts: DataFrame) -> DataFrame:
    """(id, span, j, gap, word) of texts (id, text): the tokens of every span in order. Outside sentences `word` is null."""

    def cut(parts: Column) -> Column:
        """parts: gap, word, gap, word, ..., gap; null is past the end."""
        places = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / 2).cast("int"))
        return F.transform(places, lambda i: F.struct(F.get(parts, 2 * i).alias("gap"), F.get(parts, 2 * i + 1).alias("word")))

    every = lambda c, rx: F.regexp_extract_all(c, F.lit(rx), F.lit(0))
    spans = texts.where("text is not null").select(F.col("id").cast("long"), F.posexplode(every("text", _TILE)).alias("span", "s"))
    sentence = F.col("s").rlike(r"^[^.!?\n]") & ~F.col("s").endswith("\n") & F.col("s").rlike("[A-Za-z]")
    inner = every(F.col("s"), f"{WORD_RX}|[^A-Za-z]+")
    parts = F.when(~sentence, F.array("s")).when(F.col("s").rlike("^[A-Za-z]"), F.concat(F.array(F.lit("")), inner)).otherwise(inner)
    closed = let(parts, lambda p: F.when(F.size(p) % 2 == 0, F.concat(p, F.array(F.lit("")))).otherwise(p))
    return spans.select("id", "span", F.posexplode(let(closed, cut)).alias("j", "t")).select("id", "span", "j", "t.gap", "t.word")


def known_tags(dictionary: DataFrame) -> DataFrame:
    """(word, tag): the tag of the first one-word entry of each word that names one."""
    named = dictionary.where("pos <> '*' and not contains(english, ' ')")
    return named.groupBy(F.col("english").alias("word")).agg(F.min_by("pos", "id").alias("tag"))


def tagged(toks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The tokens with `tag`: closed classes, the dictionary's tags (an added s makes nouns plural and verbs third person),
    names by a capital inside a sentence, then endings. Decided once for every distinct word and joined to the tokens."""
    closed = F.create_map(*[F.lit(x) for tag, ws in _CLOSED.items() for w in ws.split() for x in (w, tag)])
    known = known_tags(dictionary)
    low = F.col("low")
    shorter = lambda n: F.when(low.endswith("s"), F.left(low, F.length(low) - n))
    seen = toks.where("word is not null").select(F.lower("word").alias("low")).distinct()
    seen = seen.join(known.toDF("low", "t0"), "low", "left")
    for n in (1, 2):
        seen = seen.withColumn("base", shorter(n)).join(known.toDF("base", f"t{n}").where(F.col(f"t{n}").isin("NN", "VB")), "base", "left").drop("base")
    base = F.coalesce("t1", "t2")
    sure = F.coalesce(F.try_element_at(closed, low), "t0", F.when(base == "NN", "NNS").when(base == "VB", "VBZ"))
    ending = F.lit("NN")
    for suffix, tag in reversed(_ENDINGS):
        ending = F.when(low.endswith(suffix) & (F.length(low) > len(suffix) + 2), tag).otherwise(ending)
    facts = seen.select("low", sure.alias("sure"), ending.alias("ending"))
    capital = F.when(F.col("word").rlike("^[A-Z]") & (F.col("j") > 0), "NNP")
    return toks.withColumn("low", F.lower("word")).join(facts, "low", "left").withColumn("tag", F.when(F.col("word").isNotNull(), F.coalesce("sure", capital, "ending"))).drop("sure", "ending")


def tagged_by(toks: DataFrame, tagger: Tagger) -> DataFrame:
    """The tokens with the tags of another tagger, which gets the words of one sentence at a time, in Arrow batches."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = [list(tagger(ws)) for ws in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(tags, pa.list_(pa.string()))], names=["id", "span", "tags"])

    in_order = F.transform(F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("j", "word")))), lambda x: x["word"])
    lists = toks.groupBy("id", "span").agg(in_order.alias("ws")).where("size(ws) > 0")
    tags = lists.mapInArrow(run, "id long, span int, tags array<string>").select("id", "span", F.posexplode("tags").alias("j", "tag"))
    return toks.withColumn("low", F.lower("word")).join(tags, ["id", "span", "j"], "left")


def words_seen(toks: DataFrame) -> DataFrame:
    """(id, pos, word, tag) of tagged tokens; word in lower case, pos in the order of the text."""
    return toks.where("word is not null").select("id", (F.col("span").cast("long") * (1 << 32) + F.col("j")).alias("pos"), F.col("low").alias("word"), "tag")


def phrases(toks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, span, j, size, phrase): the phrases of the dictionary (entries for any tag) in the text; from the left, the longest first, none over another.

    Overlapping finds form islands, and only inside an island does the order of choosing matter; most hold one find."""
    known = small(dictionary.where("pos = '*' and german <> '' and contains(english, ' ')").select(F.col("english").alias("gram"), F.col("german").alias("phrase")), BROADCAST_ROWS)
    firsts = small(known.select(F.substring_index("gram", " ", 1).alias("low")).distinct(), BROADCAST_ROWS)
    low = toks.select("id", "span", "j", "gap", F.lower("word").alias("low"))
    # Only spans with the first word of a phrase are looked at further.
    near = low.join(low.join(firsts, "low").select("id", "span").distinct(), ["id", "span"], "left_semi")
    following = W.partitionBy("id", "span").orderBy("j")
    grams, joined = [], F.col("low")
    for n in range(1, PHRASE_WORDS[-1]):
        joined = F.when(F.lead("gap", n).over(following).rlike(f"^{SPACE}+$"), F.concat(joined, F.lit(" "), F.lead("low", n).over(following)))
        grams.append(joined)
    at = near.select("id", "span", "j", F.array_compact(F.array(*grams)).alias("grams")).select("id", "span", "j", F.explode("grams").alias("gram"))
    found = at.join(known, "gram").select("id", "span", "j", (F.size(F.split("gram", " "))).alias("size"), "phrase")
    longest = found.groupBy("id", "span", "j").agg(F.max(F.struct("size", "phrase")).alias("m")).select("id", "span", "j", "m.size", "m.phrase")
    order = W.partitionBy("id", "span").orderBy("j")
    before = F.max(F.col("j") + F.col("size")).over(order.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    marked = longest.withColumn("new", F.when(F.col("j") < before, 0).otherwise(1)).withColumn("island", island)
    grouped = marked.groupBy("id", "span", "island").agg(F.array_sort(F.collect_list(F.struct("j", "size", "phrase"))).alias("finds"))
    nothing = F.struct(F.lit(-1).alias("end"), F.filter("finds", lambda x: F.lit(False)).alias("kept"))
    step = lambda acc, x: F.when(x["j"] < acc["end"], acc).otherwise(F.struct((x["j"] + x["size"]).alias("end"), F.concat(acc["kept"], F.array(x)).alias("kept")))
    return grouped.select("id", "span", F.explode(F.aggregate("finds", nothing, step, lambda acc: acc["kept"])).alias("f")).select("id", "span", "f.j", "f.size", "f.phrase")


def _capital(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, F.lit(2), F.length(text)))


def _looked_up(toks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Tokens with `german` (empty if unknown), and with `size` and `phrase` where a phrase begins; `inner` inside one."""
    entries = lookup(words_seen(toks), dictionary).withColumnRenamed("word", "low")
    full = toks.join(entries, ["low", "tag"], "left").join(phrases(toks, dictionary), ["id", "span", "j"], "left")
    covered = F.max(F.col("j") + F.col("size")).over(W.partitionBy("id", "span").orderBy("j").rowsBetween(W.unboundedPreceding, -1))
    return full.withColumn("inner", F.col("word").isNotNull() & (F.coalesce(covered, F.lit(0)) > F.col("j")))


def _joined(pieces: Column) -> Column:
    """Texts of structs (place, text), in the order of the places."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(pieces)), lambda x: x["text"]), "")


def translate(texts: DataFrame, dictionary: DataFrame, method: str = "transfer", tagger: Tagger | None = None) -> DataFrame:
    """(id, translated_text, word_count, translated_count, seen, unknown) of texts (id, text); seen and unknown are sorted arrays of
    (word, tag). Nouns get a capital, unknown words are shown as [[word]].

    The direct method puts the German in place of each word or phrase and leaves the rest of the text as it is; words that begin a
    sentence with a capital keep it. The transfer method gives the sentences only: after a subordinating conjunction the finite
    verb goes last, and each begins with a capital. Unknown are, for the direct method, words outside phrases, else all.
    Null texts and texts without words give empty results; ids are taken to be unique."""
    if method not in ("transfer", "direct"):
        raise ValueError(f"no such method: {method}")
    toks = checkpoint(tokens(texts))  # read by tags, entries, phrases and the text itself
    toks = checkpoint(tagged_by(toks, tagger) if tagger else tagged(toks, dictionary))
    full = checkpoint(_looked_up(toks, dictionary))
    is_word = F.col("word").isNotNull()
    noun = F.col("tag").startswith("NN")
    capital = noun | (F.col("word").rlike("^[A-Z]") & (F.col("j") == 0)) if method == "direct" else noun
    unknown = F.col("german") == ""
    single = F.when(unknown, F.concat(F.lit("[["), F.col("word"), F.lit("]]"))).when(capital, _capital(F.col("german"))).otherwise(F.col("german"))
    shown = F.coalesce("phrase", single)
    text = _direct(full, shown) if method == "direct" else _transfer(full, shown)
    pair = F.struct(F.col("low").alias("word"), "tag")
    asked = is_word & unknown & (~F.col("inner") & F.col("phrase").isNull() if method == "direct" else F.lit(True))
    counts = full.groupBy("id").agg(
        F.sum(is_word.cast("int")).cast("int").alias("word_count"),
        F.sum(F.when(F.col("phrase").isNotNull(), F.col("size")).when(is_word & ~F.col("inner") & ~unknown, 1).otherwise(0)).cast("int").alias("translated_count"),
        F.array_sort(F.collect_set(F.when(is_word, pair))).alias("seen"),
        F.array_sort(F.collect_set(F.when(asked, pair))).alias("unknown"),
    )
    none = F.array().cast("array<struct<word:string,tag:string>>")
    return texts.select(F.col("id").cast("long")).join(counts, "id", "left").join(text, "id", "left").select(
        "id", F.coalesce("translated_text", F.lit("")).alias("translated_text"), F.coalesce("word_count", F.lit(0)).alias("word_count"), F.coalesce("translated_count", F.lit(0)).alias("translated_count"),
        F.coalesce("seen", none).alias("seen"), F.coalesce("unknown", none).alias("unknown"),
    )


def _direct(full: DataFrame, shown: Column) -> DataFrame:
    piece = F.when(F.col("word").isNull(), F.col("gap")).otherwise(F.concat("gap", shown))
    place = F.struct("span", "j", piece.alias("text"))
    return full.where("not inner").groupBy("id").agg(strip(_joined(place)).alias("translated_text"))


def _transfer(full: DataFrame, shown: Column) -> DataFrame:
    """Sentences by themselves first, then the sentences of a text in order."""
    finite = (F.col("tag") == "MD") | F.col("tag").startswith("VB")
    unit = F.when(F.col("word").isNotNull(), F.struct("j", shown.alias("text"), (finite & F.col("phrase").isNull()).alias("verb"), F.when(F.col("phrase").isNull(), F.col("low")).alias("low")))
    rest = F.max(F.when(F.col("word").isNull(), F.col("gap")))
    # A sentence's rest holds its final marks; between words there are none.
    spans = full.where("not inner").groupBy("id", "span").agg(F.array_sort(F.collect_list(unit)).alias("units"), rest.alias("rest")).where("size(units) > 0")
    verb = (F.array_position(F.transform("units", lambda u: u["verb"]), True) - 1).cast("int")  # -1 without a verb
    moved = (F.col("verb") > 1) & F.get("units", F.lit(0))["low"].isin("if", "because", "although", "while")
    ordered = F.when(moved, F.concat(F.slice("units", F.lit(1), F.col("verb")), F.slice("units", F.col("verb") + 2, F.size("units")), F.slice("units", F.col("verb") + 1, F.lit(1)))).otherwise(F.col("units"))
    body = F.array_join(F.filter(F.transform(ordered, lambda u: u["text"]), lambda t: t != ""), " ")
    spoken = spans.withColumn("verb", verb).select("id", "span", F.concat(_capital(strip(body)), F.regexp_extract("rest", r"[.!?]+\s*$", 0)).alias("sentence"))
    place = F.struct("span", F.concat("sentence", F.lit(" ")).alias("text"))
    return spoken.groupBy("id").agg(strip(_joined(place)).alias("translated_text"))


def words_of(texts: DataFrame) -> DataFrame:
    """(id, word) of the translator's words of texts (id, text), lower case, by built-in expressions alone."""
    spans = F.explode(translation_spans(F.col("text"))).alias("span")
    found = F.regexp_extract_all("span", F.lit(WORD_RX), F.lit(0))
    return texts.select("id", spans).select("id", F.explode(found).alias("w")).select("id", F.lower("w").alias("word"))


def frequency_dictionary(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, word, frequency, tag, meaning, translation) of tokens (id, pos, word, tag): the tags by their count, then by
    first occurrence, their meanings once each, and the translation of the first tag that has one."""
    by_tag = tokens.groupBy("id", "word", "tag").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    known = lookup(tokens, dictionary)
    rows = by_tag.join(known, ["word", "tag"]).withColumn("meaning", meaning(F.col("tag")))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "first", "tag", "meaning", "german")))
    made = rows.groupBy("id", "word").agg(F.sum("n").alias("frequency"), ordered.alias("tags"))
    return made.select(
        "id", "word", "frequency",
        F.array_join(F.transform("tags", lambda t: t["tag"]), ", ").alias("tag"),
        F.array_join(F.array_distinct(F.transform("tags", lambda t: t["meaning"])), "; ").alias("meaning"),
        F.coalesce(F.get(F.filter(F.transform("tags", lambda t: t["german"]), lambda g: g != ""), F.lit(0)), F.lit("")).alias("translation"),
    )


def new_entries(seen: DataFrame, entries: DataFrame, dictionary: DataFrame, domain: str) -> DataFrame:
    """(english, pos, german, domain) to add for seen (word, tag) that no entry in effect has, with the translation found."""
    known = entries.where(F.col("domain").isin("general", domain)).select(F.col("english").alias("word"), F.col("pos_tag").alias("tag")).distinct()
    missing = seen.select("word", "tag").distinct().join(known, ["word", "tag"], "left_anti")
    return lookup(missing, dictionary).select(F.col("word").alias("english"), F.col("tag").alias("pos"), "german", F.lit(domain).alias("domain"))


def edited(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """The entries with the German of changes (id, german), without white space at its ends; other ids are left out, of equal ones the greatest counts."""
    new = changes.groupBy("id").agg(F.max(strip(F.coalesce("german", F.lit("")))).alias("new"))
    return entries.join(new, "id", "left").withColumn("german", F.coalesce("new", "german")).select(*entries.columns)


def seeded(entries: DataFrame, seeds: DataFrame) -> DataFrame:
    """(english, pos, domain, german) after seeding: missing entries added, empty translations filled, others kept."""
    key = ["english", "pos", "domain"]
    both = entries.select(*key, F.col("german").alias("old")).join(seeds.select(*key, F.col("german").alias("new")), key, "full")
    return both.select(*key, F.when(F.coalesce("old", F.lit("")) != "", F.col("old")).otherwise(F.coalesce("new", "old")).alias("german"))


def dictionary_page(entries: DataFrame, pattern: str = "", missing: bool = False, page: int = 1, size: int = 50) -> DataFrame:
    """One page of entries whose English or German holds the pattern (LIKE's signs keep their meaning), in order."""
    rows = entries
    if pattern:
        rows = rows.where(F.col("english").ilike(f"%{pattern}%") | F.col("german").ilike(f"%{pattern}%"))
    if missing:
        rows = rows.where("german = ''")
    return rows.orderBy("english", "pos_tag", "id").offset((max(1, page) - 1) * size).limit(size)


# The chunk grammar, one pass after the other.
_GRAMMAR = (
    ("NP", r"(?:<(?:DT|PRP\$)>)?(?:<JJ[^>]*>)*(?:<(?:NN[^>]*|PRP)>)+"),
    ("PP", r"<IN><NP>"),
    ("VP", r"(?:<MD>)?(?:<VB[^>]*>)(?:<NP>|<PP>|<RB[^>]*>)*"),
    ("CLAUSE", r"<NP><VP>"),
)


def chunk_tree(tokens: list[str], tags: list[str]) -> str:
    """The sentence as a bracketed tree: noun, prepositional and verb phrases and clauses, each pass over the last one's result."""
    nodes = [(tag, f"{word}/{tag}") for word, tag in zip(tokens, tags)]
    for label, rule in _GRAMMAR:
        coded = "".join(f"<{tag}>" for tag, _ in nodes)
        starts = [m.start() for m in re.finditer("<", coded)]
        out, at = [], 0
        for m in re.finditer(rule, coded):
            first, last = starts.index(m.start()), sum(s < m.end() for s in starts)
            out += nodes[at:first] + [(label, f"({label} {' '.join(n for _, n in nodes[first:last])})")]
            at = last
        nodes = out + nodes[at:]
    return f"(S {' '.join(n for _, n in nodes)})"


def chunk_trees(toks: DataFrame) -> DataFrame:
    """(id, span, tree) of the sentences of tagged tokens, in Arrow batches of whole sentences."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [chunk_tree([x["word"] for x in p], [x["tag"] for x in p]) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(trees, pa.string())], names=["id", "span", "tree"])

    pair = F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("j", "word", "tag"))))
    lists = toks.groupBy("id", "span").agg(pair.alias("p")).where("size(p) > 0")
    return lists.mapInArrow(run, "id long, span int, tree string")


def tree_nodes(tree: str) -> dict:
    """A bracketed tree as nested nodes with the meaning of each label and tag."""
    parts = re.findall(r"\(|\)|[^\s()]+", tree)

    def read(at: int) -> tuple[dict, int]:
        if parts[at] != "(":
            word, _, tag = parts[at].rpartition("/")
            return {"leaf": True, "word": word, "pos": tag, "meaning": words.TAG_MEANINGS.get(tag, words.OTHER_TAG)}, at + 1
        label, at, children = parts[at + 1], at + 2, []
        while parts[at] != ")":
            child, at = read(at)
            children.append(child)
        return {"leaf": False, "label": label, "meaning": words.PHRASE_MEANINGS.get(label, words.OTHER_PHRASE), "children": children}, at + 1

    return read(0)[0]


def report(runs: DataFrame, rows: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """(id, report): a text report of each run (id, title, domain, method, created_at, word_count, translated_count,
    source_text, translated_text) with its frequency dictionary `rows`, most frequent first, — for missing translations."""
    line = F.concat_ws("\t", F.col("frequency").cast("string"), "word", F.when(F.coalesce("translation", F.lit("")) == "", "—").otherwise(F.col("translation")), "tag", "meaning")
    lists = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("frequency")).alias("o"), "word", line.alias("line")))).alias("lines"))
    head = names or {"title": "Title", "domain": "Domain", "method": "Method", "created_at": "Date", "word_count": "Words", "translated_count": "Translated", "source": "Source text", "translation": "Translation", "table": "Frequency dictionary"}
    text = F.concat_ws(
        "\n",
        *[F.concat(F.lit(head[c] + ": "), F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm") if c == "created_at" else F.col(c).cast("string"), F.lit(""))) for c in ("title", "domain", "method", "created_at", "word_count", "translated_count")],
        F.lit(""), F.lit(head["source"] + ":"), F.coalesce("source_text", F.lit("")), F.lit(""), F.lit(head["translation"] + ":"), F.coalesce("translated_text", F.lit("")), F.lit(""), F.lit(head["table"] + ":"),
        F.array_join(F.transform(F.coalesce("lines", F.array()), lambda x: x["line"]), "\n"),
    )
    return runs.join(lists, "id", "left").select("id", text.alias("report"))
