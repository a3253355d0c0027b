"""The operators for training data against brute force, round trips and edge cases on small fixtures."""

import os
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import encode, hashing, languages, mixing, neardup, sentences, setsketch, spans, subjects, termfreq

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
DOC = "doc_id long, text string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


def edited(rng, text, k):
    words = text.split()
    for _ in range(k):
        words[rng.randrange(len(words))] = "new" + str(rng.randint(0, 10**6))
    return " ".join(words)


@pytest.fixture(scope="module")
def family():
    """Originals, copies, edited copies, reorderings and texts that share long passages."""
    rng = random.Random(3)
    rows = []
    for i in range(40):
        base = prose(rng, 60)
        rows.append(base)
        if i % 4 == 0:
            rows += [base, base.upper() + " !!"]
        if i % 3 == 0:
            rows += [edited(rng, base, k) for k in (1, 3, 6)]
        if i % 5 == 0:
            rows.append(prose(rng, 30) + " " + base[:260] + " " + prose(rng, 30))
    rows += ["", None, "short text", "word " * 30, "x" * 500, "y" + "x" * 450, "ab" * 300]
    return list(enumerate(rows, 1))


# --- near duplicates


def shingles(text, size):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return words, {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute_pairs(rows, size, threshold, min_words):
    sets = [(i, *shingles(t, size)) for i, t in rows]
    out = set()
    for x, (i, wi, si) in enumerate(sets):
        for j, wj, sj in sets[x + 1 :]:
            if si and sj and min(len(wi), len(wj)) >= min_words and len(si & sj) >= threshold * len(si | sj) - 1e-9:
                out.add((min(i, j), max(i, j)))
    return out


@pytest.mark.parametrize("size, threshold, least", [(3, 0.6, 20), (5, 0.8, 1)])
def test_pairs_are_those_of_brute_force(spark, family, size, threshold, least):
    docs = spark.createDataFrame(family, DOC)
    got = [tuple(r) for r in neardup.pairs(docs, size, threshold, least).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(family, size, threshold, least)


def test_groups(spark, family):
    docs = spark.createDataFrame(family, DOC)
    pairs = brute_pairs(family, 3, 0.6, 20)
    root = {i: i for i, _ in family}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.doc_id: r.group_id for r in neardup.groups(docs, 3, 0.6, 20).collect()}
    assert got == {i: find(i) for i, _ in family}


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)], "a long, b long")
    got = {r.node: r.root for r in neardup.components(edges).collect()}
    assert got == {i: 1 for i in range(1, 61)}


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    one, other = pool[:2000], pool[1000:]
    parts = [setsketch.sketch(np.unique(x), np.array([0]), 512)[0] for x in (one, other, pool)]
    assert (setsketch.merge(parts[0], parts[1]) == parts[2]).all()
    assert abs(setsketch.cardinality(parts[2]) / 3000 - 1) < 0.15
    j = setsketch.jaccard(parts[0][None], parts[1][None], np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(j - 1 / 3) < 0.08
    assert setsketch.bands_for(0.8, 4, 0.001) < setsketch.bands_for(0.6, 4, 0.001)


def test_unlike_sets_hardly_ever_share_a_band():
    rng = np.random.default_rng(2)
    sizes = rng.integers(18, 400, 1500)
    starts = np.cumsum([0, *sizes[:-1]])
    registers = setsketch.sketch(rng.integers(0, 1 << 63, int(sizes.sum()), dtype=np.uint64), starts, 64)
    one, other = registers[:750], registers[750:]
    equal = np.mean([(one == np.roll(other, k, axis=0)).mean() for k in range(200)])
    bands = setsketch.bands_for(0.6, neardup.ROWS, neardup.MISS)
    assert equal < 6e-4 and bands * equal**neardup.ROWS < 1e-9, "150,000 pairs of sets without a common element, 64 registers each"


def test_neardup_edges(spark):
    empty = spark.createDataFrame([], DOC)
    assert neardup.pairs(empty).count() == 0 and neardup.groups(empty).count() == 0
    same = "one two three four five six seven"
    odd = spark.createDataFrame([(1, same, "r"), (1, same, "r"), (2, same, None), (None, same, "x")], "doc_id long, text string, rep string")
    assert [tuple(r) for r in neardup.pairs(odd).collect()] == [(1, 2)]


# --- spans


def brute_spans(rows, n):
    owner = {}
    for i, t in rows:
        for k in range(len(t or "") - n + 1):
            owner.setdefault(t[k : k + n], set()).add(i)
    out = set()
    for i, t in rows:
        covered = [False] * len(t or "")
        for k in range(len(covered) - n + 1):
            if len(owner[t[k : k + n]]) > 1:
                covered[k : k + n] = [True] * n
        at = 0
        while at < len(covered):
            if covered[at]:
                end = at
                while end < len(covered) and covered[end]:
                    end += 1
                out.add((i, at, end))
                at = end
            at += 1
    return out


@pytest.mark.parametrize("hot, bits", [(4096, 64), (1, 64), (1, 3)])
@pytest.mark.parametrize("n, gram, hashes", [(200, 80, 2), (40, 25, 1), (60, 25, 4)])
def test_spans_are_those_of_brute_force(spark, family, n, gram, hashes, hot, bits):
    docs = spark.createDataFrame(family, DOC)
    got = [tuple(r) for r in spans.shared_spans(docs, n, gram, hot, hashes, bits).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spans(family, n)


def test_compact_windows_are_the_nodes_of_the_tree():
    values = np.random.default_rng(3).integers(0, 1 << 62, 400, dtype=np.uint64)
    values[50:60] = values[50]
    low, node, high = (x.tolist() for x in spans.compact_windows(values, np.array([0, 150]), np.array([150, 250]), 12))
    packed = ((values & ~spans._PLACE) | np.arange(400, dtype=np.uint64)).tolist()
    expected = set()
    for s, e in ((0, 150), (150, 400)):
        for c in range(s, e):
            a, b = c, c
            while a > s and packed[a - 1] > packed[c]:
                a -= 1
            while b + 1 < e and packed[b + 1] > packed[c]:
                b += 1
            if b - a + 1 >= 12:
                expected.add((a, c, b))
    assert set(zip(low, node, high)) == expected and len(node) == len(expected)


def test_spans_across_blocks(spark, monkeypatch):
    rng = random.Random(5)
    a, b = (prose(rng, 150) for _ in range(2))
    texts = [a, b + a[100:500] + b[::-1]]
    whole = spans.segments(texts, 60, 30)
    monkeypatch.setattr(spans, "BLOCK", 300)
    covered = lambda w: {(r, k, s) for r, f, l, s in zip(*(x.tolist() for x in w)) for k in range(f, l + 1)}  # noqa: E731, E741
    assert covered(spans.segments(texts, 60, 30)) == covered(whole)
    assert {r for r, *_ in covered(whole)} == {0, 1} and len(covered(whole)) == sum(len(t) - 59 for t in texts)


def test_span_edges(spark):
    assert spans.shared_spans(spark.createDataFrame([], DOC)).count() == 0
    long = "🙂é" * 150
    odd = spark.createDataFrame([(1, long, 5), (1, long, 5), (2, None, 5), (None, long, 1)], "doc_id long, text string, sig int")
    assert spans.shared_spans(odd).count() == 0
    shares = {r.doc_id: r.shared_share for r in spans.shared_share(odd.unionByName(spark.createDataFrame([(3, long, 0)], odd.schema)).dropDuplicates(["doc_id"])).collect()}
    assert shares == {1: 1.0, 2: 0.0, 3: 1.0}


def test_sliding_minimum_and_hashes():
    values = np.array([5, 3, 8, 1, 9, 2, 7], dtype=np.uint64)
    for width in (1, 2, 3, 5, 7):
        assert hashing.sliding_min(values, width).tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]
    points = hashing.codes("abcabcab")
    grams = hashing.gram_hashes(points, 3)
    assert grams[0] == grams[3] and len(set(grams.tolist())) == 3


# --- encoding


def test_encoding_is_that_of_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(encode.DEFAULT_VOCABULARY)
    library.encode_special_tokens = True
    rng = random.Random(2)
    pool = list(" \n\t\r\x1c\x85 aAeé'stдш漢ก🙂0Ⅷ½_-ing") + ["<|endoftext|>", "'re", "the ", "  "]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", None, "a" * 5000, " " * 300, "<|endoftext|>", "é" * 200]
    docs = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in encode.encode(docs).collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    ranks = encode.TrieBpe(encode.DEFAULT_VOCABULARY.replace(".json", ".tiktoken"))
    assert ranks.encode_batch(texts) == [got[i] for i in range(len(texts))]
    assert encode.encode(spark.createDataFrame([], DOC)).count() == 0
    assert encode.count_tokens(docs, ["doc_id"]).agg(F.sum("n_tokens")).first()[0] == sum(map(len, got.values()))


def test_forgetting_changes_nothing(monkeypatch):
    bpe = encode.TrieBpe()
    first = bpe.encode_batch(["hello world", "hello there"])
    monkeypatch.setattr(encode, "MEMO_PIECES", 1)
    monkeypatch.setattr(encode, "MEMO_PAIRS", 5)
    monkeypatch.setattr(encode, "MEMO_PIECE_CHARS", 3)
    assert bpe.encode_batch(["hello world", "hello there"]) == first
    assert bpe.encode_batch(["new words", "hello world"])[1] == first[0]
    assert len(bpe.fits_memo) <= 5 and all(len(p) <= 3 for p in bpe.memo) and not bpe.long


def test_rank_file_of_many_languages(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = os.path.join(os.path.dirname(encode.DEFAULT_VOCABULARY), "byte_bpe_multi_50k.tiktoken")
    bpe = encode.TrieBpe(path)
    library = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=bpe.ids, special_tokens={})
    texts = ["Das Haus am Fluss — 12,5 %", "Дом у реки продали", "河边的房子去年卖掉了。", "नदी के किनारे", "บ้านริมแม่น้ำ", "naïve café\n\n  x", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    got = {r.doc_id: r.ids for r in encode.encode(docs, vocabulary=path).collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


# --- term frequencies


def test_terms(spark):
    lemmas = [(1, "Cat "), (1, "Cat "), (2, "cat"), (3, None), (4, "é"), (5, "É"), (6, "unused"), (7, "  ")]
    posts = [(1, 1, 1, 2), (1, 1, 1, 2), (2, 1, 2, 1), (3, 2, 2, 1), (4, 2, 3, 9), (5, 2, 4, 1), (6, 3, 5, 1), (7, 3, 99, 5), (8, 3, 1, 0), (9, 3, 1, None), (10, 3, 1, -1), (11, 4, None, 3), (12, 5, 7, 1), (None, 6, 2, 1), (None, 6, 2, 1), (13, None, 2, 4)]
    left = spark.createDataFrame(lemmas, "id long, term string")
    right = spark.createDataFrame(posts, "id long, document_id long, lemma_id long, tf int")
    by_id = {i: unicodedata.normalize("NFC", t.strip().lower()) for i, t in lemmas if t is not None}
    rows = list({p for p in posts if p[0] is not None}) + [p for p in posts if p[0] is None]
    expected = {}
    docs = set()
    for _, doc, lemma, tf in rows:
        if tf and tf > 0 and lemma in by_id:
            entry = expected.setdefault(by_id[lemma], [0, set()])
            entry[0] += tf
            if doc is not None:
                entry[1].add(doc)
                docs.add(doc)
    for how in ({}, {"held": 1, "part": 1}, {"held": 1, "part": 200, "hot_rows": 1}):
        counts, n = termfreq.term_counts(left, right, **how)
        assert {r.term: (r.occurrences, r.documents) for r in counts.collect()} == {t: (a, len(b)) for t, (a, b) in expected.items()}
        assert n == len(docs)
    marks = {(r.term, r.mark) for r in termfreq.found(left, right).collect()}
    assert ("é", "rare") in marks and ("é", "common") in marks and ("cat", "common") in marks and ("cat", "rare") not in marks
    every = {r.term: r.occurrences for r in termfreq.all_terms(left, right).collect()}
    assert every["unused"] == 0 and set(every) == set(by_id.values())
    assert termfreq.found(left.limit(0), right.limit(0)).count() == 0


def test_radix_spills_and_splits_again(tmp_path):
    rng = random.Random(1)
    rows = [{"id": i, "term": rng.choice(WORDS), "document_id": i % 7, "tf": 1, "variants": False} for i in range(5000)]
    radix = termfreq.Radix(str(tmp_path), 0, 2000, 3000)
    for k in range(0, 5000, 100):
        radix.add(pa.RecordBatch.from_pylist(rows[k : k + 100]))
    parts = list(radix.parts())
    terms = [set(p["term"].to_pylist()) for p in parts]
    assert len(parts) > 8 and sum(map(len, terms)) == len(set().union(*terms)) == len(WORDS), "a term lies in one part"
    assert sorted(r["id"] for p in parts for r in p.to_pylist()) == list(range(5000))


# --- mixing


def test_splitting_tree_is_exact():
    counts = np.array([13, 0, 200, 1, 77])
    leaves = [mixing.leaf(counts, 9, i, 4) for i in range(9)]
    assert (leaves[0][0] == 0).all() and (leaves[-1][1] == counts).all()
    assert all((one[1] == other[0]).all() for one, other in zip(leaves, leaves[1:])), "the shards' stretches tile every source's order"
    sizes = [int((end - first).sum()) for first, end in leaves]
    assert max(sizes) - min(sizes) <= 1
    assert (mixing.leaf(counts, 9, 5, 4)[0] == leaves[5][0]).all()


def test_quotas_fill_up_level_by_level():
    targets = {"a": (0.5, 2), "b": (0.3, 1), "c": (0.2, 9), "none": (0.4, 1)}
    got = mixing.quotas({"a": 1000, "b": 100, "c": 10}, targets)
    assert got == {"a": 920, "b": 100, "c": 90}, "b and c give all they can, a the rest"
    assert mixing.quotas({"a": 1000, "b": 100, "c": 10}, targets, exact=True) == {"a": 166, "b": 100, "c": 66}
    assert mixing.quotas({"a": 5, "b": 5, "c": 5}, targets, total=1000) == {"a": 10, "b": 5, "c": 45}
    assert mixing.quotas({"a": 1000, "b": 1000, "c": 1000}, targets, total=100) == {"a": 50, "b": 30, "c": 20}
    assert mixing.quotas({}, targets) == {}


def test_permutations_are_bijections(spark):
    for size in (1, 2, 8, 1024):
        rows = spark.range(size).select(mixing.permuted(F.col("id"), F.lit(size).cast("long"), F.lit(3)).alias("p")).collect()
        assert sorted(r.p for r in rows) == list(range(size))


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, "big" if i <= 300 else "small" if i <= 330 else "odd", prose(rng, rng.randint(5, 40))) for i in range(1, 340)] + [(900, "small", None), (901, "small", ""), (None, "big", "x"), (902, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.6, 2), ("small", 0.3, 3), ("absent", 0.1, 5), ("odd", 0.0, 1)], "source string, target_share double, max_repeats int")
    uses = mixing.mix(docs, targets, exact=True).collect()
    assert len({(r.doc_id, r["pass"]) for r in uses}) == len(uses)
    most, size, source = {}, {}, {}
    for r in uses:
        most[r.doc_id] = most.get(r.doc_id, 0) + 1
        size[r.source] = size.get(r.source, 0) + r.n_tokens
        source[r.doc_id] = r.source
    limit = {"big": 2, "small": 3}
    assert set(size) == {"big", "small"} and all(n <= limit[source[i]] for i, n in most.items())
    assert abs(size["big"] / sum(size.values()) - 2 / 3) < 0.01
    assert {i for i in most if source[i] == "small"} == set(range(301, 331)), "the scarce source is used up"
    assert sorted(map(tuple, mixing.mix(docs, targets, exact=True).collect())) == sorted(map(tuple, uses)), "the same seed gives the same mix"
    report = {r.source: r for r in mixing.shares(docs, targets, exact=True).collect()}
    assert report["absent"].used_tokens == 0 and report["absent"].short_tokens > 0 and report["big"].actual_share == pytest.approx(size["big"] / sum(size.values()))
    smaller = mixing.mix(docs, targets, total=500).agg(F.sum("n_tokens")).first()[0]
    assert 400 < smaller < 600
    full = {r.source: r for r in mixing.shares(docs, targets).collect()}
    everything = sum(encode.encoder().count_batch([t for i, s, t in rows if i and s in ("big", "small", "odd")]).tolist())
    assert abs(sum(r.used_tokens for r in full.values()) - everything) < 100, "by default as many tokens as there are"
    assert full["small"].most_uses <= 3 and full["big"].most_uses <= 2 and full["small"].used_tokens == 3 * size["small"] // 3
    assert mixing.mix(docs.limit(0), targets).count() == 0


# --- sentences


def cut(text):
    return [text[a:b] for a, b in sentences.Splitter().split(text)]


@pytest.mark.parametrize("text, expected", [
    ("Dr. Smith paid 3.5 dollars, e.g. on p. 4. He left!", ["Dr. Smith paid 3.5 dollars, e.g. on p. 4.", "He left!"]),
    ("“Is it ready?” asked Ann. \"Stop!\" cried Bob, but no.", ["“Is it ready?” asked Ann.", "\"Stop!\" cried Bob, but no."]),
    ("“It is done.” Then we left... And came (Why? Nobody knows.) back.", ["“It is done.”", "Then we left...", "And came (Why? Nobody knows.) back."]),
    ("It rose to 5 ... and fell. See https://a.example/p.4?x=1 for more.", ["It rose to 5 ... and fell.", "See https://a.example/p.4?x=1 for more."]),
    ("Am 3. Mai kam Fr. Li in der Gartenstr. 5 an, d. h. spät. Er blieb zum 2. Mal.", ["Am 3. Mai kam Fr. Li in der Gartenstr. 5 an, d. h. spät.", "Er blieb zum 2. Mal."]),
    ("Есть доски, краски и т. д. Убыток — 7 тыс. руб., но в г. Орёл ждут.", ["Есть доски, краски и т. д.", "Убыток — 7 тыс. руб., но в г. Орёл ждут."]),
    ("— Хватит! — крикнул он. «Готово ли это?» — спросил я.", ["— Хватит! — крикнул он.", "«Готово ли это?» — спросил я."]),
    ("«¿Está listo?», preguntó Ana. Trajo mapas, etc. La Dra. Paz salió.", ["«¿Está listo?», preguntó Ana.", "Trajo mapas, etc.", "La Dra. Paz salió."]),
    ("“准备好了吗？”安娜问道，没有。他说：“好。”然后走了。升到5……随后下降。", ["“准备好了吗？”安娜问道，没有。", "他说：“好。”", "然后走了。", "升到5……随后下降。"]),
    ("「はい。」と言った。雨だ！「晴れた。」風だ。", ["「はい。」と言った。", "雨だ！", "「晴れた。」", "風だ。"]),
    ("डॉ. राम आए। “क्या यह ठीक है?” सीता ने पूछा, क्योंकि देर थी।", ["डॉ. राम आए।", "“क्या यह ठीक है?” सीता ने पूछा, क्योंकि देर थी।"]),
    ("ดร.สมชายมา ฝนตกหนักมาก\n\nเขากลับบ้าน", ["ดร.สมชายมา", "ฝนตกหนักมาก", "เขากลับบ้าน"]),
    ("One ended here.Two began", ["One ended here.", "Two began"]),
    ("", []), (None, []), (" \n\t ", []), ("...", ["..."]),
])
def test_sentences(text, expected):
    assert cut(text) == expected


def test_headings_and_wraps():
    line = "The committee met on the first day of the month and talked about the new"
    text = f"9. The Title\n\n{line}\nrules for a while. Nobody was there to\n\nNotes on it\n{line} bridge."
    assert cut(text) == ["9. The Title", f"{line}\nrules for a while.", "Nobody was there to", "Notes on it", f"{line} bridge."]


def test_sentences_cover_everything():
    rng = random.Random(4)
    pool = ["Dr. ", "a. ", "“", "”", "(", ")", "。", "！", "... ", "\n", "\n\n", "word ", "Word ", "3.", "ไทย ", "हिं। ", "«", "»", "? ", " - "]
    for _ in range(400):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        found = sentences.Splitter().split(text)
        assert "".join("".join(text[a:b] for a, b in found).split()) == "".join(text.split())
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:])) and all(text[a:b].strip() == text[a:b] != "" for a, b in found)


def test_unknown_abbreviation_is_learnt_from_the_document():
    known = "We met ald. parker and ald. jones. Later Ald. Smith came."
    assert cut(known)[-1] == "Later Ald. Smith came."
    assert cut("We saw the cold. Smith came.") == ["We saw the cold.", "Smith came."]


def test_names_and_small_words_decide_after_abbreviations():
    ends = "The doctor gave me vitamin C. The cat slept all day. Nobody saw the cat there."
    assert cut(ends) == ["The doctor gave me vitamin C.", "The cat slept all day.", "Nobody saw the cat there."]
    assert cut("Der Rat wählte Plan B. Der Arzt kam später. Niemand sah, wo der Arzt war.")[0] == "Der Rat wählte Plan B."
    assert cut("These songs have no. The answer surprised everybody. The band likes the songs.")[0] == "These songs have no."
    for one in ("We met J. Smith there. The Smith family left.", "He read p. Smith there; and then Smith left the house.", "Ask Mr. The there. The house is the best."):
        assert len(cut(one)) == (1 if ";" in one else 2)


def test_collection_decides_where_the_document_is_silent(spark):
    texts = ["The train left early.", "They saw the river.", "The bus took the road.", "We like the sea.", "Take vitamin C. The rest comes later."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    evidence = sentences.gather_evidence(docs, "content")
    assert evidence.small == {"the"}
    assert len(sentences.Splitter(evidence).split(texts[-1])) == 2 and len(sentences.Splitter().split(texts[-1])) == 1


def test_collection_shows_abbreviations_that_no_list_has(spark):
    rng = random.Random(7)
    names = ["Smith", "Jones", "Brown", "Miller", "Davis"]
    texts = []
    for i in range(60):
        texts.append(f"We met Brg. {rng.choice(names)} at the gate, see qu. {rng.randint(1, 99)} there. The room was full.\n\nThey left {rng.choice(['early', 'late', 'soon'])}. The night was cold.")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    evidence = sentences.gather_evidence(docs, "content")
    assert evidence.kinds["brg"] == "title" and evidence.kinds["qu"] == "before" and evidence.kinds.get("there") is None
    new = "Brg. Smith came with qu. 7 of them. The day was long."
    assert [new[a:b] for a, b in sentences.Splitter(evidence).split(new)] == ["Brg. Smith came with qu. 7 of them.", "The day was long."]
    assert len(sentences.Splitter().split(new)) == 4, "without the evidence both abbreviations end a sentence"


def test_lists_come_last():
    shown = sentences.Evidence(kinds={"no": "word"}, starts={"we"})
    text = "He said no. We left."
    assert len(sentences.Splitter(shown).split(text)) == 2 and len(sentences.Splitter(sentences.Evidence(starts={"we"})).split(text)) == 1


def test_nothing_is_cut_off():
    far = "Stop." + " " * 500 + "The next one." + "(" * 60 + " a) b. " + ")" * 59 + " Then more."
    assert cut(far)[0] == "Stop." and cut(far)[1].startswith("The next one.")
    mixed = "LOUD WORDS HERE AND THERE. " * 200 + "\n\n" + "The doctor gave me vitamin C. The cat slept all day. Nobody saw the cat there. " * 200
    assert len(cut(mixed)) == 800, "the opening in capitals does not decide for the rest"
    deep = "He said (" + "[" * 100 + "what? No!" + "]" * 100 + ") and left. Good."
    assert len(cut(deep)) == 2


def test_sentence_rows(spark):
    docs = spark.createDataFrame([(1, "Ab cd. Ef gh.", "x"), (2, None, "x"), (3, " ", "x"), (None, "No id.", "x")], "doc_id long, content string, rec_id string")
    runs = spark.createDataFrame([(1, "One. Two."), (1, "One. Two."), (2, None)], "id long, source_text string")
    got = sorted(tuple(r) for r in sentences.sentences(docs, runs).collect())
    assert got == [("documents", 1, 0, 6), ("documents", 1, 7, 13), ("translation_runs", 1, 0, 4), ("translation_runs", 1, 5, 9)]
    assert sentences.sentences(docs.limit(0), runs.limit(0)).count() == 0


# --- languages


def test_names_of_languages():
    assert [languages.named_language(x) for x in ("en-US", "Русский", "ไทย", "PT", "Deutsch", "und", "?", "", None)] == ["en", "ru", "th", "pt", "de", None, None, None, None]


@pytest.fixture(scope="module")
def model():
    return languages.fit([])


def test_seeds_alone_tell_the_scripts(model):
    told = {"en": "We waited for the end of the year.", "ru": "Мы ждали до конца года, но никто не знает.", "zh": "我们必须等到月底。", "ja": "月末まで待たなければならない。", "hi": "हमें महीने के अंत तक इंतज़ार करना होगा।", "th": "เราต้องรอจนถึงสิ้นเดือน"}
    best = model.scores(list(told.values())).argmax(axis=1)
    assert [languages.LANGUAGES[k] for k in best] == list(told)


def test_stretches_and_cases(spark, model):
    english = "The house by the river was sold last year. Nobody knows who lives there now."
    spanish = "La casa junto al río se vendió el año pasado. No está claro por qué lo hicieron."
    rows = [(1, english, "en"), (2, english, "German"), (3, english + " " + spanish, "en"), (4, None, "en"), (5, "12 / 7", None), (6, english, None), (7, "", ""), (None, english, "de")]
    docs = spark.createDataFrame([(*r, "zz") for r in rows], "doc_id long, text_preview string, true_language string, lang string")
    got = languages.languages(docs, model=model).collect()
    cases = {(r.doc_id, r.seg_no, r.lang) for r in got if r.is_case}
    assert cases == {(2, 1, "en"), (3, 1, "en"), (3, 2, "es"), (6, 1, "en")}
    assert all(0 < r.confidence <= 1 for r in got)
    assert languages.languages(docs.limit(0), model=model).count() == 0


def test_cut_previews_and_documents_without_a_language(spark, model):
    english = "The house by the river was sold last year. Nobody knows who lives there now. "
    tail = "Por eso tenemos que esperar hasta el final del"
    rows = [(1, english + tail, "en", 5000), (2, english + tail, "en", len(english + tail)), (3, None, "en", None), (4, "12 / 7", None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text_preview string, true_language string, n_chars long")
    got = {(r.doc_id, r.seg_no): (r.lang, r.confidence > 0, r.is_case) for r in languages.languages(docs, model=model, every=True).collect()}
    assert got == {(1, 1): ("en", True, False), (2, 1): ("en", True, True), (2, 2): ("es", True, True), (3, 1): (None, False, False), (4, 1): (None, False, False)}


FOREIGN = {
    "es": "Por eso tenemos que esperar hasta el final del mes.",
    "ru": "По этой причине нам нужно ждать до конца месяца.",
    "zh": "因此我们必须等到月底。",
    "ja": "そのため月末まで待たなければならない。",
    "th": "ดังนั้นเราต้องรอจนถึงสิ้นเดือน",
    "hi": "इसलिए हमें महीने के अंत तक इंतज़ार करना होगा।",
}


@pytest.mark.parametrize("other", FOREIGN)
def test_one_sentence_in_another_language_is_a_stretch(model, other):
    first, last = "The house by the river was sold last year, and nobody knows who lives there now.", "Most of the people who came were from other towns."
    got = lambda *parts: [languages.LANGUAGES[c] for _, _, c, _ in languages.stretches(model, sentences.Splitter(), ["\n\n".join(parts)])[0]]
    assert got(first, FOREIGN[other], last) == ["en", other, "en"]
    assert got(FOREIGN[other], first, last) == [other, "en"]
    assert got(first, last, FOREIGN[other]) == ["en", other]


@pytest.mark.parametrize("other,short", [("zh", "我们必须等到月底。"), ("ja", "月末まで待つ。")])
def test_short_sentences_without_spaces_at_the_ends(model, other, short):
    main = "The house by the river was sold last year, and nobody knows who lives there now."
    got = lambda text: [languages.LANGUAGES[c] for _, _, c, _ in languages.stretches(model, sentences.Splitter(), [text])[0]]
    assert got(short + "\n\n" + main) == [other, "en"] and got(main + "\n\n" + short) == ["en", other]


# --- subjects


def test_subjects(spark):
    rng = random.Random(6)
    own = {"sport": ["goalkeeper saves penalty", "striker scores twice", "runners cross finish"], "law": ["court rejects appeal", "judge hears witness", "tenant breaks contract"]}
    plain = ["report covers points", "page follows order"]
    rows, labels = [], []
    for i in range(120):
        subject = "sport" if i % 2 else "law"
        body = [rng.choice(own[subject]) for _ in range(6)] + [rng.choice(plain) for _ in range(3)]
        rows.append((i, "Heading\n\n" + " ".join(f"The {s}." for s in body), "Legal" if subject == "law" else "sports" if i % 7 else "law"))
        if i % 5 == 0:
            labels.append((i, subject))
    rows += [(900, "The report covers points. The page follows order.", None), (901, None, "law"), (902, "  ", "law"), (903, "Only heading", None), (904, "The court rejects appeal. " + "The page follows order. " * 3, None), (905, "The court rejects appeal. " + "The page follows order. " * 4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, content string, domain string").withColumn("subject", F.lit("clash"))
    table = spark.createDataFrame([("sport", "Sport", "Спорт"), ("law", "Law", "Право")], "subject string, title string, title_ru string")
    rules = subjects.train(docs, spark.createDataFrame(labels, "doc_id long, subject string"), table)
    got = {(r.doc_id, r.subject) for r in subjects.document_subjects(docs, rules).collect()}
    assert got == {(i, "sport" if i % 2 else "law") for i in range(120)} | {(904, "law")}
    none = subjects.train(docs.limit(0), spark.createDataFrame([], "doc_id long, subject string"), table)
    assert subjects.document_subjects(docs, none).count() == 0


def test_rules_of_several_items_add_what_their_parts_do_not(spark):
    base = {0: 1 / 3, 1: 1 / 3, 2: 1 / 3}
    mined = [(["amber"], 0, 50, 100), (["amber"], 1, 50, 100), (["basil"], 0, 50, 100), (["basil"], 2, 50, 100), (["amber", "basil"], 0, 50, 50), (["elm"], 1, 90, 100), (["elm", "fir"], 1, 45, 50)]
    weights = subjects._pruned(mined, base)
    assert frozenset(["amber", "basil"]) in weights and frozenset(["elm", "fir"]) not in weights, "as sure as its parts: pruned"
    rules = subjects.Rules(["a", "b", "c"], weights, [1e-9], [0.0, 1.0])
    alone = subjects.Rules(["a", "b", "c"], {k: v for k, v in weights.items() if len(k) == 1}, [1e-9], [0.0, 1.0])
    assert rules.evidence({"amber", "basil", "x"})[0] == 0 and rules.evidence({"amber", "basil"})[1] > 3 > 1 > alone.evidence({"amber", "basil"})[1]
    assert rules.evidence({"amber", "elm"})[0] == 1 and rules.evidence({"x"}) == (0, 0.0)


def test_rules_of_several_items_are_mined_and_decide(spark):
    rng = random.Random(4)
    own = {"sport": ["amber basil {}"], "law": ["amber cedar {}", "statute {}"], "art": ["basil delta {}", "fresco {}"]}
    rows = []
    for i in range(360):
        subject = ["sport", "law", "art"][i % 3]
        rows.append((i, " ".join(f"The {rng.choice(own[subject]).format('w' + str(rng.randint(0, 50)))} here." for _ in range(6)), subject))
    docs = spark.createDataFrame(rows, "doc_id long, content string, domain string")
    table = spark.createDataFrame([(s, s, s) for s in own], "subject string, title string, title_ru string")
    rules = subjects.train(docs, spark.createDataFrame([], "doc_id long, subject string"), table)
    joint = {s for s, _ in rules.rules.items() if s == {"amber", "basil"}}
    assert joint and rules.subjects[rules.evidence({"amber", "basil"})[0]] == "sport"


def test_calibration_is_monotone_and_relative():
    rng = np.random.default_rng(1)
    amounts = rng.random(4000) * 10
    hits = rng.random(4000) < 0.1 + 0.08 * amounts
    edges, chance = subjects._calibrated(amounts, hits)
    assert chance[0] == 0 and chance[-1] == 1 and all(a <= b for a, b in zip(chance, chance[1:]))
    rules = subjects.Rules(["a"], {}, edges, chance)
    assert rules.probability(0.0) == 0 and rules.probability(1.0) < 0.4 < 0.6 < rules.probability(9.0)


def test_annotators_come_before_domains(spark):
    docs = spark.createDataFrame([(i, "Text.", "law" if i < 50 else "sport") for i in range(100)], "doc_id long, content string, domain string")
    said = spark.createDataFrame([(i, "none" if i == 3 else "sport") for i in range(20)], "doc_id long, subject string")
    table = spark.createDataFrame([("law", "Law", "Право"), ("sport", "Sport", "Спорт")], "subject string, title string, title_ru string")
    drawn, names = subjects.labelled(docs, said, table, 20)
    got = {r.doc_id: r.classes for r in drawn.collect()}
    assert set(got) == set(range(20)) and got[3] == [] and got[5] == [names.index("sport")]
    everything = {r.doc_id for r in subjects.labelled(docs, said, table, 1000)[0].collect()}
    assert everything == set(range(100))


def test_registered_queries(spark):
    from textloom.llm import queries

    made = queries.queries()
    for n, wanted in ((1, "found"), (2, "found"), (3, "found"), (4, "found"), (5, "found"), (6, "ids"), (8, "found")):
        assert f"p{n}_{wanted}" in made
    assert set(queries.oracle_sql()) <= set(made)


def test_sql_twins(spark):
    import glob
    from collections import Counter

    import duckdb

    from textloom.llm import queries

    folder = os.environ.get("TEXTLOOM_TEST_DATA", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    for name, sql in queries.oracle_sql().items():
        frame = queries.queries()[name](spark, folder)
        theirs = con.execute(sql)
        names = [c[0] for c in theirs.description]
        assert sorted(names) == sorted(frame.columns)
        assert Counter(map(tuple, frame.select(*names).collect())) == Counter(theirs.fetchall()), name


# --- very long texts


def test_very_long_texts(spark):
    rng = random.Random(9)
    long = prose(rng, 120_000)
    rows = [(1, long), (2, long[:400_000] + " cut here " + long[400_000:]), (3, "z" * 700_000), (4, "z" * 600_500), (5, "( “ " * 50_000)]
    docs = spark.createDataFrame(rows, DOC)
    got = {tuple(r) for r in spans.shared_spans(docs).collect()}
    assert (1, 0, len(long)) in got and (3, 0, 700_000) in got and (4, 0, 600_500) in got and {g[0] for g in got} == {1, 2, 3, 4}
    assert [tuple(r) for r in neardup.pairs(docs).collect()] == [(1, 2)]
    assert "".join(cut("Ab cd. " * 50_000)).replace(" ", "") == "Abcd." * 50_000
    assert {r.doc_id: len(r.ids) > 0 for r in encode.encode(docs).collect()} == {i: True for i, _ in rows}
