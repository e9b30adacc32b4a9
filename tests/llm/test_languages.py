"""Languages of texts: held-out accuracy, shape of stretches, odd inputs."""

import itertools
import random
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex.llm import languages as L
from loomdex.llm.languages import codebook, fit, identify_languages, label_code, language_model, mislabelled, stretches_of, whole_sentence
from tests.conftest import SF_DIR, rows


@pytest.fixture(scope="module")
def samples(spark):
    return [(r["text"], r["lang"]) for r in spark.read.parquet(f"{SF_DIR}/language_samples.parquet").orderBy("sample_no").collect()]


@pytest.fixture(scope="module")
def model(spark):
    larger = SF_DIR.replace("sf0.001", "sf0.01")
    return language_model(spark.read.parquet(f"{larger}/language_samples.parquet"), spark.read.parquet(f"{larger}/documents.parquet"))


def damaged(text, rnd):
    kind = rnd.randrange(4)
    if kind == 0:
        return text.upper()
    if kind == 1:
        return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    if kind == 2:
        return "".join(c if c.isalnum() else " " for c in text)
    return text


def test_held_out_sentences(samples):
    rnd = random.Random(11)
    mixed = samples[:]
    rnd.shuffle(mixed)
    seen, held = mixed[:480], mixed[480:]
    model = fit([t for t, _ in seen] + ["0"], [l for _, l in seen] + [L.NONE])
    found = stretches_of([damaged(t, rnd) for t, _ in held], model)
    right = sum({s[2] for s in some if s[4]} <= {lang} for some, (_, lang) in zip(found, held, strict=True))
    assert right / len(held) > 0.93


def test_codebook():
    book = codebook(13)
    apart = [(book[i] != book[j]).sum() for i in range(13) for j in range(i)]
    assert min(apart) >= 11
    assert (codebook(13) == book).all()
    assert abs(book.sum(axis=0)).max() <= 1


def test_documents_of_their_label(spark, model):
    """Labels are wrong for few documents, so agreement must be high."""
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = identify_languages(df, model).where(F.col("label").isin(model.names) & (F.size("languages") > 0))
    agree = found.where((F.size("languages") == 1) & (F.col("languages")[0]["lang"] == F.col("label"))).count()
    assert agree / found.count() > 0.75


def test_stretches_of_a_mixed_text(model, samples):
    german, french = (next(t for t, l in samples if l == k and len(t) > 60) for k in ("de", "fr"))
    text = f"{german}.\n[04:52:14] open_ms=159.306\nsegment 5, document 4: frequency 5\n{french}!"
    found = stretches_of([text], model)[0]
    assert [text[a:b].strip() for a, b, lang, _, whole in found if whole] == [german + ".", french + "!"]
    assert [s[2] for s in found if s[4]] == ["de", "fr"]
    assert all(0 <= s[3] <= 1 for s in found)
    # Without marks between them the languages are told apart by their words.
    run = " ".join("".join(c if c.isalnum() else " " for c in t) for t in (german, french))
    assert {s[2] for s in stretches_of([run], model)[0] if s[4]} == {"de", "fr"}


@pytest.mark.parametrize(
    "text",
    ["", " \n\t", "> lookup segment-0001.idx rexu", '{"segment_id": 2, "df": 1, "term": "tusu"}', "9C 98 AC 0A 20 FD", "| 3885 | 1.951 |", "fn a(x: u32) -> u64 { x as u64 + 3 }",
     "segment 57, document 37577: frequency 5", "あ" * 500, "z" * 5000, "kodatu", "12345", "👩‍💻 ✅", "\x00", "tuyu=1 yuxi=2"],
)
def test_no_language(model, text):
    assert not any(s[4] for s in stretches_of([text], model)[0])


def test_very_long_text(model, samples):
    text = " ".join(t for t, l in samples if l == "en") * 40
    assert {s[2] for s in stretches_of([text], model)[0] if s[4]} == {"en"}


def test_best_paths_are_the_best():
    """Runs of several lengths, worked on side by side, against all paths."""
    rnd = np.random.default_rng(5)
    for _ in range(60):
        lengths, k, cost = rnd.integers(1, 6, size=4), 3, rnd.random() * 3
        first = np.cumsum(lengths) - lengths
        scores = rnd.normal(size=(lengths.sum(), k))
        found = L.best_paths(scores, first, lengths, cost)
        for at, n in zip(first, lengths, strict=True):
            value = lambda p: scores[at + np.arange(n), p].sum() - cost * (np.diff(p) != 0).sum()  # noqa: B023, E731
            best = max(value(np.array(p)) for p in itertools.product(range(k), repeat=int(n)))
            assert value(found[at : at + n]) == pytest.approx(best)


def test_sentence_words_against_a_plain_loop():
    rnd = np.random.default_rng(6)
    for _ in range(100):
        lengths = rnd.integers(1, 12, size=5)
        first, part = np.cumsum(lengths) - lengths, np.repeat(np.arange(5), lengths)
        kind, letters = rnd.choice([L.WORD, L.WORD, L.OTHER, L.SIGN], lengths.sum()), rnd.integers(1, 7, lengths.sum())
        wanted = []
        for at, n in zip(first, lengths, strict=True):
            most = words = size = 0
            balance = 0.0
            for j in range(at, at + n):
                balance += {L.WORD: 1, L.OTHER: -L.OTHER_COST, L.SIGN: 0}[kind[j]]
                if kind[j] == L.WORD:
                    words, size = words + 1, size + letters[j]
                    most = max(most, words) if size > 2.5 * words else most
                if balance < 0:
                    words = size = 0
                    balance = 0.0
            wanted.append(most)
        assert L.sentence_words(kind, letters, first, part).tolist() == wanted


def test_whole_sentence():
    assert whole_sentence("Busqué siwe y solo encontré fubiba57.")
    assert not whole_sentence("Der alte Schnappschuss!") and not whole_sentence("one two three four five six seven", linked=True)
    assert whole_sentence("Nobody closed the ordinal of dodazi since run 344 3 6 377 10 093 0E 30 70 C0 52 DC A7 23 42 11")
    assert not whole_sentence("don't DON'T we'LL I'd'VE")
    assert whole_sentence("Procurei ramuyi10 e só encontrei bagu76;")
    assert whole_sentence("这条查询命令会跳过没有匹配的数据块") and not whole_sentence("这个倒排列表")


def test_labels(spark):
    wanted = {"en": "en", "EN": "en", "en-US": "en", "en_GB": "en", "eng": "en", "fre": "fr", "FRA-CA": "fr", "xx": "xx", "und": None, "n/a": None, "": None, " ": None, None: None, "unknown": None}
    df = spark.createDataFrame([(k,) for k in wanted], "lang string")
    assert {r[0]: r[1] for r in df.select("lang", label_code(F.col("lang"))).collect()} == wanted


def test_cases(spark, samples):
    by = {k: [t for t, l in samples if l == k and len(t) > 50] for k in ("de", "en", "ja")}
    data = [
        (1, by["de"][0] + ".", "de", 1), (2, by["de"][1] + ".", "en-US", 1), (3, by["en"][0] + ".", None, 1), (4, f"{by['de'][2]}.\n{by['ja'][0]}。", "DE", 1),
        (5, None, "de", 1), (6, "", None, 1), (7, "12 34 56", "xx", 1), (8, by["en"][1] + ".", "ENG", 1), (None, by["en"][2] + ".", "fr", 1),
    ]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, label int")
    known = spark.createDataFrame(samples, "text string, lang string")
    assert rows(mislabelled(df, known)) == sorted([(2, "de"), (3, "en"), (4, "de"), (4, "ja"), (None, "en")], key=repr)
    assert mislabelled(df.limit(0), known).count() == 0
    assert mislabelled(df, known.limit(0)).count() == 0


def test_scores_do_not_depend_on_the_batch(model, samples):
    texts = [t for t, _ in samples[:60]]
    whole = stretches_of(texts, model)
    assert [stretches_of([t], model)[0] for t in texts] == [[(a, b, l, pytest.approx(c, abs=1e-4), w) for a, b, l, c, w in some] for some in whole]
    assert np.isfinite(model.weights).all()


def found_in(text, model):
    return {s[2] for s in stretches_of([text], model)[0] if s[4]}


def bare(text):
    return " ".join("".join(c if c.isalnum() else " " for c in text).split())


def test_short_sentences_beside_another_language(model, samples):
    """A sentence of 4 to 7 words needs no mark between it and another language."""
    english = "The nightly benchmark has been rebuilt although nothing else had changed"
    assert found_in(f"{english} Trzeba jeszcze raz sprawdzić kolejność", model) == {"en", "pl"}
    assert found_in("Procurei cubora e so encontrei pipo Trzeba jeszcze raz sprawdzić kolejność", model) == {"pl", "pt"}
    assert found_in("Wir suchen heute den Fehler we found the broken index today", model) == {"de", "en"}
    assert found_in("Der Index wurde gestern neu gebaut Nobody loaded the range of mafegici48 since run 387", model) == {"de", "en"}
    clean = [(bare(t), l) for t, l in samples if l not in ("ja", "zh")]
    short = [(t, l) for t, l in clean if not whole_sentence(t, linked=True)]
    assert len(short) == 14
    right = 0
    for i, (text, lang) in enumerate(short):
        other, name = next((t, l) for t, l in clean[i:] + clean if l != lang and whole_sentence(t, linked=True))
        right += (found_in(f"{other} {text}", model) == {lang, name}) + (found_in(f"{text} {other}", model) == {lang, name})
    assert right >= 25, right


def composed(samples, rnd, n):
    """(text, languages): documents of one or two languages, damaged, some without any mark, with log lines between."""
    by = {}
    for text, lang in samples:
        by.setdefault(lang, []).append(text)
    out = []
    for _ in range(n):
        langs = rnd.sample(sorted(by), rnd.choice([1, 1, 2]))
        parts = [damaged(rnd.choice(by[lang]), rnd) + "." for lang in langs for _ in range(rnd.randint(1, 3))]
        parts.insert(rnd.randrange(len(parts) + 1), "segment 57, document 37577: frequency 5")
        unmarked = rnd.random() < 0.3 and not {"ja", "zh"} & set(langs)
        out.append((bare(" ".join(parts)) if unmarked else "\n".join(parts), set(langs)))
    return out


def precision_recall(cases, model):
    both = found = true = 0
    for (_, langs), some in zip(cases, stretches_of([t for t, _ in cases], model), strict=True):
        got = {s[2] for s in some if s[4]}
        both, found, true = both + len(got & langs), found + len(got), true + len(langs)
    return both / found, both / true


def test_precision_and_recall_of_composed_documents(model, samples):
    precision, recall = precision_recall(composed(samples, random.Random(3), 600), model)
    assert precision > 0.98 and recall > 0.98, (precision, recall)


def test_precision_and_recall_with_held_out_frames(samples):
    """No sentence that begins like one of the test was fitted on."""
    frame = lambda t: " ".join(t.lower().split()[:2]) if " " in t else t[:4]
    held = [(t, l) for t, l in samples if zlib.crc32(frame(t).encode()) % 3 == 0]
    seen = [(t, l) for t, l in samples if zlib.crc32(frame(t).encode()) % 3 != 0]
    assert len(held) > 100
    model = fit([t for t, _ in seen] + ["0"], [l for _, l in seen] + [L.NONE])
    precision, recall = precision_recall([(damaged(t, random.Random(i)), {l}) for i, (t, l) in enumerate(held)], model)
    assert precision > 0.98 and recall > 0.95, (precision, recall)


def test_confidence_and_accuracy_agree(samples):
    """On held-out windows of a few words the mean confidence is close to the share that is right."""
    rnd = random.Random(8)
    mixed = [(t, l) for t, l in samples if l not in ("ja", "zh")]
    rnd.shuffle(mixed)
    seen, held = mixed[:400], mixed[400:]
    model = fit([t for t, _ in seen] + ["0"], [l for _, l in seen] + [L.NONE])
    sure, right = [], []
    for text, lang in held:
        words = L.words_of(text)
        for at in range(0, len(words), 3):
            odds = sum(model.weights[L.columns_of(w)].sum(axis=0) for w in words[at : at + 3])
            losses = model.losses(odds[None])
            sure.append(L.confidences(losses).max())
            right.append(model.names[losses.argmin()] == lang)
    assert abs(np.mean(sure) - np.mean(right)) < 0.08
    high = np.array(sure) > 0.9
    assert np.mean(np.array(right)[high]) > 0.9


def test_labels_of_documents_do_not_matter(spark):
    """The fit takes the languages of documents from their content; missing or shuffled labels change nothing."""
    known = spark.read.parquet(f"{SF_DIR}/language_samples.parquet")
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("lang", "text")
    none = df.withColumn("lang", F.lit(None).cast("string"))
    assert np.array_equal(language_model(known, df).weights, language_model(known, none).weights)


@pytest.mark.parametrize(
    ("text", "lang"),
    [
        ("Der veraltete Schnappschuss zählt die Wiederholungen eines Wortes, zusammen mit mana und Ten wykaz wystąpień.", "de"),
        ("Den nattliga mätningen hoppar över block utan träff tillsammans med O nosso separador de palavras och niji24!", "sv"),
        ("the checksum test stores each term only once with dekate and nuestro separador de palabras.", "en"),
        ("Trzeba jeszcze raz sprawdzić kolejność O nosso separador de palavras i rado.", "pl"),
        ("Один из прежних сегментов требует меньше памяти, чем мы думали, вместе с Il programma di scrittura и fawu.", "ru"),
    ],
)
def test_phrases_of_another_language_are_no_sentences(model, text, lang):
    assert found_in(text, model) == {lang}


def test_phrases_between_two_parts_of_a_sentence():
    parts = ["one two three four five six ", "uno dos tres cuatro cinco ", "seven eight nine ten"]
    text = "".join(parts)
    cuts = list(itertools.accumulate(map(len, parts), initial=0))
    model = L.Model([], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
    linked = lambda text, cuts, names: L.phrases_of(text, cuts, names, model)[0]
    assert linked(text, cuts, ["en", "es", "en"]) == [False, False, False]
    assert linked(text.replace("eight nine ten", ""), [*cuts[:3], cuts[2] + 6], ["en", "es", "en"])[1]
    model.inner_last = {"en": frozenset(["six"])}
    assert L.phrases_of(text, cuts, ["en", "es", "en"], model) == ([False, True, False], [(0, 2)])
    model.inner_last, model.inner_first = {}, {"en": frozenset(["seven"])}
    assert linked(text, cuts, ["en", "es", "en"])[1]
    model.inner_first = {}
    assert linked(text.replace("uno", '"un'), cuts, ["en", "es", "en"])[1]


def test_copies_of_a_text_count_once(spark, samples):
    """The texts that the classifiers are fitted on are distinct, however many copies come first."""
    df = spark.createDataFrame([(t,) for t, _ in samples[:200]], "text string")
    first = df.orderBy(F.xxhash64("text")).first()
    copies = spark.createDataFrame([tuple(first)] * 5_000, df.schema)
    distinct = df.distinct().orderBy(F.xxhash64("text"), "text").limit(50).collect()
    assert rows(L.first_documents(df.union(copies), 50)) == sorted(map(tuple, distinct), key=repr)
    assert L.first_documents(df.limit(0)).count() == 0


def test_copies_do_not_change_the_model(spark):
    known = spark.read.parquet(f"{SF_DIR}/language_samples.parquet")
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("lang", "text")
    kept = df.where(F.col("text").isNotNull() & (F.length("text") <= L.DOCUMENT_LENGTH) & label_code(F.col("lang")).isNotNull())
    first = kept.orderBy(F.xxhash64("text")).limit(1).crossJoin(spark.range(L.DOCUMENTS_MOST)).drop("id")
    assert np.array_equal(language_model(known, df.union(first)).weights, language_model(known, df).weights)


def test_every_sample_counts(spark, samples):
    """More samples of a language than were once fitted on: all of them are, as by one process."""
    many = [(f"{t} {'x' * i}", l) for t, l in samples for i in range(4)]
    known = spark.createDataFrame(many, "text string, lang string").repartition(3)
    wanted = fit([t for t, _ in many] + ["0"], [l for _, l in many] + [L.NONE])
    found = language_model(known, known.limit(0))
    assert np.array_equal(found.weights, wanted.weights) and np.array_equal(found.reliable, wanted.reliable)
    assert (found.scale, found.inner_last, found.inner_first, found.often) == (wanted.scale, wanted.inner_last, wanted.inner_first, wanted.often)


def test_every_document_counts(spark, samples):
    """Long texts, and those beyond the first few thousand, are fitted on too."""
    known = spark.createDataFrame(samples, "text string, lang string")
    english = [t for t, l in samples if l == "en"]
    data = [(f"{english[i % 60]}.\n{english[(i + 7) % 60]}.\n{i}",) for i in range(3_200)] + [(".\n".join([*english, *english, "The quaxolot has been rebuilt from the quaxolot although nothing else had changed."]),)]
    df = spark.createDataFrame(data, "text string")
    model = language_model(known, df)
    chosen = {tuple(r) for r in L.context_sentences(df, model).select("text", "lang").collect()}
    assert (data[-1][0].rpartition("\n")[2], "en") in chosen
    assert len(data[-1][0]) > L.DOCUMENT_LENGTH and len(data) > L.DOCUMENTS_MOST
    short = language_model(known, df.where(F.length("text") <= L.DOCUMENT_LENGTH))
    assert not np.array_equal(model.weights, short.weights)
