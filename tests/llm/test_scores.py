import math
import random
import zlib

import numpy as np
import pytest

from quern.llm import langid, toxicity
from quern.llm.tokens import vocabulary

from .conftest import ODD

STEMS = {"en": ["the", "ing", "ther", "ation", "er", "hand"], "de": ["sch", "ung", "keit", "ver", "lich", "ge"]}


def word(rng, lang):
    return "".join(rng.choice(STEMS[lang]) for _ in range(rng.randrange(1, 4)))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return [(k, " ".join(word(rng, lang) for _ in range(rng.randrange(3, 40))), lang, "s") for k in range(400) for lang in [rng.choice(["en", "de"])]]


def all_segmentations(table, probabilities, text):
    """Brute force: the sum over every way to cut the marked word."""
    known = {p: i for i, p in enumerate(table.texts)}

    def rest(s):
        if not s:
            return 1.0
        total = 0.0
        for k in range(1, len(s) + 1):
            i = known.get(s[:k])
            if i is not None:
                total += probabilities[i] * rest(s[k:])
            elif k == 1:
                total += langid.UNKNOWN * rest(s[1:])
        return total

    return rest("▁" + text)


def test_forward_sums_all_segmentations(make, texts):
    model = langid.fit(make(texts))
    assert model.languages == ["de", "en"]
    table = langid.pieces(vocabulary("piece_bpe_32k.model"))
    some = ["the", "schung", "ß", "x", "xø日", "thering"]
    scores = model.word_scores(some)
    for w, row in zip(some, scores, strict=True):
        for k in range(2):
            assert row[k] == pytest.approx(math.log(all_segmentations(table, model.probabilities[:, k], w)), rel=1e-6)
    assert np.allclose(model.probabilities[: table.n].sum(0), 1)


def test_held_out_accuracy_and_und(make, texts, odd):
    got = langid.identify(make(texts)).collect()
    truth = {i: lang for i, _, lang, _ in texts}
    held = [r for r in got if r.held_out]
    assert len(held) > 50 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    rows = langid.identify(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    found = {r.doc_id: r.lang_pred for r in rows}
    assert [found[k] for k in (1, 2, 3, 11, 12)] == ["und"] * 5 and found[4] == "en"
    assert {r.lang_pred for r in langid.identify(make([(1, "no language"), (2, None)])).collect()} == {"und"}
    assert langid.identify(make([])).count() == 0


def test_held_out_rows_teach_nothing(make, texts):
    wrong = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s) for i, t, lang, s in texts]
    assert langid.fit(make(wrong)).languages == ["de", "en"]


def test_recognised_keeps_rows_and_columns(make, odd):
    model = langid.fit(make([(k, "the ing ther ation hand", "en") for k in range(30)]))
    kept = langid.recognised(odd, model, 0.5)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in ODD if t and any(map(str.isalpha, t)))


# ---------------------------------------------------------------- toxicity


@pytest.fixture(scope="module")
def labelled(spark, make):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(900):
        words, toxic = [word(rng, "en") for _ in range(40)], k % 6 == 0
        for _ in range(4 * toxic):
            words[rng.randrange(40)] = rng.choice(["scumbag", "moron", "idiot", "worthless"])
        rows.append((k, " ".join(words), "en", "s"))
        labels.append((k, 1, int(toxic)))
    return make(rows), spark.createDataFrame(labels + [(5000, 1, 1), (3, 1, None), (None, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def lexicon(labelled):
    return toxicity.fit(*labelled)


def test_viterbi_is_the_best_path(lexicon):
    def every(piece):
        best = {("", "", 0.0, "")}
        previous = ""
        for c in piece:
            best = {(b if x else a, x or b, cost + charge + (lexicon.chars.cost(*map(toxicity.symbol, (a, b, x))) if x else 0), text + x) for a, b, cost, text in best for x, charge in toxicity.options(c, previous)}
            previous = c
        return min((cost + lexicon.chars.cost(toxicity.symbol(a), toxicity.symbol(b), 0), text) for a, b, cost, text in best)[1]

    for piece in ("1d10t", "m.0.r0n", "w0rthl3ss", "iidi0t", "a1|e"):
        assert toxicity.restore(piece, lexicon.chars) == every(piece)


@pytest.mark.parametrize("text", ["you 1d10t", "i d i o t", "m.o.r.o.n", "mooooron!", "w0rthl3ss,", "SCUMB4G", "an m 0 r 0 n"])
def test_disguises_count(lexicon, text):
    assert toxicity._Scorer(lexicon).hits(text)[0] == 1


@pytest.mark.parametrize("at", [33, 36, 38, 40, 76, 79, 500])
def test_spaced_words_across_blocks(lexicon, at):
    filler = "ther" * 300
    letters = filler[:at] + "idiot" + filler[:90] + "moron" + filler[:60]
    assert toxicity._Scorer(lexicon).hits(" ".join(letters))[0] == 2


def test_short_and_long_units_in_a_row():
    units = {"ass": 3.0, "contemptiblenesses": 4.0, "idiot-": 5.0}
    logs = np.full((28, 28, 28), -0.1)
    lexicon = toxicity.Lexicon(units, toxicity.CharModel(logs))
    for word, weight in (("ass", 3.0), ("contemptiblenesses", 4.0), ("idiotic", 5.0)):
        assert lexicon.row("zz" + word + "zz") == (1, weight)
    assert lexicon.row("zzasszzidioticzz") == (2, 8.0)


@pytest.mark.parametrize("text,hits", [("idi" + "o" * 60 + "t", 1), ("_".join(["1d10t", "m0r0n"] * 6), 12), (".".join(["the", "hand"] * 8 + ["w0rthl3ss"]), 1), (".".join("the" * 20 + "moron" + "the" * 5), 1), ("idiot_moron_and_" + "_".join("scumbag"), 3), ("x" * 200_000, 0)])
def test_long_pieces_are_decoded(lexicon, text, hits):
    assert toxicity._Scorer(lexicon).hits(text)[0] == hits


# signs at the edge that stand for letters, and words with hardly a letter left
@pytest.mark.parametrize("text", ["1d10+", "idio+", "!diot", "(idio+!", "m0r0n!", "$cumbag", "5cumb49", "|d|0t", "\"1d10+\",", "wor+hle$$", "worthle$$!!"])
def test_signs_at_the_edge_and_few_letters(lexicon, text):
    assert toxicity._Scorer(lexicon).hits("the " + text + " hand")[0] == 1


@pytest.mark.parametrize("text", ["call 555-6835", "a b c d", "version 4.0.1", "the hand-ing", "0x1f3a", "", None])
def test_plain_text_does_not(lexicon, text):
    assert toxicity._Scorer(lexicon).hits(text)[0] == 0


def test_held_out_scores(labelled, lexicon, make, odd, spark):
    docs, labels = labelled
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.score(docs, lexicon).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in rows)
    assert sum(r.predicted == (truth[r.doc_id] or 0) for r in held) / len(held) > 0.97
    got = toxicity.score(odd, lexicon).collect()
    assert len(got) == len(ODD) and not any(r.predicted for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.toxicity(odd, none).collect()} == {0}
    assert toxicity.toxicity(make([]), none).count() == 0


def test_copies_of_one_text_make_no_lexicon(make, spark):
    docs = make([(k, "quite harmless words in one copied text " * 3 if k % 5 == 0 else f"other text number {k % 50} here") for k in range(300)])
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(300)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, labels).weights == {}


# ways to disguise a word, each of which must be seen through
DISGUISES = {
    "looks": lambda w: "".join({"i": "1", "o": "0", "s": "5", "e": "3", "a": "4", "t": "7"}.get(c, c) for c in w),
    "signs": lambda w: "".join({"i": "!", "s": "$", "a": "@", "t": "+", "c": "("}.get(c, c) for c in w),
    "repeats": lambda w: "".join(c * (3 if k % 3 == 1 else 1) for k, c in enumerate(w)),
    "doubled": lambda w: "".join(c * 2 for c in w),
    "spaced": " ".join,
    "dotted": ".".join,
    "dashed": "-".join,
    "cut in two": lambda w: w[: len(w) // 2] + " " + w[len(w) // 2 :],
    "cut after two letters": lambda w: w[:2] + " " + w[2:],
    "accents": lambda w: "".join({"i": "ï", "o": "ö", "e": "é", "a": "á", "u": "ü"}.get(c, c) for c in w),
    "Cyrillic": lambda w: "".join({"i": "і", "o": "о", "s": "ѕ", "e": "е", "a": "а", "c": "с"}.get(c, c) for c in w),
    "zero width": lambda w: "​".join(w),
    "two letters for one": lambda w: w.replace("w", "vv").replace("m", "rn"),
    "star for a vowel": lambda w: w[0] + "".join("*" if c in "aeiou" and "aeiou".find(c) >= 0 and k == min(j for j, x in enumerate(w[1:]) if x in "aeiou") else c for k, c in enumerate(w[1:])),
    "capitals": str.upper,
    "glued": lambda w: f"the_{w}_hand",
    "inflected": lambda w: w + "ly",
}


@pytest.mark.parametrize("kind", DISGUISES)
def test_each_kind_of_disguise(lexicon, kind):
    rng = random.Random(7)
    scorer, found, tried = toxicity._Scorer(lexicon), 0, 0
    for w in ("scumbag", "moron", "idiot", "worthless"):
        for _ in range(25):
            around = [word(rng, "en") for _ in range(12)]
            assert scorer.hits(" ".join(around))[0] == 0
            around.insert(rng.randrange(13), DISGUISES[kind](w))
            found, tried = found + (scorer.hits(" ".join(around))[0] > 0), tried + 1
    assert found / tried >= 0.9, found / tried


def test_clean_texts_have_no_hits(lexicon, make):
    rng = random.Random(8)
    rows = make([(k, " ".join(word(rng, "en") for _ in range(60)) + rng.choice(["", " 4.5%", " a@b.org", " no-one", " é", " sh and er mo"])) for k in range(2000)])
    hits = [r.hits for r in toxicity.score(rows, lexicon).collect()]
    assert sum(h > 0 for h in hits) / len(hits) <= 0.01


def test_units_count_texts_on_both_sides(make, spark):
    """A word that one clean text repeats isn't clean as often, and one that a toxic text repeats isn't toxic as often."""
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(600):
        words, toxic = [word(rng, "en") for _ in range(30)], int(k % 6 == 0)
        words += ["scumbag"] * toxic + ["frenzy"] * (40 if k == 6 else 0)
        rows.append((k, " ".join(words), "en", "s"))
        labels.append((k, 1, toxic))
    found = toxicity.fit(make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert set(found.weights) == {"scumbag-"}


def test_false_discoveries_are_bounded():
    assert not toxicity.significant(np.array([3, 9]), np.array([30, 90]), 100, 1000).any()
    assert toxicity.significant(np.array([30, 9]), np.array([0, 90]), 100, 1000).tolist() == [True, False]
    assert toxicity.concise({"vequ-": 1.0, "veque-": 1.0, "vequest": 1.0, "vequi-": 1.0, "moro-": 1.0, "moron-": 1.0, "moron": 1.0, "ass": 1.0}, {"vequ-": 90, "veque-": 40, "vequest": 40, "vequi-": 50, "moro-": 30, "moron-": 30, "moron": 30, "ass": 9}) == {"vequ-": 1.0, "moron-": 1.0, "ass": 1.0}


def test_skeletons_hold_every_reading(lexicon):
    """The quick look that decides what is decoded never drops a reading that decoding would find."""
    rng = random.Random(10)
    signs = {c: [x for x in toxicity.LOOKS if c in toxicity.LOOKS[x] and x != "*"] + [x for x in toxicity.LETTERS if toxicity.LETTERS[x] == c] for c in "abcdefghijklmnopqrstuvwxyz"}
    for _ in range(500):
        w = rng.choice(["scumbag", "moron", "idiot", "worthless"])
        piece = "".join(rng.choice([c, *signs[c]]) * rng.choice([1, 1, 2]) + rng.choice(["", "", "."]) for c in w)
        assert toxicity.skeleton(piece) == toxicity.skeleton(w) and lexicon.possible(piece)


def log_forward(table, probabilities, text):
    """Brute force over places, in logarithms."""
    known, marked = {p: i for i, p in enumerate(table.texts)}, "▁" + text
    logs = [0.0]
    for j in range(1, len(marked) + 1):
        ways = []
        for i in range(max(0, j - table.longest), j):
            k = known.get(marked[i:j], table.n + 1 if j - i == 1 else None)
            if k is not None and probabilities[k] > 0:
                ways.append(logs[i] + math.log(probabilities[k]))
        top = max(ways)
        logs.append(top + math.log(sum(math.exp(x - top) for x in ways)))
    return logs[-1]


def test_long_words_are_summed_whole(make, texts, monkeypatch):
    model = langid.fit(make(texts))
    table = langid.pieces(vocabulary("piece_bpe_32k.model"))
    rng = random.Random(12)
    some = ["thering" * k for k in (4, 5, 9, 40)] + ["".join(rng.choice("abcdeßш日") for _ in range(n)) for n in (31, 32, 33, 34, 200, 40_000)] + ["keit" * 12_000]
    scores = model.word_scores(some)
    for w, row in zip(some, scores, strict=True):
        for k in range(2):
            assert row[k] == pytest.approx(log_forward(table, model.probabilities[:, k], w), rel=1e-9)
    monkeypatch.setattr(langid, "SHORT", 3)
    assert np.allclose(model.word_scores(some[:5]), scores[:5])


def test_expected_counts_are_those_of_all_segmentations(monkeypatch):
    table = langid.pieces(vocabulary("piece_bpe_32k.model"))
    known = {p: i for i, p in enumerate(table.texts)}

    def ways(s):
        if not s:
            yield [], 1.0
        for k in range(1, len(s) + 1):
            i = known.get(s[:k], table.n + 1 if k == 1 else None)
            if i is not None:
                for rest, p in ways(s[k:]):
                    yield [i, *rest], p * (1 / table.n if i < table.n else langid.UNKNOWN)

    words = ["the", "ther", "xø日", "ingation", "a", "schung"]
    weights = np.array([[1.0, 0.0], [2.0, 1.0], [1.0, 3.0], [0.0, 1.0], [5.0, 5.0], [1.0, 1.0]])
    want = np.zeros((table.n + 2, 2))
    for w, own in zip(words, weights, strict=True):
        every = list(ways("▁" + w))
        total = sum(p for _, p in every)
        for ids, p in every:
            for i in ids:
                want[i] += p / total * own
    assert np.allclose(langid.expected_counts(table, words, weights), want)
    monkeypatch.setattr(langid, "SHORT", 0)
    assert np.allclose(langid.expected_counts(table, words, weights), want)
    assert langid.expected_counts(table, ["ab" * 30_000], np.ones((1, 1))).sum() > 10_000
