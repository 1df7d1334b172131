"""Language identification by unigrams summed over all segmentations."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alone, mix, slices, with_id_hash, worker_cache
from .tokens import vocabulary

FOLDS, HELD_OUT, UNDETERMINED = 4, 2, "und"
#: Words of up to so many letters are summed side by side; in longer ones, each on its own, probabilities are scaled as they go.
SHORT = 32
#: Probability of a character that no piece covers, and how much of the pooled counts backs each language's own.
UNKNOWN, BACKING = 1e-7, 0.02
#: A text's log likelihoods count as those of at most so many independent words, so that the score stays a usable probability.
INDEPENDENT = 20.0
_RUN = re.compile(r"[^\W\d_]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def letter_runs(text: str) -> list[str]:
    return _RUN.findall(text.lower())


class Pieces:
    """A fixed public vocabulary: its lower-case pieces and what they begin with, looked up by hash of their characters; a word is read as a mark and its letters."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {library.id_to_piece(i) for i in range(library.get_piece_size()) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))}
        self.texts = sorted(p for p in found if p == p.lower() and all(c.isalpha() for c in p.removeprefix("▁")))
        self.longest = max(map(len, self.texts))
        self.n = len(self.texts)
        # n: the beginning of a piece that is none itself
        known = {p[:k]: self.n for p in self.texts for k in range(1, len(p) + 1)} | {p: i for i, p in enumerate(self.texts)}
        hashes: dict[str, int] = {"": 0}
        for k in range(1, self.longest + 1):
            own = [p for p in known if len(p) == k]
            h = mix(np.array([hashes[p[:-1]] for p in own], np.uint64) * _STEP + np.array([ord(p[-1]) for p in own], np.uint64))
            hashes.update(zip(own, h.tolist(), strict=True))
        self.hashes = np.array([hashes[p] for p in known] + [0], np.uint64)
        self.ids = np.array([*known.values(), -1])
        # two tables of places in these by bits of the hash: the second has what finds its place in the first taken
        m = len(known)
        self.first, self.second = np.full(1 << 20, m, np.int32), np.full(1 << 20, m, np.int32)
        places = self.hashes[:m] >> np.uint64(44)
        _, owner = np.unique(places, return_index=True)
        self.first[places[owner]] = owner
        rest = np.setdiff1d(np.arange(m), owner)
        for self.shift in map(np.uint64, range(24)):
            places = (self.hashes[rest] >> self.shift) & np.uint64((1 << 20) - 1)
            if len(np.unique(places)) == len(places):
                break
        else:
            raise ValueError("the vocabulary's hashes fit no table")
        self.second[places] = rest

    def find(self, h: np.ndarray) -> np.ndarray:
        """Of each hash the piece's number, n for what only begins one, -1 for anything else."""
        at = self.first[h >> np.uint64(44)]
        miss = np.flatnonzero(self.hashes[at] != h)
        more = self.second[(h[miss] >> self.shift) & np.uint64((1 << 20) - 1)]
        at[miss] = np.where(self.hashes[more] == h[miss], more, len(self.hashes) - 1)
        return self.ids[at]

    def spans(self, points: np.ndarray, step: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """By length from 1, places in `points` (code points `step` apart belong together, 0 ends a word) where a piece of that length begins, and its number; n + 1: a lone unknown character."""
        out = []
        at = np.flatnonzero(points)
        h = np.zeros(len(at), np.uint64)
        for k in range(self.longest):
            h = mix(h * _STEP + points[at + k * step])
            ids = self.find(h)
            whole = (ids >= 0) & (ids < self.n)
            out.append((at, np.where(whole, ids, self.n + 1)) if k == 0 else (at[whole], ids[whole]))
            live = (ids >= 0) & (at + (k + 1) * step < len(points))
            at, h = at[live], h[live]
            live = points[at + (k + 1) * step] != 0
            at, h = at[live], h[live]
        return out

    def lattice(self, words: list[str]) -> tuple[int, list[tuple[int, int, np.ndarray, np.ndarray]]]:
        """Positions, and (start, end, words, pieces) by ascending start, of words side by side."""
        width, n = max(map(len, words)) + 1, len(words)
        points = np.frombuffer("".join(("▁" + w).ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(n, width).T.astype(np.uint64).ravel()
        spans = [(at, ids, np.searchsorted(at, np.arange(width + 1) * n).tolist()) for at, ids in self.spans(points, n)]
        return width, [(i, i + k, at[ends[i] : ends[i + 1]] - i * n, ids[ends[i] : ends[i + 1]]) for i in range(width) for k, (at, ids, ends) in enumerate(spans, 1) if ends[i] < ends[i + 1]]

    def windows(self, word: str, most: int = 1 << 14) -> Iterator[np.ndarray]:
        """Of one word, part by part, for each place the number of the piece of each length that ends there (places x lengths); n: none."""
        points = np.frombuffer(("▁" + word).encode("utf-32-le"), np.uint32).astype(np.uint64)
        for a in range(0, len(points), most):
            begin, end = max(0, a - self.longest + 1), min(len(points), a + most)
            out = np.full((end - begin, self.longest), self.n)
            for k, (at, ids) in enumerate(self.spans(points[begin:end], 1)):
                out[at + k, k] = ids
            yield out[a - begin :]


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One per Python worker."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def _side_by_side(words: list[str], most: int = 300_000) -> Iterator[list[int]]:
    """Words of SHORT letters at most, in groups of similar length of about `most` letters."""
    order = sorted((i for i, w in enumerate(words) if len(w) <= SHORT), key=lambda i: len(words[i]))
    while order:
        n = 1
        while n < len(order) and (n + 1) * (len(words[order[n]]) + 1) <= most and len(words[order[n]]) <= 2 * len(words[order[0]]) + 4:
            n = min(len(order), 2 * n)
        while n > 1 and n * (len(words[order[n - 1]]) + 1) > 2 * most:
            n //= 2
        yield order[:n]
        order = order[n:]


def _sums(windows: Iterator[np.ndarray], probabilities: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Forward sums of one word, place by place, as (sums, logarithms of what they are to be multiplied with); probabilities: pieces x columns."""
    longest = None
    for ids in windows:
        if longest is None:
            longest = ids.shape[1]
            last, scale = np.zeros((longest, probabilities.shape[1])), np.zeros(probabilities.shape[1])
            last[0] = 1
        for row in probabilities[ids]:
            now = (last * row).sum(0)
            last[1:] = last[:-1]
            last[0] = now
            most = last.max(0)
            if most.min() < 1e-100:
                last /= most
                scale = scale + np.log(most)
            yield last[0].copy(), scale


def expected_counts(table: Pieces, words: list[str], weights: np.ndarray) -> np.ndarray:
    """Forward and backward sums under equal piece probabilities: expected uses of each piece, for each column of weights (words x languages)."""
    flat = np.append(np.full(table.n, 1.0 / table.n), [0.0, UNKNOWN])
    out = np.zeros((table.n + 2, weights.shape[1]))
    for own in _side_by_side(words):
        some = [words[i] for i in own]
        width, lattice = table.lattice(some)
        ends = np.array([len(w) + 1 for w in some])
        forward, backward = np.zeros((width + 1, len(some))), np.zeros((width + 1, len(some)))
        forward[0] = 1
        for i, j, rows, ids in lattice:
            forward[j, rows] += forward[i, rows] * flat[ids]
        backward[ends, np.arange(len(some))] = 1 / forward[ends, np.arange(len(some))]
        for i, j, rows, ids in reversed(lattice):
            backward[i, rows] += backward[j, rows] * flat[ids]
        ids = np.concatenate([x[3] for x in lattice])
        use = np.concatenate([forward[i, rows] * flat[x] * backward[j, rows] for i, j, rows, x in lattice])
        rows = np.concatenate([x[2] for x in lattice])
        own_weights = weights[own]
        for k in range(weights.shape[1]):
            if own_weights[:, k].any():
                out[:, k] += np.bincount(ids, use * own_weights[rows, k], minlength=table.n + 2)
    for w, (word, weight) in enumerate(zip(words, weights, strict=True)):
        if len(word) > SHORT:
            out += _long_counts(table, word, flat)[:, None] * weight
    return out


def _long_counts(table: Pieces, word: str, flat: np.ndarray) -> np.ndarray:
    """Expected uses of pieces in one word of any length: sums as logarithms, one pair a place."""
    n = len(word) + 1
    forward, backward = np.zeros(n + 1), np.zeros(n + 1)
    for at, (x, scale) in enumerate(_sums(table.windows(word), flat[:, None]), 1):
        forward[at] = np.log(x[0]) + scale[0]
    # backward: the window of a place's beginnings, from the last place on
    points = np.frombuffer(("▁" + word).encode("utf-32-le"), np.uint32).astype(np.uint64)
    following, shift = np.zeros(table.longest), 0.0
    following[0] = 1
    spans = table.spans(points, 1)
    begins = np.full((table.longest, n), table.n)
    for k, (at, ids) in enumerate(spans):
        begins[k, at] = ids
    for at in range(n - 1, -1, -1):
        now = float((following * flat[begins[:, at]]).sum())
        following[1:] = following[:-1]
        following[0] = now
        if following.max() < 1e-100:
            shift += np.log(most := following.max())
            following /= most
        backward[at] = np.log(following[0]) + shift
    out = np.zeros(table.n + 2)
    for k, (at, ids) in enumerate(spans, 1):
        out += np.bincount(ids, np.exp(forward[at] + np.log(flat[ids]) + backward[at + k] - forward[n]), minlength=table.n + 2)
    return out


class Model:
    """Per-language piece probabilities."""

    def __init__(self, path: str, languages: list[str], probabilities: np.ndarray) -> None:
        self.path, self.languages, self.probabilities = path, languages, probabilities

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log of each word's probability in each language, summed over all its segmentations by the forward algorithm."""
        table, probabilities = pieces(self.path), self.probabilities
        out = np.zeros((len(words), len(self.languages)))
        for own in _side_by_side(words):
            some = [words[i] for i in own]
            width, lattice = table.lattice(some)
            forward = np.zeros((width + 1, len(some), len(self.languages)))
            forward[0] = 1
            for i, j, rows, ids in lattice:
                forward[j, rows] += forward[i, rows] * probabilities[ids]
            out[own] = np.log(np.maximum(forward[[len(w) + 1 for w in some], np.arange(len(some))], 1e-300))
        for k, word in enumerate(words):
            if len(word) > SHORT and self.languages:
                for x, scale in _sums(table.windows(word), probabilities):
                    pass
                out[k] = np.log(x) + scale
        return out


def _training(docs: DataFrame) -> DataFrame:
    return with_id_hash(docs.select("doc_id", "text", "lang"), FOLDS, "_h").where((F.col("_h") != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def fit(docs: DataFrame, vocabulary_path: str | None = None, most: int = 200_000) -> Model:
    """Learns from the text and lang of all rows with a lang outside the held-out fold.

    Each task counts its distinct words by language and sums the expected uses of every piece over all segmentations; what reaches the driver
    is one number per language and piece of the fixed vocabulary. Null texts and languages teach nothing; with no training row there are no languages."""
    path = vocabulary_path or vocabulary("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts, totals = pieces(path), {}, {}

        def settle() -> None:
            place = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(counts.values())))}
            weights = np.zeros((len(place), len(counts)))
            for k, c in enumerate(counts.values()):
                weights[list(map(place.__getitem__, c)), k] = list(c.values())
            found = expected_counts(table, list(place), weights)
            for k, lang in enumerate(counts):
                totals[lang] = totals.get(lang, 0) + found[:, k]
            counts.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(letter_runs(text))
            if sum(map(len, counts.values())) > most:
                settle()
        if any(counts.values()):
            settle()
        for lang, found in totals.items():
            ids = np.flatnonzero(found[: table.n])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids), pa.array(found[ids])], ["lang", "piece", "uses"])

    training = _training(docs).select("text", "lang")
    sums = training.mapInArrow(run, "lang string, piece long, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toArrow()
    names = sums.column("lang").to_pylist()
    languages = sorted(set(names))
    n = pieces(path).n
    counts = np.zeros((n, len(languages)))
    place = {x: i for i, x in enumerate(languages)}
    counts[sums.column("piece").to_numpy(), [place[x] for x in names]] = sums.column("uses").to_numpy()
    if languages:
        pooled = (counts.sum(1) + 0.1) / (counts.sum() + 0.1 * n)
        total = counts.sum(0)
        counts = (counts + BACKING * total * pooled[:, None]) / ((1 + BACKING) * np.maximum(total, 1))
    return Model(path, languages, np.concatenate((counts, np.zeros((1, len(languages))), np.full((1, len(languages)), UNKNOWN))))


class _Scorer:
    """Word scores behind a cache, emptied at `most` words."""

    def __init__(self, model: Model, most: int = 200_000) -> None:
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, len(self.model.languages)), np.float32)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Summed log likelihoods, words, and whether there is a letter."""
        if len(self.slots) > self.most:
            self.clear()
        words, counts, letter = [], [], []
        for t in texts:
            own = letter_runs(t) if t else []
            words += own
            counts.append(len(own))
            letter.append(bool(own) and (own[0].isalpha() or any(any(map(str.isalpha, w)) for w in own)))
        if new := list(set(words).difference(self.slots)):
            at = len(self.slots)
            while at + len(new) > len(self.scores):
                self.scores = np.concatenate((self.scores, np.zeros_like(self.scores)))
            self.scores[at : at + len(new)] = self.model.word_scores(new)
            self.slots.update(zip(new, range(at, at + len(new)), strict=True))
        slot = itemgetter(*words)(self.slots) if len(words) > 1 else list(map(self.slots.get, words))
        counts = np.array(counts)
        sums = np.zeros((len(words) + 1, self.scores.shape[1]))
        np.cumsum(self.scores[np.array(slot, np.int64)], axis=0, out=sums[1:])
        ends = np.cumsum(counts)
        return sums[ends] - sums[ends - counts], counts, np.array(letter, bool)


_SCORERS: dict[object, _Scorer] = worker_cache()


def predictor(spark: SparkSession, model: Model):
    """A function of an Arrow text column: the predicted language and score of each text, for use on executors."""
    shared = spark.sparkContext.broadcast(model)  # languages x pieces of the vocabulary
    key = (spark.sparkContext.applicationId, uuid.uuid4().hex)

    def predict_texts(column: pa.Array) -> tuple[pa.Array, pa.Array]:
        alone(_SCORERS)
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = _Scorer(shared.value)
        scorer, names = _SCORERS[key], np.array([*shared.value.languages, UNDETERMINED], object)
        found, scores = [np.zeros(0, object)], [np.zeros(0)]
        for a, b, _, _ in slices(column):
            sums, counts, letter = scorer.score(column.slice(a, b - a).to_pylist())
            if len(names) > 1:
                sums = sums * np.minimum(1.0, INDEPENDENT / np.maximum(counts, 1))[:, None]
                top = sums.argmax(1)
                score = 1.0 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
            else:
                top, score, letter = np.zeros(len(counts), int), np.zeros(len(counts)), letter & False
            found.append(names[np.where(letter, top, len(names) - 1)])
            scores.append(np.where(letter, score, 0.0))
        return pa.array(np.concatenate(found), pa.string()), pa.array(np.concatenate(scores))

    return predict_texts


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row.

    Null text or none with a letter: `und` with score 0, as is every row if no language was learned. Score: posterior probability of the language, equal priors.
    Repeated rows: alike. Empty table: no rows. Only doc_id, to name the fold, and text are read."""
    texts = predictor(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *texts(batch.column(1))], ["doc_id", "held_out", "lang_pred", "score"])

    rows = with_id_hash(docs.select("doc_id", "text"), FOLDS, "_h").select(F.col("doc_id").cast("long"), "text", (F.col("_h") == HELD_OUT).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def recognised(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs, with all their columns, whose language is told with a score of `least` or more. Rows are judged where they are read: nothing is shuffled."""
    texts = predictor(docs.sparkSession, model)

    def keep(column: pa.Array) -> pa.Array:
        lang, score = texts(column)
        return pa.array((lang.to_numpy(zero_copy_only=False) != UNDETERMINED) & (score.to_numpy() >= least))

    return docs.where(F.arrow_udf(keep, "boolean")("text"))


def identify(docs: DataFrame) -> DataFrame:
    """fit() and predict() on the same table: doc_id, held_out, lang_pred, score per row. Null, empty and letterless texts are `und` with score 0; rows without lang or in the held-out fold teach nothing;
    repeated rows alike, texts of any length whole; empty table: no rows. Other columns are ignored."""
    return predict(docs, fit(docs))
