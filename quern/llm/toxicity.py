"""Toxicity through a noisy channel: disguised words are restored by Viterbi decoding, then the restored text is scored."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, alone, cut, mix, slices, with_id_hash, word_hashes, worker_cache, written
from .tokens import split

FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
#: A unit of the lexicon is in at least so many different toxic texts, is so many times as frequent there as in clean ones, and that it isn't BOUND times as frequent is refuted at a false-discovery rate of FALSE.
TEXTS, RATIO, BOUND, FALSE = 3, 25.0, 3.0, 0.05
#: Most labelled rows the classifier is fitted on.
LABELLED = 50_000
#: Names under which the numbers of rows travel with the units; no word has their sign.
_TOXIC, _CLEAN = "\0toxic", "\0clean"
#: Least letters of a stem, which stands for all words that begin with it, and of a word. A stem that has nearly as many texts when a letter longer gives way to that one.
STEM, WORD, NEARLY = 4, 3, 0.9
#: Letters that a word cut by spaces may have beyond its stem.
ENDING = 3
#: Letters that a sign may stand for, with what the channel charges. Fixed values.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "¡": "i", "£": "l", "*": "aeiou"}
#: Letters that look like another one, beside those that Unicode decomposes. Fixed values.
LETTERS = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ɡ": "g", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "l": "i"}
#: Letters written as two that look like one.
PAIRS = {"vv": "w", "rn": "m"}
SWAP_COST, DROP_COST, REPEAT_COST, ACCENT_COST, SPACE_COST = 1.0, 0.5, 0.3, 0.5, 2.0
SEPARATORS = ".-_*~·,'`^/\\:"
#: The least letters a row of single ones has.
LEAST = 3
_EDGE = re.compile(r"^[^\w@$€£¡|+(]+|[^\w@]+$")
#: Signs at an edge that stand for no letter: no reading of them is lost with them; and plain numbers, which aren't read as words.
_BARE = re.compile(r"^[^\w@$€£¡|+(!]+|[^\w@$€£¡|+(!]+$")
_NUMBER = re.compile(r"[\d.,:/\-+$€£()%!~*'_|]*")
_SPLIT = re.compile("[" + re.escape(SEPARATORS) + "]+")
_LETTERS = re.compile(r"[^\W\d_]{3,}")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?")
_WILD = re.compile(r"[^\W_]\*+[^\W_]")
#: Bins of the summed weight of hits, and what each bin's share of toxic rows is taken for as four rows say.
_BINS = (0.0, 1e-9, 4.0, 5.5, 8.0, 14.0)
_PRIOR = (None, 0.5, 0.8, 0.92, 0.95, 0.97)


@dataclass
class CharModel:
    """Trigram probabilities over word edge (0), a to z (1 to 26) and any other letter (27)."""

    logs: np.ndarray  # 28 x 28 x 28

    def __post_init__(self) -> None:
        self.costs = (-self.logs).ravel().tolist()

    def cost(self, a: int, b: int, c: int) -> float:
        return self.costs[a * 784 + b * 28 + c]


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 0 if c in ("", " ") else 27


def look_alike(c: str) -> str:
    """The plain letter that a letter looks like; itself if there is none."""
    return LETTERS.get(c) or (c if c < "\x80" else unicodedata.normalize("NFKD", c)[0])


def options(c: str, previous: str) -> list[tuple[str, float]]:
    """What a sign may have been written for ('': nothing, ' ': the edge of a word), with the channel's cost."""
    out = []
    if c == " ":
        return [(" ", 0.0), ("", SPACE_COST)]
    if c.isalpha():
        out.append((c, 0.0))
        if (plain := look_alike(c)) != c:
            out.append((plain, ACCENT_COST if c > "\x80" else SWAP_COST))
        if c == previous:
            out.append(("", REPEAT_COST))
    else:
        out += [(x, SWAP_COST) for x in LOOKS.get(c, "")]
        if c in SEPARATORS or not out:
            out.append(("", DROP_COST))
        elif c == previous:
            out.append(("", REPEAT_COST))
    return out


def _class(c: str) -> str:
    """One letter for all that a sign may be read as; '' if it is only dropped."""
    c = LETTERS.get(c, c)
    c = "" if c == "*" else LOOKS.get(c, c)[0]
    return {"l": "i", "w": "v"}.get(c, c) if c.isalpha() else ""


_CLASSES = str.maketrans({c: _class(c) for c in [*map(chr, range(128)), *LOOKS, *LETTERS]})
_SAME = re.compile(r"(.)\1+")


def skeleton(piece: str) -> str:
    """What all readings of a piece have in common: look-alikes as one letter, repeats once, and no other signs. Words with other skeletons can't be meant by it, unless it has '*' between letters."""
    if not piece.isascii():
        piece = "".join(c for c in unicodedata.normalize("NFKD", piece) if not unicodedata.combining(c))
    out = piece.translate(_CLASSES)
    if not out.isalpha():
        out = "".join(c for c in out if c.isalpha())
    return _SAME.sub(r"\1", _SAME.sub(r"\1", out).replace("rn", "m"))


_OPTIONS: dict[tuple[str, bool], list[tuple[str, int, float]]] = {}


def _options(c: str, same: bool) -> list[tuple[str, int, float]]:
    """options() with each letter's symbol, kept for the signs seen."""
    if (found := _OPTIONS.get((c, same))) is None:
        if len(_OPTIONS) > 100_000:
            _OPTIONS.clear()
        found = _OPTIONS[c, same] = [(x, symbol(x), charge) for x, charge in options(c, c if same else "")]
    return found


def restores(piece: str, model: CharModel, ends: set[int]) -> list[str]:
    """The likeliest word behind each beginning of a piece that `ends` has the length of: Viterbi over the lattice of its signs' options, with the last two letters as the state.

    The time is linear in the length: a state holds its letters as a chain."""
    costs = model.costs
    # a state's key is its last two letters; its value the cost, the chain of letters, and the two letters' symbols
    states: dict[tuple[str, str], tuple] = {("", ""): (0.0, None, 0, 0)}
    out, previous = [], ""

    def best() -> str:
        last = [(cost + costs[a * 784 + b * 28], chain) for cost, chain, a, b in states.values()]
        least = min(x[0] for x in last)
        texts = []
        for cost, chain in last:
            if cost == least:
                letters = []
                while chain:
                    chain, letter = chain
                    letters.append(letter)
                texts.append("".join(reversed(letters)))
        return min(texts)

    for at, c in enumerate(piece, 1):
        following: dict[tuple[str, str], tuple] = {}
        choices = _options(c, c == previous)
        for key, (cost, chain, a, b) in states.items():
            for letter, x, charge in choices:
                if letter:
                    new, total = (key[1], letter), cost + charge + costs[a * 784 + b * 28 + x]
                    if new not in following or total < following[new][0]:
                        following[new] = (total, (chain, letter), b, x)
                else:
                    total = cost + charge
                    if key not in following or total < following[key][0]:
                        following[key] = (total, chain, a, b)
        states, previous = following, c
        if at in ends:
            out.append(best())
    return out or [""]


def restore(piece: str, model: CharModel) -> str:
    """The likeliest word behind a whole piece."""
    return restores(piece, model, {len(piece)})[0]


def _edges(piece: str) -> tuple[list[int], list[int]]:
    """Where a word may begin and end in a piece: with each run of equal signs at its edges kept or left out."""
    n = len(piece)
    a = next((i for i, c in enumerate(piece) if c.isalnum()), n)
    if a == n:
        return [0], [n]
    b = next(i for i in range(n, 0, -1) if piece[i - 1].isalnum())
    return [i for i in range(a + 1) if i in (0, a) or piece[i] != piece[i - 1]], [i for i in range(b, n + 1) if i in (b, n) or piece[i] != piece[i - 1]]


def trim(piece: str) -> str:
    return _EDGE.sub("", piece)


def units(word: str) -> list[str]:
    """The word, and its stems with a '-' at their end."""
    return [word, *(word[:k] + "-" for k in range(STEM, len(word) + 1))]


def _forms(piece: str) -> list[str]:
    """The piece, also with pairs of letters that look like one as that one."""
    out = [piece]
    for pair, one in PAIRS.items():
        out += [x.replace(pair, one) for x in out if pair in x]
    return out


@dataclass
class Lexicon:
    """Weights of units, the character model they are read with, and the probability of each bin of summed weight."""

    weights: dict[str, float] = field(default_factory=dict)
    chars: CharModel | None = None
    bins: tuple[float, ...] = (0.05, *_PRIOR[1:])

    @cached_property
    def lengths(self) -> list[int]:
        """Lengths of units, ascending."""
        return sorted({len(u.removesuffix("-")) for u in self.weights})

    @cached_property
    def stems(self) -> list[int]:
        return sorted({len(u) - 1 for u in self.weights if u.endswith("-")})

    @cached_property
    def skeletons(self) -> set[str]:
        return {k for u in self.weights if (k := skeleton(u))}

    @cached_property
    def heads(self) -> set[str]:
        """What the skeletons of units begin with."""
        return {k[:n] for k in self.skeletons for n in range(1, len(k))}

    @cached_property
    def firsts(self) -> set[str]:
        """Letters that a reading may begin with if it begins with a unit."""
        own = {k[0] for k in self.skeletons}
        own |= {"r"} if "m" in own else set()
        return {c for c in map(chr, range(65, 592)) if c.isalpha() and skeleton(c.lower())[:1] in own}

    @cached_property
    def spans(self) -> list[int]:
        return sorted({len(k) for k in self.skeletons})

    def weight(self, word: str) -> float:
        w = self.weights.get(word, 0.0)
        for k in self.stems:
            if k > len(word):
                break
            if (more := self.weights.get(word[:k] + "-", 0.0)) > w:
                w = more
        return w

    @cached_property
    def single(self) -> "Lexicon":
        """The same units with doubled letters written once, as readings of words with repeated letters may be."""
        return Lexicon({_SAME.sub(r"\1", u): w for u, w in sorted(self.weights.items(), key=lambda x: x[1])})

    def begins(self, bones: str) -> bool:
        return any(bones[:n] in self.skeletons for n in self.spans if n <= len(bones))

    def possible(self, piece: str) -> bool:
        """Whether any reading of the piece can begin with a unit."""
        return bool(_WILD.search(piece)) or any(self.begins(skeleton(piece[a:])) for a in _edges(piece)[0])

    def _read(self, piece: str) -> float:
        """Weight of the heaviest reading of a piece with signs, with and without those at its edges."""
        if not self.possible(piece):
            return 0.0
        found = 0.0
        for form in _forms(piece):
            starts, ends = _edges(form)
            for start in starts:
                for word in restores(form[start:], self.chars, {e - start for e in ends}):
                    found = max(found, self.weight(word) or self.single.weight(_SAME.sub(r"\1", word)))
        return found

    def joined(self, pieces: list[str]) -> float:
        """Weight of a word that was cut into pieces by spaces: its likeliest reading, with spaces as signs that were put in or are the edges of words, has a unit that spans them."""
        text = " ".join(p.lower() for p in pieces)
        found = 0.0
        for form in _forms(_BARE.sub("", text)):
            words = restore(form, self.chars).split(" ")
            if len(words) < len(pieces):
                # a stem with a long rest may as well be two words that stand side by side
                found = max([found, *(self.weights.get(u, 0.0) for u in units(words[0]) if len(words[0]) - len(u) < ENDING)])
        return found

    def row(self, letters: str) -> tuple[int, float]:
        """Toxic units in a row of single letters, and their summed weight: the heaviest choice of places that don't overlap. A unit may stand anywhere."""
        word = restore(letters, self.chars)
        best = [(0.0, 0)]
        for j in range(1, len(word) + 1):
            top = best[-1]
            for n in self.lengths:
                if n > j:
                    break
                unit = word[j - n : j]
                w = max(self.weights.get(unit, 0.0), self.weights.get(unit + "-", 0.0))
                if w and best[j - n][0] + w > top[0]:
                    top = (best[j - n][0] + w, best[j - n][1] + 1)
            best.append(top)
        return best[-1][1], best[-1][0]

    def piece(self, piece: str) -> tuple[int, float]:
        """Toxic words in a piece of text between white space and their summed weight: as it stands, restored as a whole, or part by part."""
        piece = piece.lower()
        if not piece.isascii():
            piece = _HIDDEN.sub("", piece)
        word = trim(piece)
        found = self.weight(word)
        if found and word.isalpha():
            return 1, found
        core = _BARE.sub("", piece)
        if not core or _NUMBER.fullmatch(core):
            return int(found > 0), found
        whole = max(found, self._read(core))
        if core.isalpha():
            return int(whole > 0), whole
        ways = [(int(whole > 0), whole)]
        plain = [w for x in _LETTERS.findall(core) if (w := self.weight(x))]
        ways.append((len(plain), sum(plain)))
        parts = [x for x in _SPLIT.split(core) if x]
        if len(parts) > 1:
            count, total, row = 0, 0.0, []
            for part in [*parts, ""]:
                if len(part) == 1:
                    row.append(part)
                    continue
                if LEAST <= len(row) < len(parts):
                    n, w = self.row("".join(row))
                    count, total = count + n, total + w
                row = []
                if part and not _NUMBER.fullmatch(part):
                    w = self.weight(part) or self._read(part)
                    count, total = count + int(w > 0), total + w
            if len(row := [x for x in parts if len(x) == 1]) == len(parts) and not whole and len(row) >= LEAST:
                count, total = self.row("".join(row))
            ways.append((count, total))
        return max(ways, key=lambda x: x[1])


class _Scorer:
    """Piece weights behind a cache, emptied at `most` pieces. Lone signs have the weight -1: rows of these are restored together. -2: a piece that a unit may begin with."""

    def __init__(self, lexicon: Lexicon, most: int = 400_000) -> None:
        self.lexicon, self.most, self.known = lexicon, most, {}
        self.more: dict[str, int] = {}  # pieces with several toxic words

    def _look(self, piece: str) -> float:
        lone = piece.strip(SEPARATORS)
        if len(lone) == 1 and (lone.isalpha() or lone in LOOKS):
            return -1.0
        if _PLAIN.fullmatch(piece):  # most words: a quick no
            word = piece.rstrip(".,")
            if word[0] not in self.lexicon.firsts:
                return 0.0
            bones = skeleton(word.lower())
            if not self.lexicon.begins(bones):
                return -2.0 if len(word) == len(piece) and bones in self.lexicon.heads else 0.0
        count, weight = self.lexicon.piece(piece)
        if count > 1:
            self.more[piece] = count
        return weight or (-2.0 if piece[-1] not in ".,;:?" and skeleton(piece.lower()) in self.lexicon.heads else 0.0)

    def _cut_words(self, pieces: list[str], places: list[int]) -> tuple[int, float]:
        """Words that spaces cut, from each of the places on."""
        lexicon, count, total, free = self.lexicon, 0, 0.0, 0
        for i in places:
            if i < free or not (raw := pieces[i].lower())[-1].isalnum() and raw[-1] not in LOOKS:
                continue
            for j in range(i + 1, len(pieces)):
                raw += pieces[j].lower()
                bones = skeleton(raw)
                if lexicon.begins(bones):
                    if w := lexicon.joined(pieces[i : j + 1]):
                        count, total, free = count + 1, total + w, j + 1
                    break
                if bones not in lexicon.heads or raw[-1] in ".,;:?":
                    break
        return count, total

    def hits(self, text: str | None) -> tuple[int, float, int]:
        """Toxic words in the text, their summed weight, and its pieces."""
        if not text:
            return 0, 0.0, 0
        if len(self.known) > self.most:
            self.known.clear()
            self.more.clear()
        known, pieces = self.known, split(text)
        weights = list(map(known.get, pieces))
        if None in weights:
            for i, w in enumerate(weights):
                if w is None:
                    weights[i] = known[pieces[i]] = self._look(pieces[i])
        found = np.array(weights)
        count, total = int((found > 0).sum()), float(found[found > 0].sum())
        if self.more and count:
            count += sum(self.more[pieces[i]] - 1 for i in np.flatnonzero(found > 0).tolist() if pieces[i] in self.more)
        begins = found < 0
        if begins.any():
            edges = np.flatnonzero(np.diff(np.concatenate(([0], (found == -1).view(np.int8), [0]))))
            for a, b in edges.reshape(-1, 2).tolist():
                if b - a >= LEAST:
                    n, w = self.lexicon.row("".join(p.strip(SEPARATORS) for p in pieces[a:b]).lower())
                    count, total = count + n, total + w
                    if n:
                        begins[a:b] = False
            n, w = self._cut_words(pieces, np.flatnonzero(begins).tolist())
            count, total = count + n, total + w
        return count, total, len(pieces)


def text_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The least hash of each text's 5-word runs (of all its words, if fewer): near copies mostly share it, other texts don't."""
    hashes, at = word_hashes(data, offsets)
    step = np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros(len(offsets) - 1, np.uint64)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        h, n = hashes[a:b], min(5, b - a)
        if n:
            run = np.zeros(b - a - n + 1, np.uint64)
            for k in range(n):
                run = mix(run * step + h[k : k + len(run)])
            out[i] = run.min()
    return out.view(np.int64)


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic) of at most `most` labelled rows outside the held-out fold, first by a hash of doc_id, and of near copies one; written, so that the texts are picked once. Their ids are few enough to be broadcast, so texts stay where they are read."""
    marks = with_id_hash(labels.where("toxic is not null and doc_id is not null"), FOLDS, "_h").where(F.col("_h") != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    @F.arrow_udf("long")
    def key(text: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([text_keys(data, offsets) for _, _, data, offsets in slices(text)] or [np.zeros(0, np.int64)]))

    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(marks), "doc_id")
    rows = written(rows.select("text", F.col("toxic").cast("int"), key("text").alias("key"), F.xxhash64("doc_id", "text").alias("row")), "labelled")
    one = rows.groupBy("key", "toxic").agg(F.min("row").alias("row"))
    return rows.join(F.broadcast(one), ["key", "toxic", "row"]).select("text", "toxic")


def significant(toxic: np.ndarray, clean: np.ndarray, toxic_rows: int, clean_rows: int, tested: int = 0) -> np.ndarray:
    """Which counts refute, by Chernoff's bound of the binomial tail, that a unit is only BOUND times as frequent in toxic texts; Benjamini and Hochberg's step-up at the rate FALSE. tested: all units, if those that clearly don't are left out."""
    n = toxic + clean
    at_most = BOUND * toxic_rows / (BOUND * toxic_rows + clean_rows)
    share = toxic / n
    with np.errstate(divide="ignore", invalid="ignore"):
        far = share * np.log(share / at_most) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - at_most)), 0.0)
    logs = np.where(share > at_most, -n * far, 0.0)
    order = np.argsort(logs)
    passed = np.flatnonzero(logs[order] <= np.log(FALSE * np.arange(1, len(n) + 1) / max(len(n), tested, 1)))
    out = np.zeros(len(n), bool)
    out[order[: passed[-1] + 1 if len(passed) else 0]] = True
    return out


def concise(weights: dict[str, float], texts: dict[str, int]) -> dict[str, float]:
    """Units without those that others stand for: a stem gives way to one a letter longer with nearly as many texts, and words and stems to the shortest stem left that they begin with."""
    longer: dict[str, int] = {}
    for u in weights:
        if u.endswith("-") and len(u) > STEM + 1:
            longer[u[:-2] + "-"] = max(longer.get(u[:-2] + "-", 0), texts[u])
    kept: dict[str, float] = {}
    for u in sorted((u for u in weights if u.endswith("-") and longer.get(u, 0) < NEARLY * texts[u]), key=lambda u: (len(u), u)):
        if not any(u[:k] + "-" in kept for k in range(STEM, len(u) - 1)):
            kept[u] = weights[u]
    return kept | {u: w for u, w in weights.items() if not u.endswith("-") and not any(u[:k] + "-" in kept for k in range(STEM, len(u) + 1))}


def char_model(docs: DataFrame, words: dict[str, float]) -> CharModel:
    """Trigrams of all texts, one array of 28 ** 3 counts a task, and of the lexicon's words with a tenth of their mass. Null and empty texts count nothing, repeated rows each time; without any text all letters are alike."""
    codes = np.full(256, 27, np.int64)
    codes[[32, *range(9, 14)]] = 0
    codes[97:123] = np.arange(1, 27)
    codes[33:97] = codes[123:128] = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(28**3, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                s = codes[LOWER[data]]
                s = np.insert(s, offsets, 0)
                s = np.concatenate((s[(s != 0) | np.concatenate(([True], s[:-1] != 0))], [0]))
                counts += np.bincount(s[:-2] * 784 + s[1:-1] * 28 + s[2:], minlength=28**3) if len(s) > 2 else 0
                start = np.flatnonzero((s[:-1] == 0) & (s[1:] != 0))
                counts += np.bincount(s[start + 1], minlength=28**3)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["code", "n"])

    counts = np.zeros(28**3)
    for row in docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        counts[row.code] = row.n
    own = np.zeros(28**3)
    for w, weight in words.items():
        s = [0, 0, *map(symbol, w.removesuffix("-")), *([] if w.endswith("-") else [0])]
        for a, b, c in zip(s, s[1:], s[2:]):
            own[a * 784 + b * 28 + c] += weight
    if own.sum():
        counts = counts + own * (0.1 * max(counts.sum(), 1) / own.sum())
    cube = counts.reshape(28, 28, 28)
    two, one = cube.sum(0), cube.sum((0, 1))
    p1 = (one + 1) / (one.sum() + 28)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    return CharModel(np.log((cube + 5 * p2[None]) / (cube.sum(2, keepdims=True) + 5)))


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Lexicon:
    """Learns the lexicon and its calibration from at most `most` labelled rows outside the held-out fold, and the character model from all texts.

    A unit, a word or a stem, counts once in each toxic and each clean text that has it; of near copies one text counts. The driver gets the units
    that are RATIO times as frequent in the toxic ones of these rows. Null texts and labels teach nothing. No label: nothing is toxic."""
    labelled = _labelled(docs, labels, most)

    def count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bool, Counter] = {True: Counter(), False: Counter()}

        def out() -> Iterator[pa.RecordBatch]:
            names = [*found[True], *found[False]]
            if names:
                split_at = len(found[True])
                n = np.array([*found[True].values(), *found[False].values()], np.int64)
                first = np.arange(len(n)) < split_at
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.where(first, n, 0)), pa.array(np.where(first, 0, n))], ["unit", "toxic", "clean"])
            found[True].clear()
            found[False].clear()

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w for p in set(split(text.lower())) if len(w := trim(p)) >= WORD and w.isalpha()}
                own = found[bool(toxic)]
                own.update(words)
                own.update({w[:k] + "-" for w in words for k in range(STEM, len(w) + 1)})
                own[_TOXIC if toxic else _CLEAN] += 1
            if len(found[True]) + len(found[False]) > 1_000_000:
                yield from out()
        yield from out()

    table = cut(labelled.mapInArrow(count_units, "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where((F.col("toxic") >= TEXTS) | F.col("unit").isin(_TOXIC, _CLEAN)))
    sizes = {r.unit: r.toxic + r.clean for r in table.where(F.col("unit").isin(_TOXIC, _CLEAN)).collect()}
    n = {True: sizes.get(_TOXIC, 0), False: sizes.get(_CLEAN, 0)}
    # all units of at least TEXTS toxic texts are tested; those that are RATIO times as frequent reach the driver, bounded by the labelled rows
    own = table.where(~F.col("unit").isin(_TOXIC, _CLEAN))
    tested = own.count()
    arrow = own.where((F.col("toxic") + 0.5) * (n[False] + 1) >= F.lit(0.999 * RATIO) * (F.col("clean") + 1.5) * (n[True] + 1)).toArrow()
    names, toxic, clean = arrow.column("unit").to_pylist(), arrow.column("toxic").to_numpy(), arrow.column("clean").to_numpy()
    logs = np.log((toxic + 0.5) / (clean + 1.5) * ((n[False] + 1) / (n[True] + 1)))
    good = np.flatnonzero(significant(toxic, clean, n[True], n[False], tested) & (logs >= np.log(RATIO))).tolist() if n[True] and n[False] else []
    weights = concise({names[i]: float(logs[i]) for i in good}, {names[i]: int(toxic[i]) for i in good})
    lexicon = Lexicon(weights)
    lexicon.chars = char_model(docs, {u: 1.0 for u in lexicon.weights})
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # units of `most` rows at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, seen = _Scorer(shared.value), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[bin_of(scorer.hits(text)[1]), bool(toxic)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in seen], pa.int32()), pa.array([t for _, t in seen], pa.bool_()), pa.array(list(seen.values()), pa.int64())], ["bin", "toxic", "n"])

    table = Counter()
    for r in labelled.mapInArrow(count, "bin int, toxic boolean, n long").groupBy("bin", "toxic").agg(F.sum("n").alias("n")).collect():
        table[r.bin, r.toxic] = r.n
    base = n.get(True, 0) / max(sum(n.values()), 1)
    shares = [(table[b, True] + 4 * (base if p is None else p)) / (table[b, True] + table[b, False] + 4) for b, p in enumerate(_PRIOR)]
    lexicon.bins = tuple(float(x) for x in np.maximum.accumulate(shares)) if n.get(True) else (0.0,) * len(_PRIOR)
    return lexicon


def bin_of(weight: float) -> int:
    return int(np.searchsorted(_BINS, weight, "right")) - 1


_SCORERS: dict[str, _Scorer] = worker_cache()


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, hits per row. Null and empty texts score as one without a hit; repeated rows: alike. Only doc_id, to name the fold, and text are read.

    Within a bin the score rises a little with the share of toxic words. hits: the toxic words, where they make a text likelier toxic than not; else 0."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    key = f"{docs.sparkSession.sparkContext.applicationId} {id(lexicon)} {len(lexicon.weights)} {hash(tuple(lexicon.weights.items()))}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(_SCORERS)
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = _Scorer(shared.value)
        scorer, bins = _SCORERS[key], [*shared.value.bins, 1.0]
        for batch in batches:
            for a, b, _, _ in slices(batch.column(1)):
                out, counts = [], []
                for text in batch.column(1).slice(a, b - a).to_pylist():
                    hits, weight, words = scorer.hits(text)
                    k = bin_of(weight)
                    out.append(min(1.0, bins[k] + (bins[k + 1] - bins[k]) * 0.2 * hits / (hits + words)) if hits else bins[0])
                    counts.append(hits if bins[k] >= 0.5 else 0)
                s = np.array(out)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(counts, pa.int64())], ["doc_id", "held_out", "score", "predicted", "hits"])

    rows = with_id_hash(docs.select("doc_id", "text"), FOLDS, "_h").select(F.col("doc_id").cast("long"), "text", (F.col("_h") == HELD_OUT).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, hits long")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """fit() and score(): doc_id, held_out, score, predicted, hits per row of docs, whole texts, in no order. Null and empty texts score as texts without a hit; repeated rows alike;
    without documents there are no rows, and without labels nothing is predicted toxic. Other columns of either table are ignored."""
    return score(docs, fit(docs, labels))
