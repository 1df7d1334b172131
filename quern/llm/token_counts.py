"""Exact token counts; huge documents go through overlapping chunks that are spliced where both sides provably agree."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, slices, worker_cache
from .tokens import vocabulary

LIMIT, CHUNK, OVERLAP = 1024, 16_384, 512
#: No special string of the vocabulary is longer, with room to spare.
_SPECIAL = 32
#: A space between white space on both sides, or two in a row: there a break before the space might fall inside one run of white space.
_RUN = re.compile(r"\s \s|  ")
_PLAIN = re.compile(r" [A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?")


class TokenCounter:
    """Counts as the library's encode() gives them under a byte-level vocabulary.

    A text that has no run of white space over one space long around a space breaks before every space, as the pre-tokenizer breaks there too; counts of such pieces are
    cached. Texts with more than `chunk` characters are counted by chunks, see huge()."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, most: int = 800_000) -> None:
        from tokenizers import Tokenizer

        self.library, self.chunk, self.overlap, self.most = Tokenizer.from_file(path), chunk, overlap, most
        words = self.library.get_vocab()
        self.opens = np.zeros(max(words.values()) + 1, bool)
        self.opens[[i for w, i in words.items() if w.startswith("Ġ")]] = True
        self.known: dict[str, int] = {}
        self.widened = 0

    def _learn(self, pieces: list[str]) -> None:
        plain, odd = [], []
        for w in pieces:
            (plain if _PLAIN.fullmatch(w) else odd).append(w)
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            opens = np.flatnonzero(self.opens[np.array(self.library.encode("".join(some), add_special_tokens=False).ids)])
            # each plain piece begins with its space, and no later token of it does
            total = len(self.library.encode(some[-1], add_special_tokens=False).ids)
            if len(opens) == len(some):
                self.known.update(zip(some, [*np.diff(opens).tolist(), total], strict=True))
            else:
                odd += some
        for at in range(0, len(odd), 4096):
            some = odd[at : at + 4096]
            self.known.update(zip(some, map(len, self.library.encode_batch_fast(some, add_special_tokens=False)), strict=True))

    def count(self, texts: list[str | None]) -> list[int]:
        """Null: 0."""
        if len(self.known) > self.most:
            self.known.clear()
        out = [0] * len(texts)
        pieces: list[str] = []
        owner: list[tuple[int, int]] = []
        for i, t in enumerate(texts):
            if not t:
                continue
            if len(t) > self.chunk:
                out[i] = self.huge(t)
            elif _RUN.search(t):
                out[i] = len(self.library.encode(t, add_special_tokens=False).ids)
            else:
                first, *rest = t.split(" ")
                owner.append((i, len(rest) + 1))
                pieces.append(first)
                pieces += [" " + w for w in rest]
        got = list(map(self.known.get, pieces))
        if None in got:
            self._learn(list(dict.fromkeys(w for w, n in zip(pieces, got, strict=True) if n is None)))
            got = list(map(self.known.__getitem__, pieces))
        at = 0
        for i, n in owner:
            out[i] = sum(got[at : at + n])
            at += n
        return out

    def _chunk(self, text: str, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the tokens of text[a:b] and of those of its pre-tokens, as places in the text."""
        got = self.library.encode(text[a:b], add_special_tokens=False)
        starts = np.array([x for x, _ in got.offsets], np.int64) + a
        words = np.array([-1 - i if w is None else w for i, w in enumerate(got.word_ids)], np.int64)
        new = np.ones(len(words), bool)
        new[1:] = (words[1:] != words[:-1]) | (starts[1:] == starts[:-1])
        new[1:] &= starts[1:] != starts[:-1]  # bytes of one character start at the same place
        return starts, starts[new]

    def huge(self, text: str) -> int:
        """Overlap resynchronisation. The pre-tokenizer reads left to right and looks one character ahead: from a place where both the chunk before and the chunk after begin a pre-token,
        both go on alike. So the chunks are spliced at the last such place that the end of the earlier chunk can't have touched; where the overlap has none, it is widened,
        at last to the whole rest."""
        n, total, at = len(text), 0, 0
        end = min(n, self.chunk)
        starts, words = self._chunk(text, 0, end)
        while end < n:
            overlap = self.overlap
            while True:
                begin = max(at, end - overlap)
                to = min(n, begin + self.chunk + overlap)
                if begin == at:  # the whole of what is open, with more text
                    starts, words = self._chunk(text, at, to)
                    end = to
                    break
                later = self._chunk(text, begin, to)
                common = np.intersect1d(words[words <= end - _SPECIAL], later[1])
                common = common[common > begin]
                if len(common):
                    splice = int(common[-1])
                    total += int(((starts >= at) & (starts < splice)).sum())
                    at, end = splice, to
                    starts, words = later[0][later[0] >= splice], later[1][later[1] >= splice]
                    break
                self.widened += 1
                overlap *= 2
        return total + int((starts >= at).sum())


_COUNTERS: dict[str, TokenCounter] = worker_cache()


def token_counter(path: str) -> TokenCounter:
    """One per Python worker."""
    alone(_COUNTERS)
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, limit: int = LIMIT, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row. Null text: empty, 0 tokens. Repeated rows: each on its own. Empty table: no rows. Other columns are ignored."""
    path = vocabulary_path or vocabulary("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(path)
        for batch in batches:
            for a, b, _, offsets in slices(batch.column(1)):
                counts = np.array(counter.count(batch.column(1).slice(a, b - a).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets)), pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
