"""Token ids at corpus speed: the tokenizers library behind a cache of white-space separated pieces."""

from __future__ import annotations

import json
import os
import re
import zlib
from operator import itemgetter

import numpy as np

from .common import alone, worker_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; the default of every `vocabulary` parameter here."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: What str.split() takes for white space beside space and U+0009 to U+000D: fixed values.
_OTHER_SPACE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SPLIT = re.compile(r"[\x20\x09-\x0D]+")
def split(text: str) -> list[str]:
    odd = _OTHER_SPACE[:4] if text.isascii() else _OTHER_SPACE
    for c in odd:
        if c in text:
            return [w for w in _SPLIT.split(text) if w]
    return text.split()


def _latin(text: str) -> bool:
    """Whether a text is Latin-1: no combining marks, one letter for each in lower case."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def lowered(text: str) -> str:
    """Lower case where that is plainly the vocabulary's own first step. Special strings are left as they are."""
    return text.lower() if "<|" not in text and _latin(text) else text


def is_lowered(text: str) -> bool:
    return _latin(text) and text == text.lower()


class WordEncoder:
    """Ids of whole texts under a lower-case vocabulary whose pre-tokenizer drops white space, as the library's encode() gives them.

    No token spans ASCII white space there, so a text's ids are those of its pieces in a row. Pieces that are new go to the library: runs of letters
    many at a time, joined by spaces and cut after the tokens that end a word; other pieces one by one. Ids are kept as bytes, by piece: the text's
    are joined from them. Of two generations of the cache, each of at most `most` pieces, the older one is dropped when the younger is full."""

    def __init__(self, path: str, most: int = 400_000) -> None:
        from tokenizers import Tokenizer, models

        self.library, self.most = Tokenizer.from_file(path), most
        # lower-case runs of Latin-1 letters pass its normaliser unchanged and hold no special string, so it is spared them
        bare = json.loads(self.library.to_str())
        self.bare = Tokenizer.from_str(json.dumps(bare | {"normalizer": None, "added_tokens": []}))
        model = bare["model"]
        self.bare.model = models.BPE(model["vocab"], [tuple(x) for x in model["merges"]], cache_capacity=0, end_of_word_suffix=model["end_of_word_suffix"])
        words = self.library.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, words: list[str]) -> None:
        """Puts the ids of words that hold no white space into the cache."""
        plain = [w for w in words if w.isalpha()]
        odd = [w for w in words if not w.isalpha()]
        plain.sort(key=str.isascii)
        for at in range(0, len(plain), 1024):
            some = plain[at : at + 1024]
            text = " ".join(some)
            library = self.bare if is_lowered(text) else self.library
            ids = np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                odd += some
                continue
            ends = (ends * 4).tolist()
            data = ids.tobytes()
            self.known.update(zip(some, [data[a:b] for a, b in zip([0, *ends], ends)]))
        for at in range(0, len(odd), 4096):
            some = odd[at : at + 4096]
            self.known.update((w, np.array(x.ids, np.int32).tobytes()) for w, x in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True))

    def _learn(self, words: set[str]) -> None:
        known, older = self.known, self.older
        if older:
            again = words & older.keys()
            known.update((w, older[w]) for w in again)
            words = words - again
        # a run of letters with a sign after it has the ids of the letters and the sign's
        whole, signed = [".", ","], []
        for w in words:
            (signed if w[-1] in ".," and w[:-1].isalpha() else whole).append(w)
        bare = [w[:-1] for w in signed]
        self._whole(list({*whole, *bare}.difference(known)))
        known.update(zip(signed, [known[w] + known[s[-1]] for w, s in zip(bare, signed)]))

    def _bytes(self, texts: list[str | None], end: bytes) -> list[bytes]:
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        pieces = [split(lowered(t)) if t else [] for t in texts]
        if new := set().union(*pieces).difference(self.known):
            self._learn(new)
        known = self.known
        return [b"".join(itemgetter(*own)(known) if len(own) > 1 else map(known.get, own)) + end for own in pieces]

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with id `end` after it if that is given, and n + 1 offsets. Null: empty."""
        own = self._bytes(texts, b"" if end is None else np.int32(end).tobytes())
        at = np.zeros(len(own) + 1, np.int64)
        np.cumsum([len(x) >> 2 for x in own], out=at[1:])
        return np.frombuffer(b"".join(own), np.int32), at


_ENCODERS: dict[tuple[str, int], WordEncoder] = worker_cache()


def word_encoder(path: str, most: int = 400_000) -> WordEncoder:
    """One per Python worker. A piece in the cache takes about 200 bytes, and there are up to twice `most`."""
    alone(_ENCODERS)
    if (path, most) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, most] = WordEncoder(path, most)
    return _ENCODERS[path, most]


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
