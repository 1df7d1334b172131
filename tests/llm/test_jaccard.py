import random
import re
from collections import defaultdict

import numpy as np

from quern.llm import jaccard
from quern.llm.components import connected_components
from quern.llm.jaccard import near_duplicate_classes

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOW = {i: i + 32 for i in range(65, 91)}


def brute(rows):
    sets = []
    for i, t in rows:
        w = _WORD.findall((t or "").translate(_LOW))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[find(k)].append(i)
    return sorted(((i, len(s), min((v for v in least[find(k)] if v is not None), default=None)) for k, (i, s) in enumerate(sets)), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicate_classes(df).collect()), key=str)


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice("pqrstuv") + str(rng.randrange(99))
    return " ".join(words)


def test_chains_groups_and_shared_passages(make):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(3))
    base = [word() for _ in range(120)]
    passage = " ".join(word() for _ in range(40))
    texts = [" ".join(base)] * 25 + [edited(base, rng, rng.randrange(1, 9)) for _ in range(70)]
    chain = base
    for _ in range(12):  # each near its neighbour, the ends far apart
        chain = edited(chain, rng, 3).split()
        texts.append(" ".join(chain))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randrange(2, 60))) for _ in range(40)]
    texts += [" ".join(word() for _ in range(rng.randrange(1, 9))) for _ in range(40)] + ["that it", "That IT", "a b c d e", "a b c d e f", "b a"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert result(make(rows)) == brute(rows)


def test_odd_rows(odd):
    from .conftest import ODD

    assert result(odd) == brute(ODD)


def test_empty(make):
    assert near_duplicate_classes(make([])).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(7, 7)]
    group = {}
    for a, b in edges:
        x, y = group.setdefault(a, {a}), group.setdefault(b, {b})
        if x is not y:
            x |= y
            for v in y:
                group[v] = x
    got = {r.u: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: min(g) for v, g in group.items() if len(g) > 1}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_sets_under_one_hash_are_told_apart(make):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(3))
    texts = [" ".join(word() for _ in range(rng.randrange(5, 30))) for _ in range(120)]
    texts += texts[:30] + [edited(t.split(), rng, 1) for t in texts[:30]]
    rows = list(enumerate(texts))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicate_classes(make(rows), bits=5).collect()), key=str)
    assert got == brute(rows)


def test_a_shingle_of_all_sets_goes_to_no_bucket(make):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(3))
    passage = " ".join(word() for _ in range(30))
    rows = [(k, passage + " " + " ".join(word() for _ in range(rng.randrange(1, 40)))) for k in range(300)]
    docs = make(rows)
    known = jaccard.Sets(docs)
    assert 20 <= len(known.hot) <= 200 and known.counts.max() > 250
    most = 0
    for r in jaccard._entries(docs, 5, 1, known).collect():
        tokens = jaccard._whole(np.frombuffer(r.hash, np.uint8))
        most = max(most, np.unique(tokens, return_counts=True)[1].max())
    assert most < 10
    assert result(docs) == brute(rows)
