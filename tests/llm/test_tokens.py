import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from quern.llm.orc_tokens import read_tokens, tokens_round_trip, write_tokens
from quern.llm.packing import along_curve, hilbert_key, pack
from quern.llm.token_counts import TokenCounter, token_counts
from quern.llm.tokens import WordEncoder, vocabulary

from .conftest import ODD

TEXTS = [t for _, t in ODD] + ["it's a <|endoftext|>test", "a  b \n c\n \n d  ", " lead", "\n\n", "x\x1cy", "a\xa0b \xa0 c", "İstanbul", "don't can't 'll", "ÀÉ. ß, fooBar", "a \n\nb", "# ## ###  x", "word\n\n\n word "] + ["".join(random.Random(k).choice([*"ab é\n .,'1<|>\t😀", "<|endoftext|>"]) for _ in range(300)) for k in range(30)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def words():
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    return lambda t: library.encode(t or "", add_special_tokens=False).ids


def test_word_encoder_equals_library(words):
    encoder = WordEncoder(vocabulary("word_bpe_49k.json"), most=50)
    for some in (TEXTS[:7], TEXTS[7:20], TEXTS[20:], TEXTS):
        ids, at = encoder.encode(some)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [words(t) for t in some]


@pytest.mark.parametrize("chunk, overlap", [(16_384, 512), (100, 40), (60, 33)])
def test_counter_equals_library(chunk, overlap):
    counter = TokenCounter(vocabulary("byte_bpe_50k.json"), chunk, overlap, most=50)
    some = [t if t is None else t[:5000] for t in TEXTS] if chunk < 1000 else TEXTS
    assert counter.count(some) == [len(counter.library.encode(t or "", add_special_tokens=False).ids) for t in some]
    if chunk < 1000:
        assert counter.widened  # runs without a break widen the overlap


def test_orc_round_trip(spark, odd, make, words, tmp_path):
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens_round_trip(odd).collect()))
    at, want = 0, []
    for i, t in rows:
        ids = [*words(t), 1]
        want.append((at, i, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    assert tokens_round_trip(make([])).count() == 0
    write_tokens(make([(k, f"text {k}") for k in range(500)]), str(tmp_path / "o"))
    one = read_tokens(spark, str(tmp_path / "o")).where("doc_id = 77")
    assert "EqualTo(doc_id,77)" in one._jdf.queryExecution().executedPlan().toString()
    assert one.first().tokens == [*words("text 77"), 1]


def test_packing(odd, make, words):
    rows = pack(odd, with_ids=True).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == r.length and crc(r.ids) == r.ids_crc32
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        total = sum(p.length for p in pieces)
        assert total == 4096 or total & (total - 1) == 0 and total < 4096  # nothing is padded
    # every id lies in exactly one piece, or in as many as its row comes
    want = Counter((i, k, x) for i, t in ODD for k, x in enumerate([*words(t), 2]))
    assert Counter((r.doc_id, r.start + k, x) for r in rows for k, x in enumerate(r.ids)) == want
    assert pack(make([])).count() == 0


def test_hilbert_steps_are_neighbours():
    side = 8
    points = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    order = np.argsort(hilbert_key(points, 3))
    assert sorted(hilbert_key(points, 3)) == list(range(side**3))
    assert (np.abs(np.diff(points[order], axis=0)).sum(1) == 1).all()


def test_counts(odd, make):
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = sorted(((r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(odd).collect()))
    assert got == sorted((len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for _, t in ODD)
    assert token_counts(make([])).count() == 0


def test_upper_case_special_strings_stay_text(words):
    encoder = WordEncoder(vocabulary("word_bpe_49k.json"))
    some = ["<|ENDOFTEXT|> A", "A<|endoftext|>B", "ÀÇ É, Ñ.", "İI ıſ Ωςσ.", "don'T", "A.B,C ...", ". , .,", None, ""]
    ids, at = encoder.encode(some, 1)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [[*words(t), 1] for t in some]


def test_orc_stripes_indexes_and_bloom_filters(spark, make, tmp_path):
    """The files have several stripes with row indexes and Bloom filters, and a look-up by doc_id reads a few row groups or none."""
    path, n = str(tmp_path / "o"), 20_000
    write_tokens(spark.range(n).selectExpr("2 * id as doc_id", "array_join(transform(sequence(1, 1000), i -> concat('w', pmod(xxhash64(id, i), 400))), ' ') as text"), path)
    jvm = spark.sparkContext._jvm
    files = [f.getPath() for f in jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(jvm.org.apache.hadoop.fs.Path(path)) if f.getPath().getName().endswith(".orc")]
    stripes = 0
    for file in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(file, jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
        rows = reader.rows()
        for stripe in reader.getStripes():
            stripes += 1
            kinds = {s.getKind().toString() for s in rows.readStripeFooter(stripe).getStreamsList() if s.getColumn() == 1}
            assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
        rows.close()
    assert stripes > len(files)

    def scanned(where):
        one = spark.read.schema("doc_id long, n_tokens int").option("path", path).format("orc").load().where(where)
        one.collect()
        leaves = one._jdf.queryExecution().executedPlan().collectLeaves()
        return leaves.apply(0).metrics().apply("numOutputRows").value()

    assert scanned("doc_id >= 0") == n
    assert 0 < scanned("doc_id = 777 * 2") <= 2000
    # odd ids lie between the row groups' least and greatest, so that only Bloom filters can rule them out
    assert sum(scanned(f"doc_id = {k}") == 0 for k in range(1, 39_999, 4000)) >= 8


def test_neighbours_on_the_curve_are_alike(make):
    """Texts of two vocabularies, and near copies, dealt at random: neighbours share their vocabulary and words far oftener than rows in any order."""
    rng = random.Random(21)
    words = [[f"{x}{k}" for k in range(60)] for x in "pq"]
    texts = [(k % 2, " ".join(rng.choices(words[k % 2], k=rng.randrange(60, 200)))) for k in range(400)]
    texts += [(v, t + " " + rng.choice(words[v])) for v, t in rng.sample(texts, 100)]
    rng.shuffle(texts)
    rows = [(k, t) for k, (_, t) in enumerate(texts)]
    got = [r.doc_id for r in along_curve(make(rows)).select("doc_id").collect()]
    assert sorted(got) == list(range(500))

    def likeness(order):
        sets = [set(zip(w := texts[i][1].split(), w[1:])) for i in order]
        return np.mean([texts[a][0] == texts[b][0] for a, b in zip(order, order[1:])]), np.mean([len(x & y) / len(x | y) for x, y in zip(sets, sets[1:])])

    (same, shared), (same_random, shared_random) = likeness(got), likeness(rng.sample(range(500), 500))
    assert same > same_random + 0.15 and shared > 3 * shared_random
