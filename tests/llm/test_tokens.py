import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import sentencepiece_scan as S
from lodestone.llm import token_counts as T
from lodestone.llm.pieces import MARK, PATH, Decoder, Lattice, Vocabulary, normalised, pretokens
from tests.llm.fixtures import docs, rows, words


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load()


@pytest.fixture(scope="module")
def lattice(vocabulary):
    return Lattice(vocabulary)


@pytest.fixture(scope="module")
def library():
    """The library's own unigram decoder over the same pieces. Scores of -1e9 are raised: its sums have 24 bits."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(PATH, "rb").read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        if p.score < -1e8:
            p.score = -1e5
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def plain(lattice, text):
    """Best path over the whole normalised text by the textbook loop over a dictionary of pieces."""
    v = lattice.vocabulary
    ids = {v.pieces[i]: i for i, ok in enumerate(v.usable) if ok}
    best, back = [0], [None]
    for end in range(1, len(text) + 1):
        top = None
        for k in range(1, min(end, lattice.longest) + 1):
            i = ids.get(text[end - k : end])
            if i is not None or k == 1:
                s = best[end - k] + (int(lattice.weight[i]) if i is not None else -(1 << 37))
                if top is None or s > top[0]:
                    top = (s, k, i)
        best.append(top[0])
        back.append(top[1:])
    at, out = len(text), []
    while at:
        k, i = back[at]
        out[:0] = [i] if i is not None else [v.bytes_at[b] for b in text[at - 1].encode()]
        at -= k
    return out


def ids(packed):
    return np.frombuffer(packed, "<i4").tolist()


def test_words_as_the_library_decodes_them(lattice, library):
    some = sorted({w for i in range(300) for w in words(i, 40).split()} | {"Hello", "tokenization", "naïve", "été", "12345", "don't"})
    for w, packed in zip(some, lattice.encode_words([MARK + w for w in some]), strict=True):
        own, other = ids(packed), library.encode(w)
        assert own == other or sum(map(lattice.weight.__getitem__, own)) >= sum(map(lattice.weight.__getitem__, other))
        assert len(w) > 12 or own == other


def test_whole_texts_against_the_plain_loop(lattice):
    encoder, decoder = S.Encoder(lattice), Decoder(lattice.vocabulary)
    texts = [t for _, t in rows() if t and len(t) < 3000] + ["a  b", " a", "  ", "日本\n\tx", "x" * 600, "\U0001f600" * 20, "end "]
    for t, packed in zip(texts, encoder.encode(texts)[0], strict=True):
        assert ids(packed) == plain(lattice, normalised(t))
        assert decoder.decode(packed) == t
    assert encoder.encode([""]) == ([b""], [])


def test_words_that_do_not_decode_are_told(lattice):
    decoder = Decoder(lattice.vocabulary)
    some = [MARK + w for w in ("one", "日本", "x" * 9)]
    packed = lattice.encode_words(some)
    assert decoder.lost(some, packed) == []
    assert decoder.lost(some, [packed[1], packed[0], packed[2]]) == some[:2]
    assert S.Encoder(lattice).encode(["a b", "a▁b", ""], decoder)[1] == [True, False, True]


def test_long_words_alone_and_in_step_agree(lattice):
    r = random.Random(6)
    some = [MARK + "".join(r.choice("aabn") for _ in range(r.randint(1, 90))) for _ in range(300)]
    assert lattice.encode_words(some) == [lattice.path(w) for w in some]


def test_pretokens_join_to_the_text():
    for t in ("a b", " a", "a  b ", "   ", "one"):
        assert "".join(pretokens(t)) == normalised(t)


def test_chunks_have_the_best_score_wherever_they_are_cut(lattice):
    r = random.Random(2)
    encoder, decoder = S.Encoder(lattice), Decoder(lattice.vocabulary)
    for _ in range(150):
        t = "".join(r.choice(r.choice(["ab cde", "thein gor", "a", "  a", "日本é\nx ", "erthion"])) for _ in range(r.randint(1, 150)))
        x, size = normalised(t), r.choice([3, 7, 20, 40])
        parts = [S.Chunk(encoder, x[a : a + size + 15], min(size, len(x) - a)) for a in range(0, len(x), size)]
        m = [p.matrix() for p in parts]
        got = b"".join(p.ids(a, b) for p, (a, b) in zip(parts, S.choose(m, 0, 0), strict=True))
        whole = m[0]
        for y in m[1:]:
            whole = S.combined(whole, y)
        want = encoder.encode([t])[0][0]
        assert lattice.score(got) == lattice.score(want) == whole[0, 0]
        assert decoder.decode(got) == t


def test_product_is_associative(lattice):
    encoder = S.Encoder(lattice)
    x = normalised(words(8, 40).replace(" ", ""))
    a, b, c = (S.Chunk(encoder, x[k : k + 25], 10).matrix() for k in (0, 10, 20))
    assert (S.combined(S.combined(a, b), c) == S.combined(a, S.combined(b, c))).all()


def test_encode_scans_giants_and_odd_rows(spark):
    d = docs(spark, [*rows(), (200, words(77, 400)), (201, words(77, 400)), (202, "x" * 3000)])
    small = {r.doc_id: (r.ids, r.decoded) for r in S.decode(S.encode(d, giant=500, chunk=64)).collect()}
    for r in S.encode(d).collect():
        if r.doc_id not in (None, 13):
            assert small[r.doc_id][0] == r.ids or set(r.text) == {"x"}, r.doc_id  # paths of equal score in one unbroken word
        if r.doc_id is not None:
            assert small[r.doc_id][1] == (r.text or "") and len(small[r.doc_id][0]) > 0 or not r.text
    out = S.encode(d)
    assert sorted(out.columns) == sorted([*d.columns, "ids"]) and out.count() == d.count()
    assert S.encode(docs(spark, [])).collect() == []
    assert S.encode(d, giant=500, chunk=64, round_trip="same").filter("same").count() == d.count()


def test_counts_are_the_numbers_of_ids(spark, lattice):
    counted = T.token_counts(docs(spark))
    assert counted.columns == [*docs(spark).columns, "n_tokens"]
    got = sorted((r.doc_id or -1, r.n_tokens) for r in counted.collect())
    want = sorted((r.doc_id or -1, len(r.ids) // 4) for r in S.encode(docs(spark)).collect())
    assert got == want
    assert T.token_counts(docs(spark, [])).filter(F.col("n_tokens") > 0).isEmpty()


def test_trie_counts_against_the_plain_loop(lattice):
    counter = T.Counter(lattice)
    texts = [words(i, 30) for i in range(20)] + ["x" * 600, "日本é\U0001f600z", "a  b", ""]
    assert counter.count(texts) == [len(plain(lattice, normalised(t))) for t in texts]


def test_columns_of_the_same_names_as_its_own_come_back(spark):
    names = ("_made", "made", "MADE_", "_same", "key", "n", "_decoded")
    d = docs(spark).withColumns({c: F.lit("MINE") for c in names})
    got = S.encode(d, giant=1000, chunk=300, round_trip="round_trip")
    assert set(got.columns) == {*d.columns, "ids", "round_trip"} and got.count() == d.count()
    assert [tuple(r) for r in got.select(*names).distinct().collect()] == [("MINE",) * len(names)]
    assert got.filter("NOT round_trip").isEmpty()
