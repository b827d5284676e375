import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from oppengine.llm.sentencepieces import decode, encode, op6_sentencepieces, round_trip, transducer

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "Hello  world \n x\t", "▁a", "日本語𝄞", "ﬁ  Ǻ", "    " * 9 + "x", "aaaaaaaaaaaaaaaaaaaaaa", "\n\n\n", "a\r\nb", "e\u0301 👩‍👩‍👧", "Thlyouble | inesea | ononedth", "   \n   a", "1234567890.12"]


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.mark.parametrize("text", TEXTS)
def test_equals_the_library(sp, text):
    assert transducer(PATH).encode(text).tolist() == sp.encode(text)


def test_random_texts(sp):
    rng, t = random.Random(5), transducer(PATH)
    for _ in range(400):
        text = "".join(rng.choice("  \n\tabcdeéß▁ñ日.!?'\"123ABthin") for _ in range(rng.randint(0, 60)))
        ids = t.encode(text)
        assert ids.tolist() == sp.encode(text)
        assert t.decode(ids) == text.replace("▁", " ")


def test_the_path_is_the_cheapest_compatible_one():
    t = transducer(PATH)
    ids, weight = t.shortest("▁hello")
    assert weight == sum(w for p, (i, w) in t.arcs.items() if i in ids)


def test_the_acceptor_is_the_merge_encoding_of_pairs():
    rng, t = random.Random(6), transducer(PATH)
    pieces = list(t.arcs)
    for k in range(4000):
        x, y = rng.choice(pieces), rng.choice(pieces)
        if k % 2 and len(x) > 1:
            at = rng.randrange(1, len(x))
            x, y = x[:at], x[at:]
        if x in t.arcs and y in t.arcs and t.halves(x) is not None:
            assert (t.halves(y) is not None and t.separate(x, y)) == (t.merged(x + y) == [x, y])


def test_long_parts_without_blanks(sp):
    """A megabyte without blanks takes time in proportion to it, and is not remembered."""
    rng, t = random.Random(7), transducer(PATH)
    text = "".join(rng.choice("abcdeinrst") for _ in range(1_000_000))
    assert t.encode(text).tolist() == sp.encode(text)
    assert max(map(len, t.known)) <= 64
    assert t.decode(t.encode(text)) == text


def test_small_memory_gives_the_same(sp, monkeypatch):
    from oppengine.llm import sentencepieces

    monkeypatch.setattr(sentencepieces, "CACHE_ENTRIES", 3)
    t = sentencepieces.Transducer(PATH)
    for text in ("one two three four five six one two", "seven one², x.²y", "two three") * 3:
        assert t.encode(text).tolist() == sp.encode(text)


def test_least_path_of_a_unigram_model(tmp_path):
    """Against every segmentation of short texts; ties aside, weights are compared."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.trainer_spec.model_type, proto.normalizer_spec.remove_extra_whitespaces = 1, False
    for piece, score, kind in [("<unk>", 0, 2), ("▁", -3, 1), ("a", -2, 1), ("b", -2.5, 1), ("ab", -3.5, 1), ("ba", -4, 1), ("▁a", -3.2, 1), ("aba", -5.1, 1)]:
        proto.pieces.add(piece=piece, score=score, type=kind)
    (tmp_path / "m.model").write_bytes(proto.SerializeToString())
    t = transducer(str(tmp_path / "m.model"))

    def least(text):
        if not text:
            return 0.0
        return min((w + least(text[len(p) :]) for p, (_, w) in t.arcs.items() if text.startswith(p)), default=float("inf"))

    for text in ("▁abab", "▁", "abba", "▁a▁ba", "bbbb", "▁abaaba"):
        ids, weight = t.shortest(text)
        assert abs(weight - least(text)) < 1e-9
        assert "".join(proto.pieces[i].piece for i in ids) == text
    assert t.shortest("z")[0] == [0]


def test_tables(spark):
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(TEXTS)] + [(100, None, ""), (None, "a b", ""), (None, "a b", ""), (101, "word " * 30_000, "")], "doc_id long, text string, ids string")
    enc = encode(df, PATH)
    back = {r.doc_id: r.text for r in decode(enc, PATH).collect()}
    assert back[100] is None and back[None] == "a b" and back[101] == "word " * 30_000
    assert all(back[i] == x.replace("▁", " ") for i, x in enumerate(TEXTS))
    got = {r.doc_id: r for r in round_trip(df, PATH).collect()}
    assert got[100].n_pieces is None and got[0].n_pieces == 0 and got[3].same_text is False and got[2].n_fallback == 2
    assert encode(df.limit(0), PATH).count() == 0


def test_query(spark, sf_dir, sp):
    import zlib

    truth = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in op6_sentencepieces(spark, sf_dir).collect():
        ids = sp.encode(truth[r.doc_id])
        assert r.same_text and (r.n_pieces, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
