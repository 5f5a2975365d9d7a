import random

import numpy as np
import public_tokenizers
import sentencepiece

from weftline.llm.sentencepiece_codec import CharacterMap, PieceModel, digest, encode_decode

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_same_as_library_on_random_texts_and_ids():
    blob = open(MODEL, "rb").read()
    ours, theirs = PieceModel(blob), sentencepiece.SentencePieceProcessor(model_proto=blob)
    rng = random.Random(1)
    letters = [*"ab é ▁\n\t<s>0x0A  中\U0001f600ñ\x00�", "the", " of", "<unk>", "▁▁"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(1500)]
    sizes, ids, starts, ends = ours.encode([t.encode() for t in texts])
    at = 0
    for t, n in zip(texts, sizes, strict=True):
        part = slice(at, at := at + n)
        assert ids[part].tolist() == theirs.encode(t)
        assert ours.decode(ids[part]).decode() == theirs.decode(ids[part].tolist())
        s, e = starts[part], ends[part]
        assert (s <= e).all() and (s[1:] >= s[:-1]).all() and (not t or e[-1] == len(t.encode()))
    for _ in range(1500):
        some = np.array([rng.randrange(400) if rng.random() < 0.7 else rng.randrange(32000) for _ in range(rng.randrange(12))], np.int32)
        assert ours.decode(some).decode() == theirs.decode(some.tolist())


def test_spans_give_the_source():
    _, ids, starts, ends = PieceModel(open(MODEL, "rb").read()).encode(["Hé, two  words".encode()])
    text = "Hé, two  words".encode()
    assert b"".join(text[s:e] for s, e in zip(starts, ends, strict=True)) == text


def test_compiled_map_normalises_as_the_library_does():
    n = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(n.serialized_model_proto())
    model = PieceModel.__new__(PieceModel)
    model.characters = CharacterMap(proto.normalizer_spec.precompiled_charsmap)
    model.dummy_prefix = model.squeeze = model.escape = False
    for t in ["ＡＢＣ　ﬁne ㍿ ½ é", "plain", "ｶﾞ　x", "", "Á"]:
        shown, where = model.normalise(t.encode())
        flat = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False)
        assert shown.decode() == flat.normalize(t)
        assert len(where) == len(shown) + 1 and list(where) == sorted(where)


def test_odd_rows(odd_docs, no_docs):
    theirs = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = encode_decode(odd_docs, MODEL).collect()
    assert len(got) == odd_docs.count()
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    for r in got:
        assert r["ids"] == theirs.encode(texts[r["doc_id"]])
        assert r["decoded"] == theirs.decode(r["ids"])
    assert digest(encode_decode(no_docs, MODEL)).count() == 0


def test_table_of_words_is_bounded(monkeypatch):
    import weftline.llm.sentencepiece_codec as C

    monkeypatch.setattr(C, "WORDS_BYTES", 5000)
    blob = open(MODEL, "rb").read()
    ours, theirs = PieceModel(blob), sentencepiece.SentencePieceProcessor(model_proto=blob)
    for k in range(30):
        texts = [f"word{k} and other{k} words", f"{k}" * 3000, "and words"]
        _, ids, _, _ = ours.encode([t.encode() for t in texts])
        assert ids.tolist() == [i for t in texts for i in theirs.encode(t)]
        assert ours.held <= 5000 and not any(len(w) > C.LONG for w in ours.words)
