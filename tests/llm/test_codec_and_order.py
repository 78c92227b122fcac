"""A unigram model against the library, bounded memos, and fingerprints of rows without an id."""

import hashlib
import random

import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from reelbase.llm import fingerprints
from reelbase.llm.queries import tokenizer
from reelbase.llm.sentencepiece_codec import Codec, load


def unigram_model(path):
    m = proto.ModelProto()
    m.trainer_spec.model_type = 1
    m.trainer_spec.byte_fallback = True
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.add_dummy_prefix = True
    m.normalizer_spec.remove_extra_whitespaces = False
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        m.pieces.add(piece=piece, score=0, type=kind)
    for b in range(256):
        m.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    rng = random.Random(1)
    pieces = {"▁", "a", "b", "c"} | {"".join(rng.choice("▁abc" if not k else "abc") for k in range(rng.randint(2, 5))) for _ in range(60)}
    for p in sorted(pieces):
        m.pieces.add(piece=p, score=-rng.uniform(1, 9), type=1)  # drawn, so that no two paths have one score: the library adds in single precision
    path.write_bytes(m.SerializeToString())
    return str(path)


def test_unigram_model_equals_the_library(tmp_path):
    path = unigram_model(tmp_path / "u.model")
    lib, codec = sentencepiece.SentencePieceProcessor(model_file=path), Codec(load(path))
    rng = random.Random(2)
    texts = ["".join(rng.choice("aabbcc  dé") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    assert [x.tolist() for x in codec.encode(texts)] == lib.encode(texts)


def test_small_memos_and_stretches_change_nothing():
    path = tokenizer("piece_bpe_32k.model")
    lib, codec = sentencepiece.SentencePieceProcessor(model_file=path), Codec(load(path), memo_bytes=4000, memo_pairs=50, stretch=11)
    rng = random.Random(3)
    texts = [" ".join(f"word{rng.randrange(50)}" for _ in range(30)) + " ▁ x  é" for _ in range(60)] + ["long " * 5000, ""]
    assert [x.tolist() for x in codec.encode(texts)] == lib.encode(texts)
    assert codec.used < 40_000


def test_rows_without_an_id_follow_the_others(spark):
    rows = [(5, "five five five"), (None, "none at all"), (2, "two words"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.edited_fingerprints(docs).collect()}
    order = [(9, ""), (5, "five five five"), (2, "two words"), (None, "none at all")]
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % 4][1]
        half = len(t) // 2
        assert got[i] == hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()
