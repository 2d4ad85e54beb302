import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
import tiktoken

from tablekit.llm import packing, pieces
from tablekit.llm.queries import QUERIES, piece_model, rank_file

DATA = "/root/testdata/sf0.001"
TEXTS = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, " \n  x▁y\x00é漢😀"), (4, "long text of words " * 6000), (5, "x" * 30_000)]


def weird(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in TEXTS], "doc_id long, text string, id int, ids string")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_whole_table_equals_the_library(spark, library):
    got = {r.doc_id: r for r in QUERIES["op7_sentencepiece"](spark, DATA).collect()}
    for row in pq.read_table(f"{DATA}/documents.parquet").to_pylist():
        ids = library.encode(row["text"] or "", add_eos=True)
        r = got.pop(row["doc_id"])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert not got


def test_any_text_and_any_ids(library):
    own, draw = pieces.Pieces(piece_model()), random.Random(3)
    letters = list("ab  ▁\n\t\0é́漢😀<0x0A></s>theing,.1_")
    for _ in range(5000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 14)))
        ids = own.encode(text)
        assert ids.tolist() == library.encode(text, add_eos=True) and own.decode(ids) == library.decode(ids.tolist())
        ids = [draw.choice([3 + draw.randrange(256), draw.randrange(32000), draw.randrange(3)]) for _ in range(draw.randint(0, 6))]
        assert own.decode(np.array(ids, "<i4")) == library.decode(ids)
    own.check()


def test_check_finds_a_difference():
    own = pieces.Pieces(piece_model())
    own.encode("the word")
    own.new = [(p, found + found) for p, found in own.new]
    with pytest.raises(ValueError):
        own.check()


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    own = pieces.Pieces(piece_model())
    first = own.encode("one two three four five six one two")
    assert len(own) <= 3 and len(own.older) <= 3
    assert (own.encode("one two three four five six one two") == first).all()


def test_encoding_edge_cases(spark, library):
    rows = pieces.decode(pieces.encode(weird(spark), piece_model()), piece_model()).collect()
    want = sorted((str(i), library.encode(t or "", add_eos=True)) for i, t in TEXTS)
    assert sorted((str(r.doc_id), r.ids) for r in rows) == want
    assert sorted(r.text for r in rows) == sorted((t or "").replace("▁", " ") for _, t in TEXTS)
    assert pieces.encode(weird(spark).limit(0), piece_model()).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert pieces.decode(nothing, piece_model()).first().text == ""


def unpacked(rows):
    """Documents from packed rows."""
    parts = {}
    for r in rows:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= len(ids) and (ids[r.n_tokens :] == 50256).all()
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert (positions[a:b] == np.arange(b - a)).all()
            parts.setdefault(doc, []).append((start, ids[a:b]))
    return parts


def test_packing_loses_nothing(spark):
    encoder, end = packing._encoder(rank_file(), packing.PATTERN)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    parts = unpacked(QUERIES["op9_packing"](spark, DATA).collect())
    for r in docs.collect():
        held = sorted(parts.pop(r.doc_id), key=lambda x: x[0])
        assert [s for s, _ in held] == list(range(0, 2048 * len(held), 2048))
        assert np.concatenate([x for _, x in held]).tolist() == encoder.encode_ordinary(r.text or "") + [end]
    assert not parts


def test_packing_edge_cases(spark):
    parts = unpacked(packing.pack(weird(spark), rank_file(), row_tokens=64, group_tokens=500).collect())
    assert [x.tolist() for _, x in parts[1]] == [[50256]] and len(parts[3]) == 2 and len(parts[4]) > 300
    assert packing.pack(weird(spark).limit(0), rank_file()).count() == 0


def test_packing_long_blank_runs(spark):
    encoder, end = packing._encoder(rank_file(), packing.PATTERN)
    texts = {1: " " * 3_000_000, 2: "a" + " " * 3_000_000 + "b", 3: "\n" * 1_500_000 + "12  "}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for key, held in unpacked(packing.pack(docs, rank_file()).collect()).items():
        ids = np.concatenate([x for _, x in sorted(held, key=lambda x: x[0])]).tolist()
        assert ids[-1] == end and encoder.decode(ids[:-1]) == texts[key]


def test_many_agendas_equal_single_ones(library):
    own, draw = pieces.Pieces(piece_model()), random.Random(5)
    letters = list("ab  the\n\té漢😀▁ingstronation.,1")
    parts = sorted({"".join(draw.choice(letters) for _ in range(draw.randint(1, 20))) for _ in range(3000)} | {"a" * 64, "\0"})
    assert own.merge_many(parts) == [np.array(own.merge(p), "<i4").tobytes() for p in parts]
    assert own.merge_many([]) == []


def test_best_fit_equals_a_plain_search():
    draw = random.Random(11)
    for _ in range(300):
        capacity = draw.randint(1, 40)
        lengths = [draw.randint(1, capacity) for _ in range(draw.randint(0, 60))]
        rows, free = [], []
        for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
            fits = [f for f in free if f >= lengths[i]]
            if not fits:
                free.append(capacity)
                fits = [capacity]
            free[free.index(min(fits))] -= lengths[i]
        rows = packing.best_fit_decreasing(lengths, capacity)
        assert sorted(k for r in rows for k in r) == list(range(len(lengths)))
        assert sorted(capacity - sum(lengths[k] for k in r) for r in rows) == sorted(free)
