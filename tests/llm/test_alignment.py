import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tablekit.llm import alignment, byte_pairs
from tablekit.llm.queries import QUERIES, _vocabulary, piece_model

DATA = "/root/testdata/sf0.001"
LETTERS = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
LETTERS |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in LETTERS)}


@pytest.fixture(scope="module")
def libraries():
    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute(rows, libraries):
    """Another way: sets of ends per text, and the libraries' own answers."""
    one, two = libraries
    tokens, links = [], []
    for key, text in rows:
        a = one.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        bytes_a = [bytes(LETTERS[c] for c in one.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if {b"".join(bytes_a), b"".join(bytes_b)} != {b" " + (text or "").encode()}:
            a = b = []
        ends_a = dict(zip(np.cumsum([len(x) for x in bytes_a]).tolist(), range(len(a))))
        ends_b = dict(zip(np.cumsum([len(x) for x in bytes_b]).tolist(), range(len(b))))
        common = sorted(ends_a.keys() & ends_b.keys()) if a else []
        tokens.append((key, a, b, [(ends_a[e], ends_b[e]) for e in common]))
        links.append([(a[ends_a[e]], b[ends_b[e]]) for e in common])
    counts = Counter(x for found in links for x in found)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (key, a, b, cuts), found in zip(tokens, links):
        parts, i, j = [], 0, 0
        for x, y in cuts:
            parts.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
            i, j = x + 1, y + 1
        digest = hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else ""
        n_best = sum(counts[x] == best[x[1]] for x in found)
        out.append((key, len(a), len(b), len(cuts), len(found), n_best, sum(counts[x] for x in found), digest))
    return sorted(out, key=str)


def answers(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_whole_table(spark, libraries):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()]
    assert answers(QUERIES["op13_alignment"](spark, DATA)) == brute(rows, libraries)


TEXTS = [
    (1, None), (2, ""), (3, "a b"), (3, "a b"), (None, " \n  x\x00é漢😀"), (4, "a▁b"), (5, "long text of words " * 6000), (6, "x" * 30_000), (7, " "),
    (8, "<|endoftext|> </s> <s> <0x41> <unk>"), (9, "  leading, trailing  "), (10, "3" + " " * 40_000 + "x" + "\n" * 40_000), (11, "�"),
]


@pytest.mark.parametrize("frequent", [0, 40, 1 << 20])
def test_odd_texts_and_clashing_columns(spark, libraries, frequent):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in TEXTS], "doc_id long, text string, id int, pairs string, row int")
    got = alignment.align(docs, _vocabulary("byte_bpe_50k.json"), piece_model(), frequent=frequent)
    assert answers(got) == brute(TEXTS, libraries)


def test_empty_table(spark):
    got = alignment.align(spark.createDataFrame([], "doc_id long, text string"), _vocabulary("byte_bpe_50k.json"), piece_model())
    assert got.collect() == []


def test_walk_over_ends_equals_the_intersection():
    draw = random.Random(4)
    for _ in range(2000):
        last = draw.randint(1, 60)
        a, b = ({*draw.sample(range(1, last + 1), draw.randint(0, last)), last} for _ in range(2))
        if draw.random() < 0.3:
            b = (a ^ {draw.randint(1, last)}) | {last}
        a, b = np.array(sorted(a)), np.array(sorted(b))
        i, j = alignment.common_ends(a, b)
        assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    nothing = alignment.common_ends(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert [x.tolist() for x in nothing] == [[], []]


def test_stretches_are_jumped(monkeypatch):
    a = np.arange(1, 1_000_001) * 3
    i, j = alignment.common_ends(a, np.sort(np.append(a, 1_500_001)))
    assert len(i) == 1_000_000 and (np.diff(j - i) != 0).sum() == 1


def test_long_blank_runs(libraries):
    encoder, _ = byte_pairs.read_json(_vocabulary("byte_bpe_50k.json"))
    for text in (" " * 20_000, " " * 20_000 + "x", "a" + "\n" * 20_000 + "b", "a" + " " * 20_000 + "\n" + "12", "　" * 17_000 + " é  "):
        assert byte_pairs.ordinary(encoder, text) == libraries[0].encode(text, add_special_tokens=False).ids


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        byte_pairs.read_json(_vocabulary("word_bpe_49k.json"))
