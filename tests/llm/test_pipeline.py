import hashlib

import brute
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as p
from tablekit.llm import secrets
from tablekit.llm.queries import table
from tablekit.plans.store import keep

DATA = "/root/testdata/sf0.01"


def plain(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark):
    """What every stage got and returned."""
    docs, out = table(spark, DATA, "documents"), []
    for _, stage in p.STAGES:
        docs = keep(stage(spark, docs, DATA))
        out.append(docs)
    return out


def test_quality_keeps_good_documents(spark, stages):
    before, kept = table(spark, DATA, "documents"), stages[0]
    assert kept.dtypes == before.dtypes
    assert kept.exceptAll(before).count() == 0
    labels = {r.doc_id: r.quality for r in table(spark, DATA, "labels").collect()}
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    good, bad = [i for i, y in labels.items() if y], [i for i, y in labels.items() if not y]
    assert sum(i in ids for i in good) > 0.98 * len(good) and sum(i in ids for i in bad) < 0.1 * len(bad)


def test_one_document_of_each_group_stays(stages):
    before, kept = plain(stages[0]), plain(stages[1])
    want = brute.similar([(r["doc_id"], r["text"]) for r in before], 5, 0.8)
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i, (_, c) in want.items() if i == c) and len(kept) < len(before)
    texts = {r["doc_id"]: r for r in before}
    assert all(texts[r["doc_id"]] == r for r in kept)


def test_no_benchmark_words_are_left(spark, stages):
    items = [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()]
    before, kept = {r["doc_id"]: r for r in plain(stages[1])}, {r["doc_id"]: r for r in plain(stages[2])}
    judged = {r[0]: r for r in brute.contamination([(i, r["text"]) for i, r in before.items()], items)}
    assert not any(r[5] for r in brute.contamination([(i, r["text"]) for i, r in kept.items()], items))
    assert all(kept[i] == before[i] for i, r in judged.items() if not r[5])
    assert set(before) - set(kept) == {i for i, r in judged.items() if r[2] > p.LEAKED_SHARE * r[1]}
    for i, r in judged.items():
        if r[5] and i in kept:
            assert len(brute.ALNUM.findall(brute.fold(kept[i]["text"]))) == r[1] - r[2] and kept[i]["n_chars"] == len(kept[i]["text"])


def test_secrets_are_masked(stages):
    before, kept = {r["doc_id"]: r for r in plain(stages[2])}, {r["doc_id"]: r for r in plain(stages[3])}
    assert before.keys() == kept.keys()
    strict = stages[2]
    found = secrets.findings(strict, path="source").where(secrets.strict_label() == 1).select("id", "secret").collect()
    assert found and not any(r.secret in kept[r.id]["text"] for r in found)
    marked = {r.id for r in found}
    other = [i for i in before if i not in marked]
    assert sum(before[i]["text"] == kept[i]["text"] for i in other) > 0.99 * len(other)
    assert all(r["n_chars"] == len(r["text"]) for r in kept.values() if "[SECRET]" in r["text"])


def test_token_ids(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in plain(stages[3])}
    rows = plain(stages[4])
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_eos=True)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_run_is_the_stages(spark, stages):
    assert p.run(spark, DATA).exceptAll(stages[-1]).count() == 0


def test_odd_documents(spark, tmp_path):
    """Null, empty, repeated and nameless rows through every stage."""
    long = " ".join(f"w{k}" for k in range(100))
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, long + " end"), (None, long), (None, None), (5, "token = \"" + "0a" * 20 + "\""), (6, "x " * 40_000), (6, "another text")]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    deduped = p.without_near_duplicates(spark, docs, DATA)
    assert deduped.dtypes == docs.dtypes
    assert sorted((str(r.doc_id), len(r.text or "")) for r in deduped.collect()) == sorted(
        (str(i), len(t or "")) for i, t in [(1, None), (2, ""), (3, long), (None, None), rows[7], rows[8], rows[9]]
    )
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
        assert stage(spark, docs, DATA).count() >= 7, name
