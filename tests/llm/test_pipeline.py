import hashlib
import os
import struct
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from readlake.llm import bpe, langid
from readlake.llm.registry import QUERIES

from .data import table
from .test_langid import corpus
from .test_minhash import groups
from .test_secrets import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    texts, langs = corpus(160)
    texts += [texts[3] + " ba"] + [texts[4]] * 3 + [None, "", "1 2 3", "login=alice token=deadbeefdeadbeef " + texts[8]]
    path = str(tmp_path_factory.mktemp("sf"))
    docs = table(spark, texts, langs=langs + [None] * (len(texts) - 160))
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_against_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kinds = docs.dtypes
    stages = dict(P.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}
    model = langid.fit(langid.training_sample(docs))
    found = dict(zip(rows, langid.predict(model, [(r.text or "").encode() for r in rows.values()])))
    one = stages["language"](spark, docs, folder).cache()
    assert one.dtypes == kinds and {r.doc_id for r in one.collect()} == {i for i, (lang, score) in found.items() if lang != "und" and score >= P.LEAST_SCORE}
    two = stages["near_dedup"](spark, one, folder).cache()
    ids = sorted(r.doc_id for r in one.collect())
    _, root = groups([rows[i].text for i in ids], 5)
    assert two.dtypes == kinds and sorted(r.doc_id for r in two.collect()) == [i for k, i in enumerate(ids) if root[k] == k]
    three = stages["secrets"](spark, two, folder).cache()
    assert three.dtypes == kinds
    for r in three.collect():
        assert not any(rows[r.doc_id].text[a:b] in r.text for a, _, b, _ in plain(rows[r.doc_id].text))
        assert r.text == rows[r.doc_id].text or "[secret]" in r.text
    four = stages["mixing"](spark, three, folder).cache()
    assert four.dtypes == kinds and max(Counter(r.doc_id for r in four.collect()).values()) <= 2
    library = Tokenizer.from_file(bpe.vocabulary_path())
    want = Counter()
    for r in four.collect():
        packed = library.encode(r.text, add_special_tokens=False).ids
        want[(r.doc_id, len(packed), hashlib.sha256(struct.pack(f"<{len(packed)}I", *packed)).hexdigest())] += 1
    five = stages["encoding"](spark, four, folder)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in five.collect()) == want


def test_run_is_the_stages_in_order(spark, folder):
    rows = P.run(spark, folder).collect()
    assert rows and [n for n, _ in P.STAGES] == ["language", "near_dedup", "secrets", "mixing", "encoding"]
    assert sorted(map(tuple, P.run(spark, folder).collect())) == sorted(map(tuple, rows))


def test_awkward_rows_and_columns_of_clashing_names(spark, tmp_path):
    """Null ids, null and empty texts, repeated rows, and columns that the operators use themselves."""
    texts, langs = corpus(40)
    texts += [texts[0], texts[1], None, "", "12 34", "token=deadbeefdeadbeef " + " ".join(reversed((texts[2] + " " + texts[5]).split())), "login=alice"]
    langs += [None] * 7
    ids = [None if i % 5 == 0 else i for i in range(39)] + [38, 0, 1] + [None, 60, 61, None, 63]
    docs = table(spark, texts, langs=langs, ids=ids)
    docs = docs.unionByName(docs.where("doc_id = 7"))
    assert {"size", "bucket", "copies", "base", "s"} < set(docs.columns)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, function in P.STAGES[:-1]:
        got = function(spark, got, str(tmp_path)).cache()
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all(r.base == "x" and r.copies == -1 for r in rows)
        if name == "language":
            assert all(r.text and r.text not in ("", "12 34") for r in rows)
        if name == "near_dedup":
            kept = [r.text for r in rows]
            assert len(kept) == len(set(kept)) and len([r for r in rows if r.doc_id is None]) > 5
        if name == "secrets":
            assert not any("deadbeef" in r.text for r in rows) and any("[secret]" in r.text for r in rows)
    out = P.encode(spark, got, str(tmp_path)).collect()
    assert len(out) == got.count() and any(r.doc_id is None for r in out)
    assert len(P.run(spark, str(tmp_path)).collect()) == len(out)


def test_stages_leave_nothing_behind(spark, folder):
    """After a run the shared folder holds the last stage's rows and nothing else of it."""
    from readlake import scratch

    before = {p for p, _, _ in os.walk(scratch.checkpoint_dir(spark).removeprefix("file://"))}
    rows = P.run(spark, folder)
    made = {p for p, _, files in os.walk(scratch.checkpoint_dir(spark).removeprefix("file://")) if any(f.endswith(".parquet") for f in files)} - before
    assert [os.path.basename(p) for p in made] == ["encoding"] and rows.count()


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no bench tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_have_a_row_for_each_input_row(spark, name):
    wanted = "embeddings" if name.startswith("op2_") else "documents"
    rows = QUERIES[name](spark, SF)
    if name.startswith("op11_"):  # twenty rows for each query
        assert rows.count() == 20 * spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").count()
    else:
        assert rows.count() == spark.read.parquet(f"{SF}/{wanted}.parquet").count()
