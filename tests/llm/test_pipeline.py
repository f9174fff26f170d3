"""The stages on a small table against plain Python, and the registered queries without SQL."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from __spark_entry__ import queries
from sparselin.llm import toxicity
from sparselin.llm.tokens import Encoder, tokenizer_path
from test_search import plain_classes, plain_edits
from test_texts import plain_lines, sha
from test_tokens import check_places

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    """What each stage returns, each read back from files."""
    out = {"": spark.read.parquet(f"{SF}/documents.parquet")}
    docs = out[""]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(results):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert results[name].columns == results[""].columns


def test_toxic_documents_go(spark, results):
    docs = results[""]
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.score(docs, model).where("score >= 0.5").collect()}
    assert set(rows_of(results["toxicity"])) == set(rows_of(docs)) - toxic


def test_few_labels_are_enough_to_remove_toxic_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = set(rows_of(corpus_pipeline.drop_toxic(spark, docs, SF)))
    known = docs.join(labels, "doc_id").select("doc_id", "toxic").collect()
    gone = [r["doc_id"] not in kept for r in known if r["toxic"] == 1]
    stay = [r["doc_id"] in kept for r in known if r["toxic"] == 0]
    assert np.mean(gone) >= 0.8 and np.mean(stay) >= 0.95


def test_lines_go(results):
    before, after = rows_of(results["toxicity"]), rows_of(results["line_dedup"])
    want = {i: digest for i, _, _, digest in plain_lines([(i, r["text"]) for i, r in before.items()])}
    assert {i: sha(r["text"]) for i, r in after.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for i, r in after.items() if r["text"] != before[i]["text"])


def test_one_of_each_class_stays(results):
    before = [(i, r["text"]) for i, r in rows_of(results["line_dedup"]).items()]
    classes = plain_classes(before, 5, 80)
    assert set(rows_of(results["near_dedup"])) == {i for i, _ in before if classes.get(i, i) == i}


def test_contaminated_documents_go(results):
    bare = lambda t: "".join(c if c.isalnum() or not c.isascii() else " " for c in t.lower()).split()
    items = [bare(t) for t in pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist()]
    before, after = rows_of(results["near_dedup"]), rows_of(results["decontamination"])
    for i, r in before.items():
        words = bare(r["text"])
        # Only a text with many of an item's words can hold it.
        near = [x for x in items if sum(w in set(words) for w in x) >= 0.8 * len(x)]
        holds = any(plain_edits(x, words) <= int(0.2 * len(x)) for x in near)
        assert (i not in after) == holds


def test_pieces_are_packed(results):
    before, rows = rows_of(results["decontamination"]), results["packing"].collect()
    encoder = Encoder(tokenizer_path("byte_bpe_50k.json"))
    used = check_places(rows, 1024)
    total = sum(r["length"] for r in rows)
    assert used <= 1.02 * total / 1024 + 1
    by = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(before)
    for i, pieces in by.items():
        ids = np.array([*encoder.whole(before[i]["text"] or ""), 2], "<u4")
        assert sum(r["length"] for r in pieces) == len(ids)
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())


def test_run_is_the_stages(spark, results):
    got = queries()["pipeline"](spark, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, results["packing"].select(key).collect()))


def test_toxicity_query_on_held_out_labels(spark):
    rows = queries()["op4_toxicity"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = rows.where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    assert len(got) > 50 and np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.93


def test_decontamination_query(spark):
    found = {(r["doc_id"], r["item_id"]) for r in queries()["op2_decontamination"](spark, SF).collect()}
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    exact = {(d["doc_id"], i["item_id"]) for d in docs for i in items if i["text"] in (d["text"] or "")}
    assert exact <= found


def test_token_queries(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    encoder, start = Encoder(tokenizer_path("word_bpe_49k.json")), 0
    got = rows_of(queries()["op1_token_files"](spark, SF))
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        ids = np.array([*encoder.whole(d["text"] or ""), 1], "<u4")
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    pieces = queries()["op5_best_fit_packing"](spark, SF).collect()
    assert {r["doc_id"] for r in pieces} == {d["doc_id"] for d in docs} and check_places(pieces, 1024)
