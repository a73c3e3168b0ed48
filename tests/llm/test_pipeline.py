"""The pipeline against brute force, and the corpus queries against their SQL."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from episodica.llm.bitplanes import word_tokenizer
from episodica.plans.small import keep
from tests.llm.test_documents import brute_groups, brute_hits
from tools_check import compare


@pytest.mark.parametrize("name", ["op1_wu_manber", "op2_url_reputation", "op3_jaccard_orders", "op8_line_windows"])
def test_query_equals_sql(llm, sf, name):
    ok, msg, _ = compare(llm, name, queries()[name], oracle_sql()[name], sf)
    assert ok, msg


def test_pipeline_stages(llm, sf):
    from tokenizers import Tokenizer

    docs = llm.read.parquet(f"{sf}/documents.parquet")
    item = [(r["item_id"], r["text"]) for r in llm.read.parquet(f"{sf}/benchmark.parquet").collect()]
    step, out = dict(corpus_pipeline.STAGES), {}
    for name, f in corpus_pipeline.STAGES:
        docs = out[name] = keep(f(llm, docs, sf))
    assert all(out[n].columns == ["doc_id", "text", "lang", "source", "n_chars"] for n in list(step)[:-1])
    rows = {n: [(r["doc_id"], r["text"]) for r in out[n].collect()] for n in list(step)[:-1]}

    # one document of each linked group stays
    good = rows["quality rules"]
    _, label = brute_groups(good, 5, 80)
    first = {}
    for (i, t), g in zip(good, label):
        first[g] = min(first.get(g, (i, t)), (i, t))
    assert sorted(rows["n-gram Jaccard join"]) == sorted(first.values())
    # contaminated documents go, all others stay
    clean = [r for r in rows["n-gram Jaccard join"] if not brute_hits(r[1], item)[1]]
    assert sorted(rows["benchmark decontamination"]) == sorted(clean) and len(clean) < len(first)
    # the mix repeats documents of the stage before
    assert set(rows["mixing sources"]) <= set(clean)
    # ids are those of the texts, in ascending order
    tok, start = Tokenizer.from_file(word_tokenizer()), 0
    got = sorted(out["token ids"].collect(), key=lambda r: r["start"])
    assert len(got) == len(rows["mixing sources"])
    for (i, t), g in zip(sorted(rows["mixing sources"]), got):
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [1], dtype="<u4")
        assert tuple(g) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_run_is_the_stages(llm, sf):
    assert corpus_pipeline.run(llm, sf).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_functions_of_columns_and_of_batches_share_their_workers(llm):
    """A difference between their variables would start a second daemon and as many workers again, which all stay."""
    import os

    import pyarrow as pa
    from pyspark.sql import functions as F

    def parent(x: pa.Array) -> pa.Array:
        return pa.array([os.getppid()] * len(x), pa.int64())

    def batches(found):
        for b in found:
            yield pa.RecordBatch.from_arrays([parent(b.column(0))], names=["id"])

    rows = llm.range(64)
    of_columns = {r[0] for r in rows.select(F.arrow_udf(parent, "long")("id")).collect()}
    of_batches = {r[0] for r in rows.mapInArrow(batches, "id long").collect()}
    assert len(of_columns) == 1 and of_columns == of_batches
    env, setting = llm.sparkContext.environment, "spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled"
    assert (env.get("SPARK_SIMPLIFIED_TRACEBACK") == "1") == (llm.conf.get(setting) == "true")
