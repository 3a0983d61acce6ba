"""The pipeline against plain Python, stage by stage."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_llm_operators import CLASHING, COLUMNS, EDGE, _fingerprint, _least

import corpus_pipeline
from trailmark.llm import bpe, exact_dedup, langid, mixing
from trailmark.llm.common import written


def test_run_equals_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs)
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    rows = [r for r in rows if (p := model.predict(r.text))[0] != "und" and not p[2]]
    first = {}
    for r in rows:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r)
    rows = list(first.values())
    fps = {r.doc_id: _fingerprint(r.text) for r in rows}
    by = defaultdict(list)
    for d, f in fps.items():
        by[f].append(d)
    distinct = list(by)
    links = [(by[a][0], by[b][0]) for k, a in enumerate(distinct) for b in distinct[:k] if (a ^ b).bit_count() <= 3] + [(g[0], x) for g in by.values() for x in g[1:]]
    component = _least(list(fps), links)
    rows = [r for r in rows if component[r.doc_id] == r.doc_id]
    kept = spark.createDataFrame(rows, docs.schema)
    counts = Counter()
    for r in mixing.mix(kept).collect():
        counts[r.doc_id] += 1
    texts = {r.doc_id: r.text for r in rows}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in got) == counts
    assert all(r.round_trip and list(r.input_ids) == bpe.encode_text(texts[r.doc_id]) and r.n_tokens == len(r.input_ids) for r in got)


def test_stages_keep_columns_and_survive_edge_cases(spark, sf_dir, tmp_path):
    spark.createDataFrame(EDGE, COLUMNS).write.parquet(str(tmp_path / "d"))
    plain = spark.read.parquet(str(tmp_path / "d"))
    own = set(mixing.mix(plain).columns) - set(plain.columns)
    clashing = plain.withColumns({c: F.lit("clash") for c in CLASHING if c not in own})
    for docs in (plain, plain.limit(0), clashing, clashing.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns, name
            docs = written(out, "stage")
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).where("NOT round_trip").count() == 0


@pytest.mark.parametrize("stage", [0, 1, 2])
def test_clean_documents_stay(spark, sf_dir, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.STAGES[stage][1](spark, docs, sf_dir)
    copies = exact_dedup.label_duplicates(docs).where("NOT kept").count()
    lost = docs.count() - out.count()
    assert lost == {0: 0, 1: copies}.get(stage, lost) and lost <= docs.count() // 5
