"""The pipeline against its stages done by hand, and the registration of all of it."""

from collections import defaultdict

import corpus_pipeline
from sylvan.llm import entries, minhash, pii, toxicity

import __spark_entry__

from .conftest import rows_of


def test_run_is_the_stages_by_hand(spark, documents, labels, tmp_path):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    model = pii.trained(spark)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    terms = toxicity.Matcher(toxicity.lexicon_of(documents, labels))
    rows = [r for r in rows if not (lambda s: s[0] >= toxicity.THRESHOLD and s[1] >= toxicity.MIN_WEIGHT)(toxicity.score(r[1], terms))]
    drop = {2, 3, 10}
    rows = [r for r in dict.fromkeys(rows) if r[0] not in drop]
    want = defaultdict(str)
    for i, text in rows:
        want[i] += pii.redact(text, pii.find(model, [text])[0]) or "" if text else ""
    pieces = defaultdict(list)
    for b in got:
        at = 0
        for i, s, n in zip(b.doc_ids, b.starts, b.lengths, strict=True):
            pieces[i].append((s, b.text[at : at + n]))
            at += n + 2
    assert {i: "".join(x for _, x in sorted(p)) for i, p in pieces.items()} == {i: x for i, x in want.items() if x}


def test_stages_keep_the_columns(spark, documents, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == documents.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "packing"]
    assert minhash.RADIUS < minhash.K


def test_empty_tables_and_clashing_columns(spark, documents, labels, empty, odd, tmp_path):
    for name, docs, marks in (("none", empty, labels.limit(0)), ("plain", documents, labels), ("odd", odd, labels.selectExpr("*", "'x' as text", "'y' as lang"))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        marks.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    pieces = lambda name: rows_of(corpus_pipeline.run(spark, f"{tmp_path}/{name}").selectExpr("explode(arrays_zip(doc_ids, starts, lengths))"))
    assert pieces("odd") == pieces("plain")


def test_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in entries.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(entries.QUERIES) | {"pipeline"} <= set(names) and set(entries.ORACLE) <= set(entries.QUERIES)
