"""Every stage on its own input, held against brute force; then the whole run."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tempolyra.llm.quality import fit_quality, statistics
from tempolyra.llm.queries import ORACLES
from tests.llm.test_decontaminate import brute as overlaps
from tests.llm.test_near_copies import brute as near
from tests.oracle import connect

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count() and after.keys() <= before.keys()
        if name != "bpe_encoding":
            assert docs.columns == columns
        out[name] = before, after

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = out["quality_classifier"]
    good = [i for i in before if labels.get(i) == 1]
    bad = [i for i in before if labels.get(i) == 0]
    assert sum(i in after for i in good) >= 0.9 * len(good) and sum(i in after for i in bad) <= 0.3 * len(bad)  # about 60 rows to learn from here

    # every score worked out from the model, text by text
    model = fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    for i, r in before.items():
        assert (i in after) == (model.score(np.array([statistics((r.text or "").encode())]))[0] >= 0.5)

    before, after = out["line_dedup"]
    con = connect(SF)
    con.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/quality_classifier/*.parquet'")
    want = {i: (t, n) for i, n, t in con.sql(f"SELECT doc_id, n_dropped, text FROM ({ORACLES['op7_line_dedup']})").fetchall()}
    assert before.keys() == after.keys() == want.keys()
    for i, r in after.items():
        assert r.text == want[i][0] and r.n_chars == (len(r.text) if want[i][1] else before[i].n_chars)

    before, after = out["simhash_near_dedup"]
    want = {c for _, c in near([(i, r.text) for i, r in before.items()])}  # five words, a Jaccard of 0.8, all pairs
    assert after.keys() == want and all(after[i] == before[i] for i in want)

    before, after = out["benchmark_decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, _, _ in overlaps([(i, r.text) for i, r in before.items() if r.n_chars < 6000], items[:10])}
    assert not bad & after.keys()
    assert {i for i in before if i not in after} >= bad

    before, after = out["bpe_encoding"]
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert r.ids == lib.encode(before[i].text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_run_equals_stages_by_hand(spark):
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert got == {r.doc_id: r.ids for r in docs.collect()} and len(got) > 50


def test_stages_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, an empty table, and columns that clash."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    long = " ".join(f"w{k}" for k in range(40_000))
    rows = [(1, None), (2, ""), (3, "plain words of a short text"), (3, "plain words of a short text"), (None, "no id but words here"), (None, None), (4, long), (5, long + " end"), (6, item)]
    names = ["lang", "source", "row", "doc", "gone", "__row", "__bits", "__maybe", "__dropped", "__bucket"]
    df = spark.createDataFrame([(i, t, None if t is None else len(t), *[f"{c}{k}" for c in names]) for k, (i, t) in enumerate(rows)], ", ".join(["doc_id long", "text string", "n_chars long", *[f"{c} string" for c in names]]))
    stages = dict(corpus_pipeline.STAGES)
    plain = lambda frame: sorted((tuple(r) for r in frame.collect()), key=repr)
    for name in ("quality_classifier", "simhash_near_dedup", "benchmark_decontamination"):
        got = stages[name](spark, df, SF)
        assert got.columns == df.columns and set(plain(got)) <= set(plain(df)), name
        assert stages[name](spark, df.limit(0), SF).count() == 0
    kept = {r.doc_id: r.row for r in stages["simhash_near_dedup"](spark, df, SF).collect()}
    assert kept.keys() == {1, 3, None, 4, 6}  # 5 is a near copy of 4; nulls and the empty text are one group
    assert {r.doc_id for r in stages["benchmark_decontamination"](spark, df, SF).collect()} == {1, 2, 3, None, 4, 5}
    assert plain(stages["line_dedup"](spark, df, SF)) == plain(df)
    ids = stages["bpe_encoding"](spark, df, SF).collect()
    assert len(ids) == len(rows) and all((not r.ids) == (r.n_tokens == 0) for r in ids)
