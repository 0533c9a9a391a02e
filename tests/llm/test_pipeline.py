"""The pipeline against a brute-force version of its stages on a small table."""

import corpus_pipeline
from test_operators import brute_pairs, brute_score, docs, words

from weftline.llm import decontam, jaccard, linerules, secrets, vocab

SECRET = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
LEAK = "the answer to the first question is that rivers flow down because of gravity and the slope of land"


def make(spark, tmp_path):
    base = "One plain sentence about nothing much at all that goes on for quite some while. Then comes another of them, with different words in it."
    rows = [(k, f"{base} Item number {k} says {' '.join(f'x{k}y{j}' for j in range(30))}.") for k in range(6)]
    rows += [(10, rows[0][1]), (11, rows[1][1] + " End."), (12, f"Here we go. {LEAK}. Done with it now."), (13, f'Config has token = "{SECRET}" in it. {" ".join(f"z{j}" for j in range(20))}.'), (14, "a | b | c | d"), (15, None), (16, "")]
    d = tmp_path / "sf"
    docs(spark, rows).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(0, LEAK)], "item_id bigint, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d), rows


def test_stages(spark, tmp_path):
    d, rows = make(spark, tmp_path)
    assert len(corpus_pipeline.STAGES) == 5
    now = spark.read.parquet(f"{d}/documents.parquet")
    columns = now.columns
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, d).write.parquet(str(tmp_path / f"s{k}"))
        now = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen.append(now)
        assert k == 4 or now.columns == columns
    ids = [{r["doc_id"] for r in s.collect()} for s in seen[:4]]
    clean = {r["doc_id"] for r in linerules.report(spark.read.parquet(f"{d}/documents.parquet")).collect() if r["keep"]}
    assert ids[0] == clean and not {14, 15, 16} & clean
    text = {r["doc_id"]: r["text"] for r in seen[0].collect()}
    twins = {b for _, b in brute_pairs(list(text.items()), jaccard.N, jaccard.THRESHOLD)}
    assert ids[1] == clean - twins and {10, 11} <= twins
    leaks = {i for i in ids[1] if brute_score(words(text[i]), words(LEAK)) >= decontam.MIN_SCORE}
    assert ids[2] == ids[1] - leaks and leaks == {12}
    assert ids[3] == ids[2]
    final = {r["doc_id"]: r for r in seen[3].collect()}
    assert SECRET not in final[13]["text"] and "[SECRET]" in final[13]["text"] and all(r["n_chars"] == len(r["text"]) for r in final.values())
    encode = vocab.encoding(vocab.read()).encode_ordinary
    assert secrets.secrets(seen[3]).count() == 0
    assert sum(r["n_tokens"] for r in seen[4].collect()) == sum(len(encode(r["text"])) for r in final.values())


def test_run(spark, tmp_path):
    d, _ = make(spark, tmp_path)
    out = corpus_pipeline.run(spark, d).collect()
    assert {i for r in out for i in r["doc_ids"]} == {0, 1, 2, 3, 4, 5, 13}


def test_empty(spark, tmp_path):
    d = tmp_path / "sf"
    docs(spark, []).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(d / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(d)).count() == 0
