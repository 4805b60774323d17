"""The pipeline's stages against plain Python, each on its own input."""

import re
from collections import defaultdict

import corpus_pipeline
import public_tokenizers
from fixtures import prose
from test_texts import line_result, near_result
from tokenizers import Tokenizer


def test_stages_match_brute_force(llm_spark, doc_rows, tmp_path):
    item = " ".join(prose(500, 30).split())
    toxic = [(200 + i, f"{prose(600 + i, 25)} scum {prose(700 + i, 10)} trash") for i in range(12)]
    clean = [(300 + i, prose(800 + i, 30)) for i in range(40)]
    rows = [r for i, r in enumerate(doc_rows) if r not in doc_rows[:i]] + [(400, "Before. " + item + " after it."), (401, "Other.\n" + item)] + toxic + clean
    frame = [(i, t, "en", "s", len(t or "")) for i, t in rows] + [(None, "no id at all", None, None, None)]
    docs = llm_spark.createDataFrame(frame, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 1) for i, _ in toxic] + [(i, 1, 0) for i, _ in clean]
    llm_spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    llm_spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    now = llm_spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(llm_spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/stage{n}")
        before, now = now, llm_spark.read.parquet(f"{tmp_path}/stage{n}")
        seen[name] = ([(r["doc_id"], r["text"]) for r in before.collect()], now.collect())
        if name != "packing":
            assert now.columns == corpus_pipeline.COLUMNS

    given, kept = seen["toxicity"]
    assert sorted(r["doc_id"] or -1 for r in kept) == sorted(i or -1 for i, _ in given if not 200 <= (i or 0) < 300)
    given, kept = seen["line_dedup"]
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept) == sorted((r[0], r[3]) for r in line_result(given))
    assert all(r["n_chars"] == len(r["text"]) for r in kept)
    given, kept = seen["near_dedup"]
    want = {r[0] for r in near_result([x for x in given if x[0] is not None], 5, 4, 5) if r[3]}
    assert {r["doc_id"] for r in kept if r["doc_id"] is not None} == want and any(r["doc_id"] is None for r in kept)
    given, kept = seen["decontamination"]
    assert {i for i, _ in given} - {r["doc_id"] for r in kept} == {i for i, t in given if item in re.sub(r"\s+", " ", t or "")}
    given, pieces = seen["packing"]
    tokenizer, sizes = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(int)
    for p in pieces:
        sizes[p["doc_id"]] += p["length"]
    want = defaultdict(int)
    for i, t in given:
        want[i] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    assert sizes == want

    # The whole run gives the rows of its stages, one after the other.
    assert sorted(corpus_pipeline.run(llm_spark, str(tmp_path)).collect(), key=str) == sorted(pieces, key=str)


def test_pipeline_of_empty_tables(llm_spark, tmp_path):
    llm_spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    llm_spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    llm_spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(llm_spark, str(tmp_path)).count() == 0
