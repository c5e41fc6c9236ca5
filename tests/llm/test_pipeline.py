import random

import corpus_pipeline
from test_operators import DOC, brute_components, near_copies, text


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    boiler = "this boilerplate line stands in very many of the documents here"
    docs = [(i, t.capitalize() + "." + ("\n" + boiler if i % 4 == 0 else ""), "en", f"s{i % 3}", 1) for i, t in near_copies(rng)]
    n = len(docs)
    docs += [(n + i, " *** ".join(text(rng, 30).split()), "en", "s0", 1) for i in range(40)]
    item = text(rng, 30, 5000)
    docs += [(n + 40, text(rng, 20) + " " + item, "en", "s1", 1), (n + 41, None, None, None, None), (n + 41, None, None, None, None), (None, "A null id here.", "en", "s1", 1)]
    spark.createDataFrame(docs, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < n), 0) for i in range(n + 30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, made = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        made[name] = at.collect()
    ids = {k: {r.doc_id for r in v} for k, v in made.items()}
    assert not ids["quality"] & set(range(n, n + 40)) and set(range(n)) <= ids["quality"]
    holding = [r.doc_id for r in made["line_dedup"] if r.text and boiler in r.text]
    assert len(holding) == 1 and all(r.n_chars == (len(r.text) if r.text is not None else None) for r in made["line_dedup"])
    roots = brute_components([(r.doc_id, r.text) for r in made["line_dedup"] if r.doc_id is not None])
    assert ids["near_dedup"] - {None} == {i for i in roots if roots[i] == i} and len(made["near_dedup"]) == len(ids["near_dedup"])
    assert ids["near_dedup"] - ids["decontaminate"] == {n + 40}
    assert ids["mixing"] == ids["decontaminate"] and len({r.mix_position for r in made["mixing"]}) == len(made["mixing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(made["mixing"])


def test_stages_on_odd_tables(spark, tmp_path):
    """Each stage alone: extra columns that are called like the operators' own, very long texts, repeated and null ids."""
    rng = random.Random(12)
    rows = [(i, text(rng, 30), "en", f"s{i % 2}", 1, "a", "b", "c", "d", "e") for i in range(30)]
    rows += [(50, text(rng, 60_000), "en", "s0", 1, *"abcde"), (51, "x" * 300_000, None, None, None, *"abcde"), (None, None, None, None, None, *"abcde"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, DOC + ", _gone string, _repeated string, _leaks string, lost_keys string, Score string")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[3][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[:5] == corpus_pipeline.COLUMNS and len(out.columns) == (8 if name == "mixing" else 5)
        got = out.collect()
        assert {50, 51} <= {r.doc_id for r in got} or name == "quality"
        if name == "near_dedup":
            assert len(got) == len({r.doc_id for r in got}) == 33
        elif name == "decontaminate":
            assert len(got) == 34 and 3 not in {r.doc_id for r in got}
        elif name != "quality":
            assert len(got) == 35


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
