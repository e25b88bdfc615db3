import corpus_pipeline
from quillmerge.llm import toxicity
from quillmerge.llm.pieces import Pieces
from quillmerge.llm.queries import PIECES, vocabulary


def tables(spark, folder, docs_of, prose):
    rows = []
    for k in range(120):
        text = "\n".join(prose(k * 5 + j, 20) for j in range(4)) + "\nAll rights reserved"
        if k % 4 == 0:
            text += "\n" + " ".join(["badword vilething vilestuff"] * 6)
        rows.append((k, text))
    items = [(k, prose(700 + k, 30)) for k in range(5)]
    rows[5] = (5, prose(1, 30) + " " + items[2][1] + " " + prose(2, 30))
    rows += [(200, rows[1][1]), (201, rows[1][1]), (202, None), (203, ""), (204, rows[2][1])]
    docs_of(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(120)], "doc_id long, toxic int").selectExpr("doc_id", "1 AS quality", "toxic").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(rows)


def test_stages_by_hand(spark, tmp_path, docs_of, prose):
    """Each stage against what its definition keeps of its own input."""
    tables(spark, tmp_path, docs_of, prose)
    sf_dir = str(tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "sentencepiece"]

    kept = stage["toxicity"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.Settings())
    scores = {r.doc_id: r.score for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    assert {r.doc_id for r in kept.collect()} == {k for k, s in scores.items() if s < 0.5}
    clean = [k for k in scores if k % 4 and k < 120]
    assert sum(scores[k] < 0.5 for k in clean) > 0.8 * len(clean)

    lines = stage["line_dedup"](spark, docs, sf_dir)
    assert lines.columns == docs.columns and lines.count() == docs.count()
    assert not any("All rights" in r.text for r in lines.collect())
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    single = {r.doc_id for r in stage["near_duplicates"](spark, docs, sf_dir).collect()}
    assert {1, 2} <= single and not {200, 201, 204} & single and len({202, 203} & single) == 1

    left = {r.doc_id for r in stage["decontamination"](spark, docs, sf_dir).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {5}

    table = Pieces.load(vocabulary(PIECES))
    coded = stage["sentencepiece"](spark, docs, sf_dir).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.exact and table.decode(r.ids) == texts[r.doc_id] for r in coded)


def test_run_applies_all(spark, tmp_path, docs_of, prose):
    tables(spark, tmp_path, docs_of, prose)
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not {5, 200, 201, 204} & got and len(got) > 60


def test_null_and_repeated_ids_and_clashing_columns_stay(spark, tmp_path, docs_of, prose):
    """Clean rows stay whatever id they share with a leak or a copy, and so do a caller's columns."""
    tables(spark, tmp_path, docs_of, prose)
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()}
    rows = [(None, prose(801, 40)), (None, prose(802, 40)), (7, prose(803, 40)), (7, prose(804, 40)), (7, bench[1]), (None, bench[2]), (8, None), (9, prose(801, 40))]
    docs = docs_of(rows).selectExpr("*", "1 AS toxicity", "2 AS n_lines", "3 AS n_dropped", "4 AS row", "'x' AS item_id")
    stage = dict(corpus_pipeline.STAGES)
    for name in ("line_dedup", "near_duplicates", "decontamination"):
        docs = stage[name](spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "toxicity", "n_lines", "n_dropped", "row", "item_id"]
    kept = docs.collect()
    assert sorted((r.text or "") for r in kept) == sorted(["", *(prose(k, 40) for k in (801, 802, 803, 804))])
    assert all((r.toxicity, r.n_lines, r.n_dropped, r.row) == (1, 2, 3, 4) for r in kept)


def test_an_empty_table_stays_empty(spark, tmp_path, docs_of, prose):
    tables(spark, tmp_path, docs_of, prose)
    docs = docs_of([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
