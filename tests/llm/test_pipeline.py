"""The corpus pipeline, stage by stage, on a small table with planted cases."""

import random

from skyloom.session import shared_path


def test_stages(spark):
    import corpus_pipeline

    rng = random.Random(9)
    words = [a + b for a in ("ba", "do", "ki", "lu", "me") for b in ("ra", "so", "tu", "ve", "ny", "pi")]
    rows, labels = [], []
    for i in range(240):
        bad = i % 6 == 0
        w = [rng.choice(words) for _ in range(70)]
        text = " ".join(x.upper() + "$$$" for x in w) if bad else " ".join(w) + "."
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(not bad), 0))
    copy = rows[7][1]
    rows += [(1000 + i, copy if i % 2 else copy.replace(".", " end."), "en", "s1", len(copy)) for i in range(20)]
    folder = shared_path(spark, "t-tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, columns = spark.read.parquet(f"{folder}/documents.parquet"), None
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert columns in (None, docs.columns)
            columns = docs.columns
        seen[name] = docs.collect()
    assert {r["doc_id"] for r in seen["quality"]} == {i for i, *_ in rows if i >= 1000 or i % 6}
    kept = {r["doc_id"] for r in seen["near_dedup"]}
    assert kept == {i for i in range(240) if i % 6} and len(seen["near_dedup"]) == len(kept)
    assert {r["doc_id"] for r in seen["mixing"]} <= kept
    out = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in seen["mixing"]) and all(r["round_trip"] and r["parity"] for r in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "mixing", "sentencepiece"] and corpus_pipeline.ORACLE_SQL is None


def tables(spark, rows, labels, more="", label_more=""):
    folder = shared_path(spark, "t-tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + more).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int" + label_more).write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_of_odd_rows(spark):
    """Nulls in any column, empty and repeated rows, one long text, and columns named like those within the stages."""
    import corpus_pipeline

    rng = random.Random(3)
    words = [a + b for a in ("ba", "do", "ki", "lu") for b in ("ra", "so", "tu", "ve")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(60) if i % 5 else text(40).upper() + " $$$", "en", f"s{i % 2}", 300) for i in range(100)]
    labels = [(i, int(i % 5 > 0), 0) for i in range(100)] + [(None, 1, 0), (3, None, None)]
    rows += [(None, text(50), None, None, None), (200, None, "en", "s0", None), (201, "", None, "s1", 0), (7, rows[7][1], "en", "s1", 300), (7, text(55), "en", "s1", 300), (202, text(60_000), "en", "s0", 1)]
    wide = [(*r, 1, "x", 0.5, 9) for r in rows]
    folder = tables(spark, wide, [(*r, 5) for r in labels], ", _0 int, component_id string, score double, hash int", ", text int")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {None: docs}
    for name, stage in corpus_pipeline.STAGES:
        last = docs
        docs = stage(spark, docs, folder)
        if name != "sentencepiece":
            assert docs.columns == seen[None].columns
            docs = docs.cache()
        seen[name] = docs
        assert docs.count() > 0
    assert seen["near_dedup"].where("doc_id = 7").count() == 2  # the repeated row goes, the other text stays
    assert last.count() == docs.count()
    assert {r["doc_id"] for r in seen["quality"].collect()} >= {i for i in range(100) if i % 5}


def test_empty_tables(spark):
    import corpus_pipeline

    folder = tables(spark, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
    folder = tables(spark, [(1, "a few words here", "en", "s", 16), (2, None, None, None, None)], [])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} <= {1, 2}
