import corpus_pipeline
from palimpsest.llm.queries import queries
from palimpsest.llm.toxicity import SEEDS

from .conftest import prose


def test_stages(spark, tmp_path):
    passage, base = prose(20, 1), prose(100, 2)
    texts = [prose(60, 100 + i) for i in range(30)] + [base, base, base + " end", prose(30, 3) + " " + passage, "see token = abcdefghijklmnop", None, ""]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    toxic = [(100 + i, " ".join(w + (" you " + SEEDS[(i + k) % 10] if k % 12 == 5 else "") for k, w in enumerate(prose(60, 500 + i).split())), "en", "src0", 9) for i in range(30)]
    folder = str(tmp_path)
    spark.createDataFrame(rows + toxic, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(30)] + [(100 + i, 1, 1) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        seen.append({r.doc_id for r in out.select("doc_id").collect()})
        docs = out
    clean = set(range(37))
    assert seen[0] == clean and seen[1] == clean - {31, 32} and seen[2] == seen[1] - {33} and seen[3] == seen[2] == seen[4]
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == seen[4]


def test_stages_meet_hard_rows(spark, tmp_path):
    """Null ids and texts, empty and long texts, repeated rows, clashing columns; then tables without any row."""
    base, folder = prose(100, 2), str(tmp_path)
    rows = [(1, base), (1, base), (2, base + " end"), (None, None), (None, prose(40, 8)), (3, None), (4, ""), (5, prose(9_000, 9)), (6, " \n "), (7, "token = 0123456789abcdef0123")]
    rows = [(i, t, "en", "s", len(t or ""), 0.5, "x") for i, t in rows]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string"
    for name, table in (("full", rows), ("none", [])):
        at = f"{folder}/{name}"
        spark.createDataFrame(table, kinds).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, None), (2, "")] if table else [], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for stage, function in corpus_pipeline.STAGES[:-1]:
            docs = function(spark, docs, at)
            assert docs.schema == spark.read.parquet(f"{at}/documents.parquet").schema
        kept = [(r.doc_id, r.text) for r in docs.collect()]
        want = [(None, None), (None, prose(40, 8)), (1, base), (3, None), (4, ""), (5, prose(9_000, 9)), (6, " \n "), (7, "[secret]")] if table else []
        assert sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")) == want
        packed = corpus_pipeline.run(spark, at).collect()
        assert {r.doc_id for r in packed} == {i for i, _ in want}


def test_every_operator_is_registered():
    assert [sum(n.startswith(f"op{k}_") for n in queries()) for k in range(1, 11)] == [1] * 10
