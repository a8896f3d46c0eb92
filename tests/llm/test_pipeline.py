"""The pipeline's stages on a small corpus; each is judged on its own input."""

import corpus_pipeline
from tidewheel.llm import sigtree
from tidewheel.llm.queries import ORACLES, QUERIES


def test_stages_and_queries_are_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    assert len(QUERIES) == 10 and {k.split("_")[0] for k in QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(ORACLES) <= set(QUERIES)


def test_pipeline_keeps_columns_and_decides(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d).cache()
        if i < 4:
            assert out.columns == docs.columns, name
            assert 0 < out.count() <= n
        if name == "near_duplicates":
            again = sigtree.jaccard_components(out)
            assert again.where("component_id <> doc_id").isEmpty()
        docs, n = out, out.count()
    assert {"copies", "taken"} <= set(docs.columns) and docs.where("copies < 1 OR copies > 3").isEmpty()


def test_stages_on_nulls_repeats_and_nothing(spark, tmp_path):
    import os

    for name in ("labels", "benchmark"):
        os.symlink(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    kind = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, th string, n_words string"
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, None, None, None), (1, text, None, None, None), (2, None, "en", "a", None), (3, "", "en", "a", 0), (None, text, None, "b", 3), (4, "other words " * 30_000, "en", "b", 1)]
    docs = spark.createDataFrame([(*r, "s", "r", "t", "n") for r in rows], kind)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path)).collect()
        if i < 4:
            assert [f for f in out[0].asDict()] == docs.columns, name
            kept = [(r.doc_id, r.text and r.text[:20], r.row) for r in out]
            assert (2, None, "r") in kept and (3, "", "r") in kept and any(r[0] is None for r in kept), name
        else:
            assert {r.doc_id for r in out} <= {1, None, 4} and out[0].size == "s" and out[0].mix_size > 0


def test_a_cut_gives_freed_native_memory_back(spark):
    import re
    from pathlib import Path

    from tidewheel.llm import graph

    jvm = spark.sparkContext._jvm
    unsafe = jvm.org.apache.spark.unsafe.Platform
    rollup = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")

    def anonymous():
        return int(re.search(r"\nPss_Anon:\s+(\d+)", rollup.read_text())[1]) / 1024

    for _ in range(3):  # the heap has shrunk as far as it will
        graph.cut(spark.range(1))
    size = 100_000
    blocks = [unsafe.allocateMemory(size) for _ in range(3000)]
    for b in blocks:
        unsafe.setMemory(b, 1, size)
    # The last one stays in use, so that the C library can't give up the end of its area.
    for b in blocks[:-1]:
        unsafe.freeMemory(b)
    before = anonymous()
    graph.cut(spark.range(1))
    after = anonymous()
    unsafe.freeMemory(blocks[-1])
    assert before - after > 200, (before, after)
