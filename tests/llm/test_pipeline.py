"""The corpus pipeline on the smallest tables, stage by stage, and the registry."""

import random

import pytest

import corpus_pipeline
from parlance.llm import queries

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_stages_and_registry():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "sentencepiece encoding"]
    assert [k for k in queries.QUERIES if k.startswith("op")] == [f"op{i}_{n}" for i, n in enumerate(("sentencepiece", "sharding", "embedding_dedup", "license_scan", "url_filter", "simhash", "line_dedup", "substring_dedup", "quality", "decontamination"), 1)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_pipeline_on_planted_documents(spark, tmp_path):
    rng = random.Random(4)
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    good = spark.read.parquet(f"{LARGER}/labels.parquet").where("quality = 1 and toxic = 0")
    vocabulary = sorted({w for r in docs.where("lang = 'en'").join(good, "doc_id").select("text").collect() for w in r.text.split() if w.isalpha() and w.islower()})
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = spark.read.parquet(f"{LARGER}/benchmark.parquet").orderBy("item_id").first().text
    clean = [prose(120) for _ in range(10)]
    rows = [(10**6 + i, t, "en", "src0", len(t)) for i, t in enumerate(clean)]
    rows += [(10**6 + 50, clean[0], "en", "src1", 1), (10**6 + 51, clean[1].replace(clean[1].split()[60], "changed"), "en", "src1", 1)]
    rows += [(10**6 + 60, f"{prose(50)}\n{item}\n{prose(50)}", "en", "src0", 1), (10**6 + 70, " ".join(x + "###" for x in prose(80).split()), "en", "src0", 1)]
    root = str(tmp_path / "sf")
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(f"{root}/documents.parquet")
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{LARGER}/{t}.parquet").write.parquet(f"{root}/{t}.parquet")
    out = corpus_pipeline.run(spark, root).collect()
    got = {r.doc_id for r in out}
    passed = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{root}/documents.parquet"), root).select("doc_id").collect()}
    planted = {10**6 + i for i in range(10)}
    assert len(planted & passed) >= 9 and planted & passed <= got
    assert got & {10**6 + k for k in (50, 51, 60, 70)} == set()
    assert all(r.lossless for r in out if r.ids is not None)


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_and_take_empty_tables(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if stage == 0:
        docs = docs.where("doc_id < 100")
    out = corpus_pipeline.STAGES[stage][1](spark, docs if stage == 0 else docs.limit(0), SF)
    assert out.columns == docs.columns and (stage == 0 or out.count() == 0)


def test_line_stage_cuts_documents_of_mostly_repeated_lines(spark):
    """Repeated lines go from every document, also where they are most of it; a copy goes as a whole."""
    lines = ["the first of these lines is here", "another line, quite unlike others", "a third one that differs from both"]
    texts = ["\n".join(lines), f"{lines[0]}\n{lines[1]}\nnew", "\n".join(["one and the same line thrice over"] * 3), "\n".join(lines), "", None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup_stage(spark, docs, SF).collect()}
    assert got == {0: (texts[0], len(texts[0])), 1: ("new", 3), 2: (texts[2].split("\n")[0], 33), 4: ("", 0), 5: (None, 0)}


def test_scratch_is_released(spark, tmp_path):
    """Within the scope all tables are there, after it none of its operators' are; others stay."""
    from pathlib import Path

    from parlance.llm.common import Scratch, released

    outer = Scratch(spark)
    kept = outer.table(spark.range(3))
    with released():
        inner = Scratch(spark)
        some = inner.table(spark.range(4))
        result = outer.table(some.join(kept, "id"))
        assert some.count() == 4
    there = lambda s: Path(s.path.removeprefix("file://")).exists()
    assert result.count() == 3 and kept.count() == 3 and there(outer) and not there(inner)
