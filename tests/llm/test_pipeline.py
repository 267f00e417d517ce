"""The pipeline's stages against brute-force versions on the smallest tables."""

import os
import re
from pathlib import Path

import pytest

import corpus_pipeline
from ferrite.llm import common, pii_pseudonyms, quality

from .test_operators import brute_groups, brute_leaks, check_packing, plain_pseudonyms

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialise(stage(spark, docs, SF), "test")
        rows = out.collect()
        if name == "quality classifier":
            labels = spark.read.parquet(f"{SF}/labels.parquet").where(common.crc_mod("doc_id", 5) != 0)
            model, memo = quality.fit(docs, labels), quality._Memo()
            want = {i: t for i, t in kept.items() if model.score(t, memo) >= 0.3}
        elif name == "near duplicates":
            want = {i: kept[i] for i, _, _, stays in brute_groups(list(kept.items()), 80) if stays}
        elif name == "benchmark decontamination":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            leaks = {d for d, _ in brute_leaks(list(kept.items()), bench)}
            want = {i: t for i, t in kept.items() if i not in leaks}
        elif name == "personal data":
            assert all(r.n_chars == len(r.text) for r in rows)
            assert {r.doc_id for r in rows} == set(kept)
            key = pii_pseudonyms.session_key(spark)
            want = {i: plain_pseudonyms(t, key)[0] for i, t in kept.items()}
        else:
            check_packing(rows, list(kept.items()))
            continue
        assert out.columns == columns and {r.doc_id: r.text for r in rows} == want, name
        docs, kept = out, want


def test_run_on_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_scratch_tables_can_be_deleted(spark):
    common.materialise(spark.range(3), "test").count()
    assert common.clean_up(spark) and not common.clean_up(spark)


def test_the_driver_gives_freed_memory_back(spark):
    """Each table that is written returns what the driver's JVM has freed outside its heap; glibc alone keeps it."""
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()

    def resident():
        return int(re.search(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024

    common.materialise(spark.range(3), "test")
    held = [spark._jvm.java.util.zip.Deflater() for _ in range(2500)]  # 0.08 MB each
    for d in held[:-1]:
        d.end()
    kept = resident()
    common.materialise(spark.range(3), "test")
    after = resident()
    held[-1].end()
    assert after < kept - 100


def test_run_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, ties, clashing names: each row has its tokens packed once."""
    fine = "The quick brown fox jumps over the lazy dog near the river bank. " * 4
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, fine, "en", "s", 1), (3, fine, "en", "s", 1), (4, fine, "en", None, 1), (None, "a b", "en", "s", 3), (5, "word " * 200_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.selectExpr("*", "1 AS score", "'x' AS pii_kinds", "2 AS n", "3 AS rep").write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Without labels all are kept; of 3, 3 and 4 one stays.
    assert {r.doc_id for r in got} == {None, 1, 2, 3, 5}
    for i in (None, 1, 2, 3, 5):
        assert sum(r.length for r in got if r.doc_id == i) == max(r.doc_tokens for r in got if r.doc_id == i)
