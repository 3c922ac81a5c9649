"""The pipeline's stages on planted cases, against plain versions, and the registration guard."""
import random
import subprocess
import sys

import brute
import __spark_entry__ as entry
import corpus_pipeline as pipeline
import numpy as np

from tabreg.llm import golay, packing
from test_operators import ODD, SMALL, documents


def english(spark, n):
    rows = spark.read.parquet(SMALL + "/documents.parquet").where("lang = 'en' and n_chars > 300").orderBy("doc_id").collect()
    return [r.text for r in rows][:n]


def test_registered():
    assert [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()] == list(f for f in (
        "op1_language_id", "op2_toxicity", "op3_lattice_dedup", "op4_pattern_packing", "op5_golay_simhash", "op6_ppm_score",
        "op7_lookup_shards", "op8_url_trees", "op9_bwt_dedup", "op10_wu_manber", "op11_two_bloom_lines",
        "op12_jump_manifest", "op13_identity_align"))
    assert entry.queries()["pipeline"] is pipeline.run and len(pipeline.STAGES) == 5


def test_stages_on_planted_cases(spark, tmp_path):
    texts = english(spark, 40)
    bench = [r.text for r in spark.read.parquet(SMALL + "/benchmark.parquet").orderBy("item_id").collect()]
    rng = random.Random(0)
    words = " ".join(texts).split()
    passage = " ".join(rng.choice(words) for _ in range(60))
    unique = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(8)]
    long_item = max(bench, key=len)
    planted = [unique[0], unique[0], unique[1].replace(unique[1].split()[5], "thing", 1), unique[1],
               unique[2] + " " + passage, unique[3] + " " + passage, unique[4] + " " + long_item,
               unique[5], "Это другой язык и здесь его никто не знает " * 4]
    (tmp_path / "b").mkdir()
    sf = str(tmp_path / "b")
    docs = documents(spark, planted)
    docs.write.parquet(sf + "/documents.parquet")
    spark.read.parquet(SMALL + "/benchmark.parquet").write.parquet(sf + "/benchmark.parquet")
    seen = {}
    cur = docs
    for name, stage in pipeline.STAGES:
        out = stage(spark, cur, sf)
        out.write.parquet(f"{sf}/{name}")
        cur = spark.read.parquet(f"{sf}/{name}")
        seen[name] = {r.doc_id: r for r in cur.collect()}
        if name != "packing":
            assert cur.columns == docs.columns
    # language: fitted on these labelled rows, all of them one known language
    assert set(range(8)) <= set(seen["language_id"])
    fps = {i: brute.fingerprint(r.text) for i, r in seen["language_id"].items()}
    ids = sorted(fps)
    lab = brute.groups(len(ids), lambda a, b: bin(fps[ids[a]] ^ fps[ids[b]]).count("1") <= 4)
    assert sorted(seen["simhash_near_dedup"]) == sorted({ids[k] for k in lab}) and 1 not in seen["simhash_near_dedup"]
    before, after = seen["simhash_near_dedup"], seen["suffix_array_dedup"]
    assert set(before) == set(after)
    keys = sorted(before)
    masks = brute.covered([before[i].text.encode() for i in keys], 200)
    for i, m in zip(keys, masks):
        want = bytes(b for b, x in zip(before[i].text.encode(), m) if not x).decode("utf-8", "ignore")
        assert after[i].text.encode("utf-8") == want.encode() or m.any() and abs(len(after[i].text) - len(want)) <= 4
    assert passage not in after[4].text and passage not in after[5].text
    assert unique[5] == after[7].text
    items = [(r.item_id, r.text) for r in spark.read.parquet(sf + "/benchmark.parquet").collect()]
    bad = {i for i, (n, hit, _) in zip(keys, brute.contamination([after[i].text for i in keys], items)) if hit and 20 * hit >= n}
    assert set(seen["decontamination"]) == set(after) - bad and 6 in bad and 7 not in bad
    packed = spark.read.parquet(f"{sf}/packing").collect()
    assert {r.doc_id for r in packed} == set(seen["decontamination"])
    assert all(sum(r.length for r in packed if r.sequence_id == s) <= packing.SIZE for s in {r.sequence_id for r in packed})


def test_run_on_odd_rows(spark, tmp_path):
    sf = str(tmp_path / "odd")
    documents(spark, [*ODD, *english(spark, 5)]).write.parquet(sf + "/documents.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(sf + "/benchmark.parquet")
    out = pipeline.run(spark, sf).collect()
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out[0].asDict())
    empty = str(tmp_path / "empty")
    documents(spark, []).write.parquet(empty + "/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(empty + "/benchmark.parquet")
    assert pipeline.run(spark, empty).count() == 0


def test_entry_without_the_subpackage():
    """The other queries must be there when neither the subpackage nor the pipeline can be found."""
    code = ("import sys\n"
            "class Gone:\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name in ('tabreg.llm', 'corpus_pipeline'): raise ModuleNotFoundError(name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "assert len(e.queries()) > 100 and not any(n.startswith('op1_') for n in e.queries())\n"
            "assert 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())\n")
    assert subprocess.run([sys.executable, "-c", code], cwd=pipeline.__file__.rsplit("/", 1)[0]).returncode == 0
