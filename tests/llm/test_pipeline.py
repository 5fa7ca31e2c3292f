import os
import subprocess
import sys

import corpus_pipeline
from pageloom.llm.decontaminate import leaks
from pageloom.llm.jaccard import near_duplicates
from pageloom.scratch import materialize


def test_stages(spark, sf_dir, documents):
    docs = documents
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        if name != "sharding":
            assert docs.columns == documents.columns
        kept[name] = (before, docs)
    before, after = kept["near_duplicates"]
    classes = near_duplicates(before)
    assert after.count() == classes.select("class_id").distinct().count()
    assert after.count() == after.join(classes.filter("doc_id = class_id"), "doc_id").count()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    before, after = kept["decontamination"]
    leaky = leaks(before, items).select("doc_id").distinct()
    assert leaky.count() > 0
    assert before.join(leaky, "doc_id", "left_anti").exceptAll(after).isEmpty()
    assert after.count() == before.count() - leaky.count()
    before, after = kept["mixing"]
    assert after.distinct().exceptAll(before).isEmpty()
    before, shards = kept["sharding"]
    assert shards.count() == before.count()
    assert shards.select("shard").distinct().count() == 8
    ran = corpus_pipeline.run(spark, sf_dir)
    assert ran.exceptAll(shards).isEmpty() and shards.exceptAll(ran).isEmpty()


def test_odd_rows_pass_all_stages(spark, odd, empty, sf_dir):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, sf_dir), "stage")
        docs.count()


def test_entry_without_the_subpackage(tmp_path):
    """The entry module imports when this subpackage and the pipeline are absent."""
    root = os.path.dirname(corpus_pipeline.__file__)
    for name in ("__spark_entry__.py", "pageloom"):
        os.symlink(os.path.join(root, name), tmp_path / name)
    code = (
        "import importlib.util as u; find = u.find_spec\n"
        "u.find_spec = lambda n, *a: None if n in ('pageloom.llm', 'corpus_pipeline') else find(n, *a)\n"
        "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql()\n"
        "assert 'pipeline' not in q and not any(n.startswith('op') for n in q) and q and s"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
