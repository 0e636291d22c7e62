import hashlib
import os
import subprocess
import sys
from collections import Counter

import pytest

import corpus_pipeline as P
from rankaudit.llm import mixing, shingle_join
from tests.llm import fixtures
from tests.llm.test_line_dedup import brute as brute_lines

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([r[:5] for r in fixtures.rows()], COLUMNS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(70)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_take_effect_one_after_the_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_jaccard", "mixing", "byte_bpe"]
    tables = {}
    for name, stage in P.STAGES[:-1]:
        docs = P.written(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == spark.read.parquet(f"{sf_dir}/documents.parquet").columns
        tables[name] = [tuple(r) for r in docs.collect()]
    start = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    kept = Counter(map(str, tables["toxicity"]))
    assert not kept - Counter(map(str, start))  # rows are kept or go, unchanged
    want = brute_lines(tables["toxicity"])
    after = {(i, t): t if not gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone) for (i, t), gone in want.items()}
    assert Counter((r[0], r[1]) for r in tables["line_dedup"]) == Counter((r[0], after[r[0], r[1]]) for r in tables["toxicity"])
    frame = lambda rows: spark.createDataFrame(rows, COLUMNS)
    comps = {(r.doc_id, r.n_shingles): r.component_id for r in shingle_join.jaccard_components(frame(tables["line_dedup"])).collect()}
    stay = {i for (i, n), c in comps.items() if n == 0 or c == i}
    assert {r[0] for r in tables["ngram_jaccard"]} == stay
    copies = mixing.mix_sources(frame(tables["ngram_jaccard"])).collect()
    assert Counter(r[0] for r in tables["mixing"]) == Counter({k: n for k, n in ((r.doc_id, r.copies) for r in copies) if n})
    out = P.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sorted(r.decoded_sha256 for r in out) == sorted(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in tables["mixing"])


def test_run_on_an_empty_table(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert P.run(spark, d).collect() == []


def test_entry_works_without_the_corpus_operators():
    code = (
        "import sys; sys.modules['rankaudit.llm'] = None\n"
        "import __spark_entry__ as e\n"
        "assert not [q for q in e.queries() if q.startswith('op')] and 'pipeline' not in e.queries() and e.queries()"
    )
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, check=False).returncode == 0
