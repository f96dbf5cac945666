import os
import shutil
import subprocess
import sys

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from workload.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
# Queries whose plans differ most; the whole set runs with workload.compare.
CHECKED = ["build_terms", "privacy_findings", "leak_scan", "chunk_pages", "lexical_search", "check_pages",
           "check_history", "parse_event_streams", "topk_capped", "metrics_stream", "strip_citation_stream"]


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(CHECKED) <= set(oracle_sql())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not present")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    ok, note = compare(spark, connect(FOLDER), FOLDER, name, queries()[name], oracle_sql()[name])
    assert ok, note


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not present")
def test_entry_returns_ranked_rows(spark):
    assert entry(spark).columns == ["query_id", "rank", "chunk_id", "source_id", "score"]


def test_import_without_the_optional_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for part in ("evidentia", "workload"):
        shutil.copytree(os.path.join(root, part), tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for part in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(root, part)):
            shutil.copy(os.path.join(root, part), tmp_path / part)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op') for n in q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)},
                          capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    count, *rest = done.stdout.split()
    assert int(count) > 100 and rest == ["False", "False"]
