"""The entry point, with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_names_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_corpus_operators(tmp_path):
    for p in ("__spark_entry__.py", "canonry"):
        (tmp_path / p).symlink_to(ROOT / p) if p.endswith(".py") else None
    (tmp_path / "canonry").mkdir()
    for p in (ROOT / "canonry").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "canonry" / p.name).symlink_to(p)
    code = "import sys; sys.path[0] = '.'; exec(open('__spark_entry__.py').read()); q = queries(); print(len(q), 'op4_bpe' in q, 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 40 and out[1:] == ["False", "False"]


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="the driver's tables are not here")
def test_flagship(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.count() > 0 and "confidence" in rows.columns
