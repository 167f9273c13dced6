import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_flagship(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["raw_key", "commit_ts", "value"] and out.count() > 0


def test_every_sql_has_a_query():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_nothing_else_needs_the_training_data_operators(tmp_path):
    for f in ("__spark_entry__.py", *(str(p.relative_to(ROOT)) for p in (ROOT / "palimpsest").rglob("*.py"))):
        if "/llm/" not in f:
            (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / f).write_text((ROOT / f).read_text())
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()), len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert done.stdout.split() == ["True", "44"]
