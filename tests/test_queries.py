import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from plumbline import registry

from .conftest import DATA, canon


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_sql(spark, duck, name):
    own, sql = registry.QUERIES[name](spark, DATA).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(own.columns) == sorted(sql.columns)
    assert canon(own) == canon(sql)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["c_name", "o_orderkey", "l_linenumber", "l_quantity"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    """With both llm folders gone, and with the pipeline's module there or not, the other queries and their SQL are gathered."""
    here = Path(__file__).resolve().parent.parent
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache")
    code = "import __spark_entry__ as e, sys; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and 'three_way_join' in s and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert not [m for m in sys.modules if '.llm' in m]"
    for k in range(2):
        shutil.copytree(here, tmp_path / str(k), ignore=skip)
        if k:
            (tmp_path / str(k) / "corpus_pipeline.py").unlink()
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path / str(k), check=True)
