import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from loomspan.session import checkpointed

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert {"qid", "chunk_id", "score", "rank"} <= set(df.columns)


@pytest.mark.parametrize("hidden", ["loomspan.llm", "zstandard"])
def test_library_works_without_the_optional_subpackage_or_what_it_needs(hidden):
    code = f"import sys; sys.modules[{hidden!r}] = None\nimport __spark_entry__ as e\nassert len(e.queries()) > 100 and e.oracle_sql() and not any(k.startswith('p1_') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_library_works_with_the_optional_folders_deleted(tmp_path):
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e\nassert len(e.queries()) > 100 and e.oracle_sql() and not any(k.startswith('p1_') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True)


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Nothing:
        isEmpty = staticmethod(lambda: True)

    class Scala:
        getCheckpointDir = staticmethod(lambda: Nothing)

    class Java:
        sc = staticmethod(lambda: Scala)

    class Context:
        master, _jsc = "spark://host:7077", Java
        getConf = staticmethod(lambda: Conf)

    class Session:
        sparkContext = Context

    class Frame:
        sparkSession = Session()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpointed(Frame)
