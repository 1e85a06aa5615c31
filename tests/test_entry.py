import subprocess
import sys
import textwrap

from .conftest import ROOT


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["conv_id", "turn", "score", "matched"]


def test_library_without_the_corpus_operators():
    code = """
    import sys
    class Absent:
        def find_spec(self, name, path=None, target=None):
            if name in ("corpus_pipeline", "sediment.llm"):
                raise ModuleNotFoundError(f"no {name}", name=name)
    sys.meta_path.insert(0, Absent())
    import __spark_entry__ as e
    assert "pipeline" not in e.queries() and "recall_topk_conversations" in e.queries()
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=ROOT, check=True)
