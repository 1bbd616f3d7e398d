import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parents[1]


def test_works_without_the_corpus_operators(tmp_path):
    """The entry imports, without a session, where the corpus subpackage and its pipeline are gone."""
    shutil.copytree(REPO / "readlake", tmp_path / "readlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not [k for k in q if k.startswith('op') and k[2].isdigit() or k == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_works_where_the_corpus_operators_cannot_be_imported(tmp_path):
    """A package that they need is missing."""
    shutil.copytree(REPO / "readlake", tmp_path / "readlake", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import sys; sys.modules['xxhash'] = sys.modules['tokenizers'] = sys.modules['regex'] = None; import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_the_corpus_operators():
    for path in REPO.glob("readlake/**/*.py"):
        if "llm" not in path.parts:
            assert "readlake.llm" not in path.read_text() and "from .llm" not in path.read_text(), path
