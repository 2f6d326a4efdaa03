import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
HIDE = "import sys, warnings; warnings.simplefilter('ignore'); sys.modules[{!r}] = None; import __spark_entry__ as e; print(len([n for n in e.queries() if n.startswith('op') and n[2].isdigit()]), 'settlement_depth' in e.queries(), 'settlement_depth' in e.oracle_sql())"


def said(hidden):
    out = subprocess.run([sys.executable, "-B", "-c", HIDE.format(hidden)], cwd=ROOT, capture_output=True, text=True, check=True)
    return out.stdout.split()


def test_entry_without_the_corpus_operators_or_a_library_of_theirs():
    for hidden in ("runlens.llm", "xxhash"):
        assert said(hidden) == ["0", "True", "True"]


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "runlens").rglob("*.py"):
        if "llm" not in path.parts:
            assert "runlens.llm" not in path.read_text()
