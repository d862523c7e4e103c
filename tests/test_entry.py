import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import __spark_entry__ as e
from aerialframe import catalog
assert set(e.queries()) == set(catalog.QUERIES) and e.oracle_sql() == catalog.ORACLES, sorted(e.queries())
import bench
print(len(e.queries()))
"""


def copied(tmp_path, *dropped):
    out = tmp_path / "repo"
    skip = {ROOT / d for d in dropped} | {ROOT / ".git"}
    shutil.copytree(ROOT, out, ignore=lambda d, names: [n for n in names if Path(d) / n in skip or n == "__pycache__"])
    return out


def run(folder):
    return subprocess.run([sys.executable, "-c", CODE], cwd=folder, capture_output=True, text=True, timeout=120)


def test_survey_queries_stand_without_the_corpus_folders(tmp_path):
    """With the corpus operators gone, pipeline file kept or not, every other query and its SQL remain."""
    for i, dropped in enumerate((("aerialframe/llm", "tests/llm"), ("aerialframe/llm", "tests/llm", "corpus_pipeline.py"))):
        done = run(copied(tmp_path / str(i), *dropped))
        assert done.returncode == 0 and int(done.stdout) > 40, done.stderr


def test_errors_inside_the_corpus_modules_are_raised(tmp_path):
    folder = copied(tmp_path)
    if not (folder / "aerialframe/llm").exists():
        (folder / "aerialframe/llm").mkdir()
        (folder / "aerialframe/llm/__init__.py").write_text("")
    (folder / "aerialframe/llm/queries.py").write_text("import no_such_module\n")
    done = run(folder)
    assert done.returncode != 0 and "no_such_module" in done.stderr
