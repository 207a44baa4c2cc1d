"""The catalogue at the smallest scale, and that the library stands without its optional subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from traceloom.queries import ORACLE_SQL, QUERIES

ROOT = Path(__file__).parent.parent
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, db, name):
    frame = QUERIES[name](spark, DATA)
    rows = frame.collect()
    assert rows
    if name in ORACLE_SQL:
        got = db.execute(ORACLE_SQL[name])
        names = sorted(d[0] for d in got.description)
        assert sorted(frame.columns) == names
        place = [[d[0] for d in got.description].index(n) for n in names]
        want = sorted(repr(tuple(r[i] for i in place)) for r in got.fetchall())
        assert sorted(repr(tuple(r[n] for n in names)) for r in rows) == want


def test_the_rest_stands_alone(tmp_path):
    """Without the corpus operators, the entry module still gives the other queries."""
    (tmp_path / "traceloom").mkdir()
    for p in (ROOT / "traceloom").iterdir():
        if p.name != "llm":
            (tmp_path / "traceloom" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


@pytest.mark.skipif(not (ROOT / "traceloom/llm").exists(), reason="the corpus operators are not there")
def test_a_missing_dependency_takes_only_the_corpus_operators_down():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'stack_latest_ok' in q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env={"PYTHONPATH": str(ROOT), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert "left out" in out.stderr


def test_nothing_else_imports_the_corpus_operators():
    for p in (ROOT / "traceloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "traceloom.llm" not in p.read_text() and "from traceloom import llm" not in p.read_text()


def test_flagship_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_safe_names_of_whole_texts(spark):
    from traceloom.functions import formats

    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("text is not null")
    rows = docs.select("text", formats.safe_name(docs["text"]).alias("name")).collect()
    assert any(" " in r["text"][20:] for r in rows)
    assert all(r["name"] == r["text"].replace("/", ".").replace("\\", ".").replace(" ", "_") for r in rows)
