"""Analysis kept up to date equals a rebuild, and reads only what changed."""

import datetime
import random

import pytest

from quarry.operators import incremental
from quarry.sources import code

FILES = "path string, language string, mtime timestamp, content string"
T0 = datetime.datetime(2024, 1, 1)


def corpus(spark, texts):
    """``texts``: path -> (language, hour of change or None, content)."""
    rows = [(p, lang, None if hour is None else T0 + datetime.timedelta(hours=hour), text) for p, (lang, hour, text) in texts.items()]
    return spark.createDataFrame(rows, FILES)


def state(spark, root):
    edges = sorted((tuple(r) for r in incremental.edges(spark, root).collect()), key=str)
    symbols = sorted((tuple(r) for r in code.flat(incremental.parsed(spark, root), "symbols").collect()), key=str)
    files = sorted((tuple(r) for r in incremental.files(spark, root).collect()), key=str)
    return edges, symbols, files


BASE = {
    "src/a.py": ("python", 1, "import src.b\n\nclass Base:\n    def run(self):\n        helper()\n\ndef main():\n    run()\n    shared()\n"),
    "src/b.py": ("python", 1, "def helper():\n    shared()\n\ndef shared():\n    pass\n"),
    "src/c.py": ("python", 1, "from src.b import helper\n\nclass Child(Base):\n    pass\n\nhelper()\n"),
    "src/d.ts": ("typescript", 1, "import { x } from './e'\nexport function go() {\n  shared();\n  other();\n}\n"),
    "src/bad.py": ("python", 1, "def broken(:\n"),
}


def test_runs_follow_changes(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    texts = dict(BASE)
    first = incremental.update(corpus(spark, texts), root)
    assert (first["touched"], first["parsed"], first["linked"]) == (5, 4, 5)
    assert ("src/bad.py", "python", None) in [(r[0], r[1], r[3]) for r in state(spark, root)[2]]
    assert incremental.update(corpus(spark, texts), root) == {"touched": 0, "parsed": 0, "linked": 0, "edges": 0}

    def follow(expect, compare=True):
        got = incremental.update(corpus(spark, texts), root)
        assert (got["touched"], got["parsed"], got["linked"]) == expect
        if compare:
            whole = f"file://{tmp_path}/whole-{random.random()}"
            incremental.update(corpus(spark, texts), whole)
            assert state(spark, root) == state(spark, whole)

    # a body changes, no name moves: only the file itself is resolved again
    texts["src/b.py"] = ("python", 2, "def helper():\n    other()\n\ndef shared():\n    pass\n")
    follow((1, 1, 3), compare=False)  # and the two that import its path
    # a new file brings a name that two others call, and the path that one imports
    texts["src/e.ts"] = ("typescript", 2, "export function other() {\n  go();\n}\nexport function shared() {\n}\n")
    follow((1, 1, 4), compare=False)
    # a file goes: its names are looked for elsewhere
    del texts["src/b.py"]
    follow((1, 0, 4))
    # an older time than the known one is no change; an unknown one is
    texts["src/c.py"] = ("python", 0, "x = 1\n")
    assert incremental.update(corpus(spark, texts), root)["touched"] == 0
    texts["src/c.py"] = ("python", None, "class Child(Base):\n    def run(self):\n        pass\n")
    follow((1, 1, 2))
    assert incremental.update(corpus(spark, texts), root)["touched"] == 1  # still unknown


def test_a_run_that_broke_off_is_repeated(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/state"
    incremental.update(corpus(spark, BASE), root)
    before = state(spark, root)
    texts = BASE | {"src/b.py": ("python", 3, "def other():\n    helper()\n"), "src/f.go": ("go", 3, "func helper() {\n  shared();\n}\n")}
    put = incremental._put

    def failing(df, place, name, run):
        if name == "edges":
            raise RuntimeError("lost")
        return put(df, place, name, run)

    monkeypatch.setattr(incremental, "_put", failing)
    with pytest.raises(RuntimeError):
        incremental.update(corpus(spark, texts), root)
    assert state(spark, root) == before  # readers see the finished runs only
    monkeypatch.setattr(incremental, "_put", put)
    texts["src/b.py"] = ("python", 4, "def once():\n    helper()\n")
    incremental.update(corpus(spark, texts), root)
    whole = f"file://{tmp_path}/whole"
    incremental.update(corpus(spark, texts), whole)
    assert state(spark, root) == state(spark, whole)


def test_random_changes(spark, tmp_path):
    rng = random.Random(4)
    names = [f"f{k}" for k in range(9)]
    make = lambda: "".join(f"def {rng.choice(names)}():\n" + "".join(f"    {rng.choice(names)}()\n" for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 4)))
    texts = {f"p{k}.py": ("python", 0, make()) for k in range(8)}
    root = f"file://{tmp_path}/state"
    incremental.update(corpus(spark, texts), root)
    for turn in range(1, 3):
        for path in rng.sample(sorted(texts), 2):
            texts[path] = ("python", turn, make())
        del texts[rng.choice(sorted(texts))]
        texts[f"new{turn}.py"] = ("python", turn, f"import p{turn}\n" + make())
        incremental.update(corpus(spark, texts), root)
    whole = f"file://{tmp_path}/whole"
    incremental.update(corpus(spark, texts), whole)
    assert state(spark, root) == state(spark, whole)


def test_empty_corpus(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    assert incremental.update(corpus(spark, {}), root)["touched"] == 0
    incremental.update(corpus(spark, BASE), root)
    assert incremental.update(corpus(spark, {}), root)["touched"] == len(BASE)
    assert state(spark, root) == ([], [], [])


def test_only_late_files_are_opened(spark, tmp_path):
    """On a walked tree, the filter on the time reaches the listing of files, so older files are not read."""
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "a.py").write_text("def f():\n    pass\n")
    rows = code.walk(spark, f"file://{tmp_path}/tree").where("mtime >= timestamp '2030-01-01'")
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    try:
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(modificationTime" in plan and rows.count() == 0
