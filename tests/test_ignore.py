"""Ignore files: patterns, and whole trees against a walk in plain Python."""

import random
import re

import pytest

from quarry.sources.ignore import compile_rule, unignored


@pytest.mark.parametrize(
    "line,hits,misses",
    [
        ("*.log", ["a.log", "x/y/b.log"], ["a.logs", "log"]),
        ("/build", ["build"], ["x/build"]),
        ("a/b", ["a/b"], ["x/a/b"]),
        ("**/tmp", ["tmp", "x/tmp", "x/y/tmp"], ["tmpx"]),
        ("a/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["b", "xa/b"]),
        ("a/**", ["a/x", "a/x/y"], ["a"]),
        ("f?o[0-9].[!a]", ["fxo1.b", "q/foo2.c"], ["foo1.a", "f/o1.b"]),
        ("\\#x", ["#x"], ["x"]),
        ("\\!x", ["!x"], ["x"]),
        ("a.b+c", ["a.b+c"], ["axb+c", "a.bbc"]),
    ],
)
def test_patterns(line, hits, misses):
    regex, negated, folders = compile_rule(line)
    assert not negated and not folders
    assert all(re.search(regex, h) for h in hits) and not any(re.search(regex, m) for m in misses)


def test_odd_lines():
    assert [compile_rule(x) for x in ("", "  ", "# note", "/", "!")] == [None] * 5
    assert compile_rule("!keep/ ")[1:] == (True, True) and compile_rule("a\\ ")[0].endswith("\\ $")


def walked(paths, files):
    known = {folder: [r for r in map(compile_rule, content.split("\n")) if r] for folder, content in files}

    def out(place, is_folder):
        verdict, steps = False, place.split("/")
        for k in range(len(steps)):
            folder = "/".join(steps[:k])
            for regex, negated, folders in known.get(folder, ()):
                if (is_folder or not folders) and re.search(regex, "/".join(steps[k:])):
                    verdict = not negated
        return verdict

    def kept(path):
        steps = path.split("/")
        return not any(out("/".join(steps[:k]), k < len(steps)) for k in range(1, len(steps) + 1))

    return sorted(p for p in paths if kept(p))


def test_trees_equal_a_walk(spark):
    rng = random.Random(6)
    names = ["a", "b", "src", ".hid", "x.py", "y.py", "z.log", "build"]
    paths = sorted({"/".join(rng.choice(names[:4] + names[7:]) for _ in range(rng.randint(0, 4))) + "/" + rng.choice(names[4:7]) for _ in range(250)})
    paths = [p.lstrip("/") for p in paths]
    lines = ["*.log", "!z.log", "build/", "/a", "a/b", "**/src/x.py", "!x.py", ".hid", "!.hid/", "b/**", "# no", ""]
    files = [(f, "\n".join(rng.sample(lines, 3))) for f in ("", "a", "src", "a/b", "b/src", ".hid")]
    frame = spark.createDataFrame([(p, k) for k, p in enumerate(paths)] + [(None, -1)], "path string, k int")
    got = unignored(frame, spark.createDataFrame(files, "folder string, content string"))
    assert sorted(r.path for r in got.collect()) == walked(paths, files) and 0 < got.count() < len(paths)
    assert unignored(frame, spark.createDataFrame([], "folder string, content string")).count() == len(paths)
