"""Discovery against git, which reads the same rules, and against literal trees."""

import os
import random
import shutil
import subprocess

import pytest

from tallyrook.sources import discovery

SCHEMA = "path string, kind string, text string"
TREE = {
    ".gitignore": "*.htm\n# note\n/top\nb?ild/\n!keep.htm\ndeep/**/x.md\n**/gone/*\nlog[0-9].md\n\\!odd.md\n\\#odd.md\nsp\\ ace.md  \nbad[.md\nx-y.md\r\nq[!ab].md\n",
    "a/.gitignore": "!*.htm\n/only.md\nsub/two.md\n*.md/\nc/**\n!c/back.md\n",
    "a/b/.gitignore": "*\n!*/\n!yes.md\n",
}
FILES = ["top/x.md", "s/top/x.md", "x.htm", "keep.htm", "a/x.htm", "build/keep.htm", "s/bxild/x.md", "s/build", "deep/x.md", "deep/1/2/x.md", "s/deep/x.md", "s/gone/x.md", "gone/r/x.md", "log1.md", "s/logx.md", "!odd.md", "#odd.md",
         "sp ace.md", "bad[.md", "z.md", "qa.md", "qc.md", "x-y.md", "a/only.md", "a/s/only.md", "a/sub/two.md", "a/s/sub/two.md", "a/d.md/x.md", "a/e.md", "a/c/back.md", "a/c/d/back.md", "a/b/no.md", "a/b/yes.md", "a/b/t/yes.md", "a/b/t/no.md", "ä/ö.md", "a+(b)/[x]{1}.md", "x/y.tar.md"]


def written(folder, files):
    for path, text in files.items():
        os.makedirs(os.path.dirname(f"{folder}/{path}"), exist_ok=True)
        with open(f"{folder}/{path}", "w", newline="") as file:
            file.write(text)


def by_git(folder):
    subprocess.run(["git", "init", "-q", folder], check=True)
    out = subprocess.run(["git", "-c", "core.quotePath=false", "-c", "core.excludesFile=/dev/null", "-C", folder, "ls-files", "-z", "-o", "--exclude-standard"], check=True, capture_output=True).stdout.decode()
    return sorted(x for x in out.split("\0") if x and not any(y.startswith(".") for y in x.split("/")))


def found(spark, entries, **options):
    rows = discovery.discovered(entries, **options).collect()
    kept = sorted((r for r in rows if r.verdict == "found"), key=lambda r: r.n)
    assert [r.n for r in kept] == list(range(len(kept))) and all(r.n is None for r in rows if r.verdict != "found")
    assert [r.path for r in kept] == sorted((r.path for r in kept), key=str.encode)
    return [r.path for r in kept], {r.path: r.verdict for r in rows}


@pytest.mark.skipif(shutil.which("git") is None, reason="needs git")
def test_against_git(spark, tmp_path):
    written(tmp_path, TREE | dict.fromkeys(FILES, ""))
    entries = discovery.listed(spark, str(tmp_path))
    paths, _ = found(spark, entries, suffixes=("md", "htm", ""))
    assert paths == by_git(str(tmp_path))


@pytest.mark.skipif(shutil.which("git") is None, reason="needs git")
def test_random_rules_against_git(spark, tmp_path):
    rng = random.Random(5)
    names = ["a", "b", "ab", "ba.md", "a.md", "b.md"]
    globs = ["a", "*", "*.md", "/a", "b/", "a/b", "**/b", "a/**", "a/**/b.md", "?", "[ab]", "[!a].md", "a*", "*/a.md", "/*/b", "ab/*", "**", "b/**/", "***", "a**b", "ab/*", "a?", "*/"]
    for folder in range(3):
        at = tmp_path / str(folder)
        tree = {}
        for _ in range(60):
            tree["/".join(rng.choice(names[:3]) for _ in range(rng.randrange(4))).strip("/") + f"/{rng.choice(names[3:])}"] = ""
        tree = {k.lstrip("/"): v for k, v in tree.items()}
        for where in {"", *(os.path.dirname(x) for x in rng.sample(sorted(tree), 3))}:
            tree[f"{where}/.gitignore".lstrip("/")] = "\n".join(rng.choice(["", "", "!"]) + rng.choice(globs) for _ in range(4))
        written(at, tree)
        entries = spark.createDataFrame([(k, "file", v) for k, v in tree.items()], SCHEMA)
        assert found(spark, entries)[0] == by_git(str(at)), tree


def test_malformed_lines_are_no_rules():
    assert [discovery.rule(x) for x in ("[z-a].md", "[ab", "a\\", "", "  ", "#x", "/", "!", "!/")] == [None] * 9
    assert discovery.rule("\\ ") == discovery.rule("\\ \r") == ("(?:.*/)?\\ \\x00?", False)


def test_verdicts(spark):
    rows = [
        (".ignore", "file", "*.html\n!.shown.md"), ("a/.gitignore", "file", "!*.html\nx.md"), ("a/p.html", "file", None), ("a/x.md", "file", None), (".shown.md", "file", None), (".h.md", "file", None), (".d/x.md", "file", None),
        ("../x.md", "file", None), ("/x.md", "file", None), ("a//x.md", "file", None), ("a/./x.md", "file", None), ("", "file", None), (None, "file", None), (None, None, None), ("a/x\0.md", "file", None),
        ("ln", "link", None), ("ln/x.md", "file", None), ("l.md", "link", None), ("l.md", "file", None), ("m.md", "file", None), ("m.md", "file", "again"), ("N.MD", "file", None), ("md", "file", None), ("e.txt", "file", None), ("r/s/x.md", "file", None),
        ("rep/.git/HEAD", "file", None), (".gitignore", "file", "y.md"), ("rep/y.md", "file", None), ("y.md", "file", None), ("rep/p.html", "file", None), ("q/y.md", "file", None), (".git/info/exclude", "file", "z.md\n!y.md"), ("z.md", "file", None), ("d.md", "dir", None),
    ]
    entries = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", verdict string")
    paths, told = found(spark, entries, reserved=("r/s",))
    assert paths == [".shown.md", "N.MD", "m.md", "rep/y.md"]
    assert told | {".h.md": "hidden", ".d/x.md": "pruned", "../x.md": "unsafe_path", "/x.md": "unsafe_path", "a//x.md": "unsafe_path", "a/./x.md": "unsafe_path", "": "unsafe_path", None: "unsafe_path", "a/x\0.md": "unsafe_path", "ln": "link", "ln/x.md": "pruned",
                   "l.md": "link", "md": "unsupported", "e.txt": "unsupported", "r/s/x.md": "reserved", "y.md": "ignored", "q/y.md": "ignored", "rep/p.html": "ignored", "a/p.html": "ignored", "a/x.md": "ignored", "z.md": "ignored", "rep/.git/HEAD": "pruned"} == told
    assert "d.md" not in told


def test_links_and_limits(spark, tmp_path):
    written(tmp_path, {"a/x.md": "", "b.md": ""})
    os.symlink(tmp_path / "a", tmp_path / "c")
    os.symlink(tmp_path / "b.md", tmp_path / "d.md")
    told = discovery.discovered(discovery.listed(spark, str(tmp_path)))
    assert sorted((r.path, r.verdict) for r in told.collect()) == [("a/x.md", "found"), ("b.md", "found"), ("c", "link"), ("d.md", "link")]
    assert [r.refused for r in discovery.limited(told, 2).select("refused").distinct().collect()] == [False]
    assert [r.refused for r in discovery.limited(told, 1).select("refused").distinct().collect()] == [True]
    assert discovery.discovered(spark.createDataFrame([], SCHEMA)).count() == 0
