"""Decontamination, chat formatting and license scans against brute force, with odd rows."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyrook.llm import chat_template as ct
from tallyrook.llm import decontaminate, licenses, registry
from tallyrook.llm import words as w

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", " ", "\n\n", "MIT license", "a" * 3000, "é" * 5, "x y " * 700, "mit  License, Mit license!", "under the Apache License"]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def docs_frame(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "clash", -1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, score double")


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_words_in_slices(monkeypatch, size):
    monkeypatch.setattr(w, "SLICE", size)
    texts = [*ODD, "one two\tthree", "z" * 100 + " end", "last"]
    found = w.split(pa.array(texts), w.ALNUM, lower=True)
    expect = [ALNUM.findall(lower(t)) for t in texts]
    assert np.diff(found.first).tolist() == [len(x) for x in expect]
    flat = [x for ws in expect for x in ws]
    by_hash = {}
    for h, x in zip(found.hash.tolist(), flat, strict=True):
        assert by_hash.setdefault(h, x) == x
    assert len(by_hash) == len(set(flat))
    assert [lower(found.text(i).decode()) for i in range(len(flat))] == flat
    h, inside = w.windows(found, 3)
    rows = found.rows()
    assert [bool(x) for x in inside] == [rows[i] == rows[i + 2] for i in range(len(rows) - 2)]


def contamination(texts, items):
    out = []
    windows = []
    for item, text in items:
        ws = ALNUM.findall(lower(text))
        windows += [(str(item), tuple(ws[s : s + 10])) for s in range(max(1, len(ws) - 9))] if ws else []
    for i, text in enumerate(texts):
        ws, hit, own = ALNUM.findall(lower(text)), set(), set()
        for item, win in windows:
            for s in range(len(ws) - len(win) + 1):
                if tuple(ws[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    own.add(item)
        out.append((i, len(ws), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return out


def test_items_that_share_a_window(spark, monkeypatch):
    """A window is one, however many items have it, and whatever parts their list is dealt in."""
    window = " ".join(f"b{i}" for i in range(10))
    items = spark.createDataFrame([(i, window if i % 2 else f"{window} and {i}") for i in range(200)] + [(None, window)], "item_id long, text string")
    held, size = decontaminate._distinct(decontaminate.benchmark_windows(items))
    assert held.filter(F.size("items") > 150).count() == 1 and size == held.count() + (101 + 300) // decontaminate.ITEMS
    docs = spark.createDataFrame([(i, f"x{i} {window} z") for i in range(20)] + [(20, None)], "doc_id long, text string")
    for listed in (decontaminate.LISTED, 50):
        monkeypatch.setattr(decontaminate, "LISTED", listed)
        for block in (20, decontaminate.BLOCK):
            found = decontaminate.find_overlaps(docs, items, block).collect()
            assert all(r["items"] == sorted(map(str, range(200))) and r.spans == [1, 11] for r in found if r.doc_id < 20)
            assert next(r["items"] for r in found if r.doc_id == 20) == []


@pytest.mark.parametrize("block", [3, decontaminate.BLOCK])
def test_contamination(spark, block):
    long = [f"w{i}" for i in range(25)]
    items = [(1, " ".join(long)), (2, "Short one"), (10, "solo"), (3, None), (4, ""), (5, "short ONE"), (6, " ".join(long[5:20]))]
    texts = [*ODD, " ".join(long), "x " + " ".join(long[3:14]) + " y", "solo, short one solo", " ".join(long[:9]), "short one " + " ".join(long[10:22]), "short\none"]
    found = decontaminate.find_overlaps(docs_frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"), block)
    assert {"lang", "source", "score"} <= set(found.columns)
    rows = sorted((r.doc_id, r.n_words, sum(r.spans[1::2]) - sum(r.spans[::2]), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r.spans)) for r in found.collect())
    assert rows == contamination(texts, items)
    kept = decontaminate.remove_contaminated(docs_frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in rows if not r[5]]


def test_contamination_empty(spark):
    docs, none = docs_frame(spark, ODD), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination_digests(docs, none).filter("contaminated").count() == 0
    assert decontaminate.contamination_digests(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("name", ["op3_decontamination", "op4_chat_format", "op9_license_scan"])
def test_sql(spark, sf_dir, oracle, name):
    found = registry.QUERIES[name](spark, sf_dir)
    assert sorted(map(tuple, found.collect()), key=repr) == oracle(registry.ORACLE_SQL[name], sf_dir, found.columns)


def test_template_language():
    source = "{% set a = 1 + 2 %}{{ 'x' ~ 2 }}{% if 1 == 2 %}no{% elif 'a' in 'cat' and not false %}yes{% else %}no{% endif %}{{ a }}{{ m['k'].z }}{{ ' b ' | trim | upper }}{% for i in xs %}{{ loop.index }}{{ i }}{% if loop.first %}!{% endif %}{% endfor %}"
    out = "".join(x for x, _ in ct.compile_template(source)(m={"k": {"z": "q"}}, xs=["u", "v"]))
    assert out == "x2yes3qB1u!2v"
    assert ct.fold(ct.parse("a{{ 'b' }}{% if true %}c{% endif %}")) == (ct.Text("abc"),)
    for bad in ("{{ _x }}", "{{ a._b }}", "{% if %}", "{% for x in y %}", "{{ a | nope }}", "{% endif %}", "{{ a b }}", "{{ ~ }}"):
        with pytest.raises(ct.TemplateError):
            ct.compile_template(bad)
    assert "".join(x for x, _ in ct.compile_template("{{ m.__class__x }}".replace("__class__x", "upper"))(m="text")) == ""


def test_conversations(spark):
    texts = ["", "a\\<|end|>\\", "<|end|", "|>", "[INST][/INST]</s>", "\\\\", "<\\|turn|>", "é\n", None]
    rows = [(i % 3 if i % 4 else None, i // 3 % 2, r, t) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", None, "<|text|>") for t in texts)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in ct.conversation_digests(frame).collect()}
    groups = {}
    for c, turn, role, text in rows:
        groups.setdefault(c, []).append((turn, role or "", text or ""))
    assert set(found) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert found[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (found[c].n_turns, found[c].loss_chars, found[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    joined = {}
    for r in sorted(ct.format_conversations(frame).collect(), key=lambda r: (r.conv_id is not None, r.conv_id, r.piece)):
        joined[r.conv_id] = joined.get(r.conv_id, "") + r.text
    assert {c: len(x) for c, x in joined.items()} == {c: found[c].formatted_chars for c in found}
    assert all(ct.unescape(ct.escape(t or "")) == (t or "") for t in texts)
    assert ct.conversation_digests(frame.limit(0)).count() == 0


def accepts(words, at, pattern):
    """Longest end by trying everything; pattern: words, ('opt', pattern) and ('var', n)."""
    ends = {at}
    for p in pattern:
        if isinstance(p, str):
            ends = {e + 1 for e in ends if e < len(words) and words[e] == p}
        elif p[0] == "opt":
            more = set()
            for e in ends:
                more |= accepts(words, e, p[1])
            ends |= more
        else:
            ends = {e + k for e in ends for k in range(p[1] + 1) if e + k <= len(words)}
    return ends


def test_automaton():
    a = licenses.Automaton("<<beginOptional>>a <<beginOptional>>b<<endOptional>><<endOptional>> c <<var;max=2>> d")
    pattern = [("opt", ["a", ("opt", ["b"])]), "c", ("var", 2), "d"]
    rng = np.random.default_rng(3)
    for _ in range(300):
        words = rng.choice(list("abcdx"), rng.integers(0, 9)).tolist()
        hashes = [licenses._hashes(x)[0] for x in words]
        for at in range(len(words)):
            assert a.match(hashes, at) == max(accepts(words, at, pattern), default=-1)
    for bad in ("<<beginOptional>> a", "a <<endOptional>>", "<<var;max=2>>"):
        with pytest.raises(ValueError):
            licenses.Automaton(bad)


def test_licenses(spark):
    texts = [*ODD, "Released under the MIT License.", "x Licensed under the Apache License, Version 2.0. y", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "licensed under the apache license version 3", "mit. license", "Copyright 2020 Someone. All rights reserved"]
    found = {r.doc_id: r for r in licenses.license_digests(docs_frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        ws = ALNUM.findall(lower(text))
        places = sorted((s, label) for phrase, label in licenses.BASE for s in range(len(ws)) if ws[s : s + len(phrase.split())] == phrase.split())
        r = found[i]
        assert (r.n_words, r.n_base) == (len(ws), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert [found[i].labels for i in range(len(ODD), len(texts))] == ["mit,mit-notice", "apache,apache-2.0", "gpl,gpl-3.0", "cc-by-nc-4.0", "apache", "mit", "reserved"]
    assert licenses.license_digests(docs_frame(spark, ODD).limit(0)).count() == 0
