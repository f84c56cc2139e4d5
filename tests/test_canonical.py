"""Canonical JSON and digests of runs' material."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyrook.functions import canonical
from tallyrook.operators import extraction

_VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(10**30), 10**30) | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=("Cs",)), max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(st.characters(exclude_categories=("Cs",)), max_size=4), x, max_size=4), max_leaves=12)


def shuffled(x, rng):
    if isinstance(x, dict):
        items = [(k, shuffled(v, rng)) for k, v in x.items()]
        rng.shuffle(items)
        return dict(items)
    return [shuffled(y, rng) for y in x] if isinstance(x, list) else x


@settings(max_examples=200, deadline=None)
@given(_VALUES, st.integers(0, 9))
def test_order_and_spelling_do_not_matter(value, seed):
    one = canonical.canonical_text(json.dumps(value))
    other = canonical.canonical_text(json.dumps(shuffled(value, random.Random(seed)), indent=2, ensure_ascii=False))
    assert one == other == canonical.canonical_text(one)
    assert json.loads(one, parse_int=float) == json.loads(json.dumps(value), parse_int=float)


@pytest.mark.parametrize(
    ("text", "shown"),
    [("1.0", "1"), ("10e-1", "1"), ("-0", "0"), ("-0.0e5", "0"), ("0.000001", "0.000001"), ("1e-7", "1e-7"), ("1E+21", "1e21"), ("1e20", "1" + "0" * 20), ("12.5e40", "1.25e41"), ("0.1", "0.1"),
     ("12345678901234567890123456789012345.5", "1.23456789012345678901234567890123455e34"), ('"\\u0061\\/"', '"a/"'), ('{"b":1,"a":{"d":[2,1],"c":null}}', '{"a":{"c":null,"d":[2,1]},"b":1}')],
)
def test_canonical_text(text, shown):
    assert canonical.canonical_text(text) == shown


def test_columns(spark):
    rows = [(0, '{"x":[3,1,2],"y":[3,1]}'), (1, '{"a":1,"a":1}'), (2, "[1] 2"), (3, "NaN"), (4, '"\\ud800"'), (5, "[" * 200 + "]" * 200), (6, None), (7, ""), (8, "[" * 100_000), (9, "[1e99999999999999999999]"), (10, '{"n":' + "9" * 50_000 + "}")]
    found = spark.createDataFrame(rows, "i int, x string").select("i", canonical.canonical(F.col("x"), ("x",)).alias("t")).select("i", "t.*").collect()
    told = {i: (j, code) for i, j, code in found}
    assert told[0] == ('{"x":[1,2,3],"y":[3,1]}', None)
    assert [told[i][1] for i in range(1, 10)] == ["repeated_key", "not_json", "number", "surrogate", "too_deep", None, "not_json", "too_deep", "number"]
    assert told[6] == (None, None)
    assert told[10] == ('{"n":9.' + "9" * 49_999 + "e49999}", None)


def test_run_digests(spark):
    a = [("r", "facts", '{"a":1,"b":[1,2]}'), ("r", "facts", '{"a":2}'), ("r", "run", "1")]
    b = [("s", "run", "1.0"), ("s", "facts", '{"a":2e0}'), ("s", "facts", ' {"b":[2,1],"a":1}')]
    c = [("t", *x[1:]) for x in a] + [("t", "facts", '{"a":2}')]
    d = [("u", "facts", '{"a":1,"b":[1,2]}'), ("u", "run", '{"a":2}'), ("u", "run", "1")]
    bad = [("v", "run", "1"), ("v", "run", "{"), ("w", "run", None)]
    found = {r.run: r for r in extraction.run_digests(spark.createDataFrame(a + b + c + d + bad, "run string, section string, json string"), ("b",)).collect()}
    assert found["r"].digest == found["s"].digest
    assert len({found[k].digest for k in "rtu"}) == 3
    assert (found["v"].digest, found["v"].reject, found["w"].reject, found["t"].parts) == (None, "not_json", "missing", 4)
    alone = extraction.run_digests(spark.createDataFrame(a, "run string, section string, json string"), ("b",)).collect()
    assert alone[0].digest == found["r"].digest, "a digest does not depend on what else the table holds"
    assert extraction.run_digests(spark.createDataFrame([], "run string, section string, json string")).count() == 0
