import functools
import hashlib
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from traceloom.functions.codecs import Codecs, FunctionCodec
from traceloom.functions.keys import Encoders, UnknownKind, comp_id, comp_id_udf, fingerprint

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(), lambda v: st.lists(v) | st.dictionaries(st.text(), v), max_leaves=10)


@given(st.dictionaries(st.text(), VALUES))
def test_key_order_does_not_count(args):
    assert Encoders().comp_id("f", args) == Encoders().comp_id("f", dict(reversed(args.items())))


def test_layout_of_the_key():
    text = '{"args":{"__dict__":{"a":1,"b":"x"}},"identity":"f"}'
    assert Encoders().comp_id("f", {"b": "x", "a": 1}) == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(
    ("value", "form"),
    [
        (b"\x01", {"__bytes__": "01"}), ([1], {"__list__": [1]}), ((1,), {"__tuple__": [1]}), ({2, 1}, {"__set__": [1, 2]}),
        (frozenset("a"), {"__frozenset__": ["a"]}), ({"b": 1, "a": None}, {"__dict__": {"a": None, "b": 1}}),
    ],
)
def test_kinds_stay_apart(value, form):
    assert Encoders().form(value) == form


def test_cycles_paths_partials_and_strangers(tmp_path):
    e = Encoders()
    loop = [1]
    loop.append(loop)
    assert e.form(loop) == {"__list__": [1, {"__cycle__": True}]}
    shared = [1]
    assert e.form([shared, shared]) == {"__list__": [{"__list__": [1]}] * 2}
    f = tmp_path / "f"
    assert e.form(f)["__path__"][1] == "missing"
    f.write_text("x")
    before = e.form(f)
    f.write_text("xy")
    assert e.form(f) != before
    assert e.form(functools.partial(max, 1)) != e.form(functools.partial(max, 2))
    with pytest.raises(UnknownKind):
        e.form(object())
    with pytest.raises(UnknownKind):
        e.form({1: 2})
    e.register(complex, lambda c: [c.real, c.imag])
    assert e.form(1j) == [0.0, 1.0]


def test_fingerprints_follow_code_and_what_it_refers_to():
    def make(k, text):
        space = {"K": k}
        exec(text, space)
        return space["f"]

    one = fingerprint(make(1, "def f(x):\n    return x + K\n"))
    assert one == fingerprint(make(1, "def f(x):\n    # a note\n    return x + K\n"))
    assert one != fingerprint(make(2, "def f(x):\n    return x + K\n"))
    assert one != fingerprint(make(1, "def f(x):\n    return x - K\n"))

    def a(n):
        return b(n - 1) if n else 0

    def b(n):
        return a(n)

    assert fingerprint(a) == fingerprint(a)


def test_column_keys_equal_the_encoders(spark):
    rows = [(1, "x", True), (2, 'q"\\', False), (None, None, None)]
    df = spark.createDataFrame(rows, "n int, t string, b boolean")
    got = df.select(comp_id(df, "f", ["t", "n", "b"]).alias("k"), comp_id_udf("f", ["n", "t", "b"]).alias("u")).collect()
    want = [Encoders().comp_id("f", {"n": n, "t": t, "b": b}) for n, t, b in rows]
    assert [r["k"] for r in got] == want
    assert [r["u"] for r in got][:2] == want[:2]
    with pytest.raises(Exception, match="comp_id_udf"):
        spark.createDataFrame([("é",)], "t string").select(comp_id(spark.createDataFrame([], "t string"), "f", ["t"])).collect()
    with pytest.raises(UnknownKind):
        comp_id(spark.createDataFrame([], "d double"), "f", ["d"])


class Point:
    def __init__(self, x):
        self.x = x


def test_codecs_round_trip():
    c = Codecs()
    c.register(Point, FunctionCodec(lambda p: p.x, Point))
    value = {"a": (1, [2, None]), "b": b"\xff", "p": Point(3)}
    text, digest = c.payload(value)
    back = c.load(text)
    assert back["a"] == (1, [2, None]) and back["b"] == b"\xff" and back["p"].x == 3
    assert digest == hashlib.sha256(text.encode()).hexdigest()
    with pytest.raises(TypeError):
        Codecs().load(text)
    with pytest.raises(TypeError):
        Codecs().payload(object())
    with pytest.raises(TypeError):
        Codecs().payload({1: 2})
    assert json.loads(Codecs().payload([1])[0]) == {"result": [1]}
