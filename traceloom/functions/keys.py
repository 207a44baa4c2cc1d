"""Computation keys: canonical forms of values, their digests, and column forms for flat arguments."""

from __future__ import annotations

import functools
import hashlib
import inspect
import json
import os
from collections.abc import Callable
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[Any], Any]


class UnknownKind(TypeError):
    """A value that no encoder knows; keys never fall back to a repr."""


class Encoders:
    """Turns values into trees of JSON primitives in which types stay apart. A type's encoder also serves its subclasses."""

    def __init__(self, extra: dict[type, Encoder] | None = None):
        self.by_type: dict[type, Encoder] = {os.PathLike: path_form, functools.partial: self.partial_form} | (extra or {})

    def register(self, kind: type, encode: Encoder) -> None:
        self.by_type[kind] = encode

    def form(self, value: Any, _inside: tuple[int, ...] = ()) -> Any:
        match value:
            case None | bool() | int() | float() | str():
                return value
            case bytes():
                return {"__bytes__": value.hex()}
        if id(value) in _inside:
            return {"__cycle__": True}
        inner = functools.partial(self.form, _inside=(*_inside, id(value)))
        match value:
            case dict():
                if odd := [k for k in value if not isinstance(k, str)]:
                    raise UnknownKind(f"a mapping in a key needs string keys, not {odd[0]!r}")
                return {"__dict__": {k: inner(value[k]) for k in sorted(value)}}
            case list():
                return {"__list__": [inner(v) for v in value]}
            case tuple():
                return {"__tuple__": [inner(v) for v in value]}
            case frozenset() | set():
                tag = "__set__" if isinstance(value, set) else "__frozenset__"
                return {tag: sorted(map(inner, value), key=lambda f: json.dumps(f, sort_keys=True))}
        for kind in type(value).__mro__:
            if kind in self.by_type:
                return self.by_type[kind](value)
        if isinstance(value, os.PathLike):
            return self.by_type[os.PathLike](value)
        if hasattr(value, "model_dump"):
            return {"__model__": f"{type(value).__module__}:{type(value).__qualname__}", "value": self.form(value.model_dump(mode="json"))}
        raise UnknownKind(f"no encoder for {type(value).__name__}; register one")

    def partial_form(self, value: functools.partial) -> Any:
        return {"__partial__": [fingerprint(value.func, self), self.form(value.args), self.form(value.keywords)]}

    def comp_id(self, identity: str, args: dict[str, Any]) -> str:
        text = json.dumps({"identity": identity, "args": self.form(args)}, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(text.encode()).hexdigest()


def path_form(path: os.PathLike) -> Any:
    """A file's name, size and time of change; its contents are not read."""
    try:
        at = Path(path).stat()
    except FileNotFoundError:
        return {"__path__": [str(path), "missing"]}
    except OSError as e:
        return {"__path__": [str(path), "unreadable", e.errno]}
    return {"__path__": [str(path), at.st_mtime_ns, at.st_size]}


def fingerprint(fn: Callable, encoders: Encoders | None = None, _seen: frozenset = frozenset()) -> str:
    """A digest of a function's code and of what it refers to: globals and closure, functions by their own digest.

    Made from the compiled code, so comments and layout do not count. Modules count by name and version, classes
    by name alone, values through the encoders, and what they do not know by its type.
    """
    encoders = encoders or Encoders()
    fn = inspect.unwrap(fn)
    code = getattr(fn, "__code__", None)
    if code is None or code in _seen:
        return f"{getattr(fn, '__module__', '')}:{getattr(fn, '__qualname__', type(fn).__qualname__)}"
    seen = _seen | {code}

    def one(value: Any) -> Any:
        if inspect.ismodule(value):
            return ["module", value.__name__, str(getattr(value, "__version__", ""))]
        if inspect.isclass(value):
            return ["class", value.__module__, value.__qualname__]
        if callable(value):
            return ["function", fingerprint(value, encoders, seen)]
        try:
            return ["value", encoders.form(value)]
        except TypeError:
            return ["opaque", type(value).__qualname__]

    def parts(c: Any) -> list:
        consts = [parts(k) if inspect.iscode(k) else repr(k) for k in c.co_consts if k != fn.__doc__]
        return [c.co_code.hex(), list(c.co_names), list(c.co_varnames), consts]

    closure = inspect.getclosurevars(fn)
    refs = {k: one(v) for k, v in sorted({**closure.globals, **closure.nonlocals}.items())}
    text = json.dumps([parts(code), refs, repr(fn.__defaults__), repr(fn.__kwdefaults__)], sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()


def _json_text(c: Column, kind: str) -> Column:
    """A column's JSON text as Python writes it, for kinds whose text is the same in both."""
    if kind in ("tinyint", "smallint", "int", "bigint", "boolean"):
        return F.coalesce(c.cast("string"), F.lit("null"))
    return F.coalesce(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"')), F.lit("null"))


_PLAIN = r"^[\x20-\x7E]*$"


def comp_id(df: DataFrame, identity: str, columns: list[str]) -> Column:
    """The computation key of a row's arguments, in expressions alone; for integers, booleans and plain ASCII text.

    Doubles and other kinds go through comp_id_udf: engines print them differently. Text outside printable ASCII
    raises, because its escapes differ too.
    """
    kinds = dict(df.dtypes)
    fields = []
    for name in sorted(columns):
        if kinds[name] not in ("tinyint", "smallint", "int", "bigint", "boolean", "string"):
            raise UnknownKind(f"{name} is {kinds[name]}; use comp_id_udf")
        c = F.col(name)
        text = _json_text(c, kinds[name])
        if kinds[name] == "string":
            text = F.when(c.isNull() | c.rlike(_PLAIN), text).otherwise(F.raise_error(F.lit(f"{name} is not plain text; use comp_id_udf")))
        fields += [F.lit(("," if fields else "") + json.dumps(name) + ":"), text]
    return F.sha2(F.concat(F.lit('{"args":{"__dict__":{'), *fields, F.lit('}},"identity":' + json.dumps(identity) + "}")), 256)


def comp_id_udf(identity: str, columns: list[str], encoders: Encoders | None = None) -> Column:
    """The same key for arguments of any kind, by the driver's encoder, in Arrow batches."""
    enc = encoders or Encoders()

    @F.pandas_udf("string")
    def keyed(rows: pd.DataFrame) -> pd.Series:
        plain = lambda v: v.item() if hasattr(v, "item") else v.tolist() if hasattr(v, "tolist") else v
        return pd.Series([enc.comp_id(identity, {c: plain(v) for c, v in zip(columns, row, strict=True)}) for row in rows[columns].itertuples(index=False)])

    return keyed(F.struct(*columns))


def short_hash(c: Column) -> Column:
    return F.substring(c, 1, 8)


def content_hash(payload: Column) -> Column:
    return F.sha2(payload, 256)


def file_fingerprint(df: DataFrame) -> DataFrame:
    """path, size, changed of each file that a file scan reads; contents are not."""
    m = F.col("_metadata")
    return df.select(m.file_path.alias("path"), m.file_size.alias("size"), m.file_modification_time.alias("changed")).distinct()
