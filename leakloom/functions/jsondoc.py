"""Typed fields of a JSON document, by their paths: what stands elsewhere may be of any type."""

from __future__ import annotations

import json

from .yamldoc import Unfit

#: As a name of a shape: any name, so a map of values of one shape.
ANY = "*"


def _refuse(word: str):
    raise Unfit(f"{word} is no JSON")


def fields(text: str, shape):
    """The document in a shape: `str` for a text, `[shape]` for a list, `{name: shape}` for an object of which only these names are read, `{ANY: shape}` for a map.

    Null, and what is missing, is an empty text, list or object. A name matches in its own case or else in any; of equal
    ones the last counts. A value of another kind than its shape is Unfit; names that aren't read may hold anything.
    """
    try:
        return _read(json.loads(text, parse_int=lambda _: 0, parse_float=lambda _: 0.0, parse_constant=_refuse), shape)
    except (ValueError, RecursionError) as e:
        raise Unfit(str(e)[:200]) from e


def _read(value, shape):
    if value is None:
        return "" if shape is str else type(shape)()
    if not isinstance(value, str if shape is str else type(shape)):
        raise Unfit("another type")
    if shape is str:
        return _sound(value)
    if isinstance(shape, list):
        return [_read(x, shape[0]) for x in value]
    if ANY in shape:
        return {_sound(k): _read(v, shape[ANY]) for k, v in value.items()}
    folded = {name.lower(): name for name in shape}
    out = {}
    for k, v in value.items():
        name = k if k in shape else folded.get(k.lower())
        if name:
            out[name] = _read(v, shape[name])
    return out


def _sound(text: str) -> str:
    """Halves of surrogate pairs, which no encoding has, become U+FFFD."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if not text.isascii() else text
