"""Typed fields of a YAML document, read from parser events.

The reader keeps its own stack, so a document of any depth up to MAX_DEPTH is read without recursion, and a deeper one is
refused. Scalars stay texts as they are written: a number, a date or `true` in a field of text is that text.
"""

from __future__ import annotations

import base64
import binascii
import re

#: Beyond this many open collections a document is refused.
MAX_DEPTH = 10_000
_NULLS = {"", "~", "null", "Null", "NULL"}
_TAG = "tag:yaml.org,2002:"


class Unfit(Exception):
    """The document is no YAML, too deep, or has another type in a field that is read."""


class Scalar:
    __slots__ = ("plain", "tag", "value")

    def __init__(self, value: str, plain: bool, tag: str | None) -> None:
        self.value, self.plain, self.tag = value, plain, tag

    def is_null(self) -> bool:
        return self.tag == f"{_TAG}null" or self.tag is None and self.plain and self.value in _NULLS

    def text(self) -> str:
        if self.is_null():
            return ""
        if self.tag == f"{_TAG}binary":
            try:
                return base64.b64decode("".join(self.value.split()), validate=True).decode("utf-8", "replace")
            except binascii.Error as e:
                raise Unfit("no base64") from e
        return self.value


#: A run of so many opening brackets is read on its own: the scanner looks at every open collection for each token.
_RUN = re.compile(r"\[{64,}")


def first_document(text: str):
    """The first document: a Scalar, a list of nodes, a tuple of pairs of nodes for a mapping, or None if there is none. What follows it isn't read."""
    runs: dict[int, tuple] = {}
    cut, at = text, 0
    while run := _RUN.search(cut, at):
        start, n = run.span()[0], len(run[0])
        at = start + n
        try:
            inner, end, depth = _parsed("[" + cut[at:], whole=False)
        except Unfit:
            if not {"*", "!"} & set(cut[at:]) and _opens(cut[: start + 1], start, runs):
                raise
            continue
        end += at - 1
        # The closing brackets from the innermost on; they close what the run has opened.
        closed = end - 1 + n
        if cut[end - 1 : closed] != "]" * n or "&" in cut[at:end] or "*" in cut[at:end] or "!" in cut[at:end] or text.startswith("\ufeff"):
            continue
        node = inner
        for _ in range(n - 2):
            node = [node]
        runs[start] = (node, closed, n + depth - 1)
        # As many characters in as many lines, so that every other place stays.
        cut = cut[: start + 1] + '"' + _BUT_BREAKS.sub("x", cut[start + 2 : closed - 2]) + '"]' + cut[closed:]
        at = closed
    if runs:
        try:
            root = _parsed(cut, runs)[0]
            if not runs:
                return root
        except _Other:
            pass
        except Unfit:
            if not runs:
                raise
    return _parsed(text)[0]


_BUT_BREAKS = re.compile("[^\r\n\x85\u2028\u2029]")


class _Other(Exception):
    """A run of brackets isn't where a list begins."""


def _opens(text: str, at: int, runs: dict[int, tuple]) -> bool:
    """Whether the bracket that is the last character of a text opens a list."""
    seen: list[int] = []
    try:
        _parsed(text, dict(runs), seen=seen)
    except (Unfit, _Other):
        pass
    return at in seen


def _parsed(text: str, runs: dict[int, tuple] | None = None, whole: bool = True, seen: list[int] | None = None) -> tuple:
    """The first document, or its first collection if it isn't asked for whole, where that ends, and the most collections open at a time.

    runs: by the place of a list, what its one scalar stands for, where the list ends, and how deep it is; each that is met is taken out.
    """
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)(text)
    anchors: dict[str, object] = {}
    open_: list[tuple[str | None, bool, list]] = []  # anchor, whether a mapping, children
    root, depth, stood = None, 0, None

    def put(node, anchor: str | None):
        if anchor:
            anchors[anchor] = node
        if open_:
            open_[-1][2].append(node)
        return node

    try:
        while True:
            event = loader.get_event()
            if event is None or isinstance(event, (yaml.DocumentEndEvent, yaml.StreamEndEvent)):
                return root, 0, depth
            if stood:
                if not isinstance(event, yaml.ScalarEvent) or event.end_mark.index != stood[1] - 1:
                    raise _Other
                root, stood = put(stood[0], None), None
            elif isinstance(event, (yaml.MappingStartEvent, yaml.SequenceStartEvent)):
                place = event.start_mark.index if isinstance(event, yaml.SequenceStartEvent) else -1
                if seen is not None:
                    seen.append(place)
                stood = runs.pop(place, None) if runs else None
                if len(open_) + (stood[2] if stood else 1) > MAX_DEPTH:
                    raise Unfit("too deep")
                open_.append((event.anchor, isinstance(event, yaml.MappingStartEvent), []))
                depth = max(depth, len(open_))
            elif isinstance(event, (yaml.MappingEndEvent, yaml.SequenceEndEvent)):
                anchor, mapping, children = open_.pop()
                root = put(tuple(zip(children[::2], children[1::2], strict=True)) if mapping else children, anchor)
                if not whole and not open_:
                    return root, event.end_mark.index, depth
            elif isinstance(event, yaml.ScalarEvent):
                root = put(Scalar(event.value, not event.style, event.tag if event.tag not in (None, "!") else None), event.anchor)
            elif isinstance(event, yaml.AliasEvent):
                if event.anchor not in anchors:
                    raise Unfit("unknown anchor")
                root = put(anchors[event.anchor], None)
    except (yaml.YAMLError, RecursionError, UnicodeError, ValueError) as e:
        raise Unfit(str(e)[:200]) from e
    finally:
        loader.dispose()


def fields(text: str, shape):
    """The document in a shape: `str` for a text, `[shape]` for a list, `{name: shape}` for a mapping of which only these names are read.

    Null, and what is missing, is an empty text, list or mapping. A name that a mapping has twice, a name that is no
    scalar, and a value of another kind than its shape are Unfit; names that aren't read may hold anything. `<<` merges
    a mapping or several, the first of them first, behind the mapping's own names.
    """
    return _read(first_document(text), shape)


def _read(node, shape):
    if node is None or isinstance(node, Scalar) and node.is_null():
        return "" if shape is str else type(shape)()
    if shape is str:
        if not isinstance(node, Scalar):
            raise Unfit("no text")
        return node.text()
    if isinstance(shape, list):
        if not isinstance(node, list):
            raise Unfit("no list")
        return [_read(x, shape[0]) for x in node]
    return {name: _read(value, shape[name]) for name, value in _named(node).items() if name in shape}


def _named(node) -> dict[str, object]:
    if not isinstance(node, tuple):
        raise Unfit("no mapping")
    own: dict[str, object] = {}
    merged = []
    for key, value in node:
        if not isinstance(key, Scalar):
            raise Unfit("a name that is no scalar")
        if key.plain and key.value == "<<":
            merged += value if isinstance(value, list) else [value]
        elif key.value in own:
            raise Unfit("a name twice")
        else:
            own[key.value] = value
    for other in merged:
        if not isinstance(other, tuple):
            raise Unfit("no mapping to merge")
        own = {**{k.value: v for k, v in other if isinstance(k, Scalar)}, **own}
    return own
