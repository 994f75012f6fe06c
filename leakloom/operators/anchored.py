"""Matches of patterns that begin with one of some literals: these are looked for in Arrow batches, and a pattern only runs where one stands.

A pattern's own search looks at each character of a text, for each pattern anew.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.regexport import CI


class Anchored(NamedTuple):
    """A rule: a pattern, the literals of two characters or more that a match begins with, and those of which a match holds one; the group to take, or what to put in and its label."""

    pattern: str
    starts: tuple[str, ...]
    gate: tuple[str, ...]
    group: int = 0
    to: str = ""
    label: str = ""


def python_pattern(pattern: str) -> str:
    """A Java pattern as Python's re has it, where both mean the same but for the end of the text and flags within."""
    head, flag, rest = pattern.replace("\\z", "\\Z").replace("(?iu:", "(?i:").partition(CI)
    return f"{head}(?i:{rest})" if flag else head


class Text:
    """A text, with other letters for the two that Python's re takes for an i and RE2 doesn't (plain), and that in lower case (low), each character in its place."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def plain(self) -> str:
        return self.text if self.text.isascii() else self.text.replace("\u0130", "\u00e9").replace("\u0131", "\u00e9")

    @cached_property
    def low(self) -> str:
        low = self.plain.lower()
        return low if low.isascii() else low.replace("\u017f", "s")


class Finder:
    def __init__(self, rule: Anchored):
        pattern = python_pattern(rule.pattern)
        self.match, self.folds, self.any_case = re.compile(pattern).match, "(?i:" in pattern, CI in rule.pattern
        self.starts = tuple(x.lower() for x in rule.starts) if self.any_case else rule.starts
        # Starts with a common end, such as ://, are looked for by that.
        common = os.path.commonprefix([x[::-1] for x in self.starts])[::-1]
        self.ends = common if len(self.starts) > 1 and len(common) > 2 else ""
        self.before = tuple({len(x) - len(common) for x in self.starts})
        self.low = self.any_case and (self.ends or "".join(self.starts)) != (self.ends or "".join(self.starts)).upper()
        self.gate = () if self.any_case or set(rule.gate) == set(rule.starts) else rule.gate
        self.group, self.to = rule.group, [int(x) if i % 2 else x for i, x in enumerate(re.split(r"\$([0-9])", rule.to))]

    def places(self, t: Text) -> Iterable[int]:
        """Where a match may begin, in order."""
        seen = t.low if self.low else t.text
        if self.gate and not any(x in seen for x in self.gate):
            return ()
        if self.ends:
            return sorted({at - n for at in _places(seen, self.ends) for n in self.before if at >= n})
        return _places(seen, self.starts[0]) if len(self.starts) == 1 else sorted({at for x in self.starts for at in _places(seen, x)})

    def matches(self, t: Text, places: Iterable[int]) -> Iterator[re.Match]:
        """As a search from left to right finds them, each behind the one before. Their places count, not their texts."""
        within, match, end = t.plain if self.folds else t.text, self.match, 0
        for at in places:
            if at >= end and (found := match(within, at)):
                end = found.end()
                yield found


def _places(text: str, literal: str) -> Iterator[int]:
    at = text.find(literal)
    while at >= 0:
        yield at
        at = text.find(literal, at + 1)


#: Bytes of texts that are worked on at once, if it isn't one longer text: as Python's objects they take several times the space.
CHUNK = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters that equal ASCII ones in any case.
_FOLDED = ("\u017f", "\u212a")


class Literals:
    """A tree of the starts of all finders, that all places of many texts go down at once. In any case: what has another case is no match later."""

    def __init__(self, finders: list[Finder]):
        nodes, ends = [{}], [[]]
        for k, f in enumerate(finders):
            for x in f.starts:
                at = 0
                for b in x.lower().encode():
                    if b not in nodes[at]:
                        nodes[at][b] = len(nodes)
                        nodes.append({})
                        ends.append([])
                    at = nodes[at][b]
                if k not in ends[at]:
                    ends[at].append(k)
        self.next = np.zeros((len(nodes), 256), np.int32)
        for i, kids in enumerate(nodes):
            for b, kid in kids.items():
                self.next[i, b] = kid
        self.next = self.next[:, _LOWER]
        # Two bytes at a time for the first step; one-byte starts would need a step of their own.
        self.pairs = self.next[self.next[0]].reshape(-1)
        self.pairs[np.repeat(self.next[0] == 0, 256)] = 0
        self.begins = self.pairs > 0
        self.first = np.array([len(e) for e in ends], np.int32)
        self.rules = np.array([k for e in ends for k in e], np.int32)
        self.base = np.cumsum(self.first) - self.first

    def places(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each place of bytes where a start stands, and the number of a finder that has it."""
        if len(data) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        pair = data[:-1].astype(np.uint16)
        pair <<= 8
        pair |= data[1:]
        at = np.flatnonzero(self.begins[pair])
        node, out, depth = self.pairs[pair[at]], [], 2
        while len(at):
            ends = self.first[node]
            some = ends > 0
            if some.any():
                n, base, where = ends[some], self.base[node[some]], at[some]
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                out.append((np.repeat(where, n), self.rules[np.repeat(base, n) + nth]))
            inside = at + depth < len(data)
            at, node = at[inside], node[inside]
            node = self.next[node, data[at + depth]]
            at, node, depth = at[node > 0], node[node > 0], depth + 1
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate([x for x, _ in out]), np.concatenate([k for _, k in out])


def _decoded(text: bytes | None) -> tuple[str | None, bool]:
    """A text, and whether it is sound UTF-8; what isn't becomes replacement characters, as in Java."""
    try:
        return None if text is None else text.decode(), True
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace"), False


def _in_chunks(texts: pa.Array, of: Callable[[pa.Array, np.ndarray], pa.Array]) -> pa.Array:
    """of some of the texts (bytes) and where each begins in them, one chunk after the other."""
    texts = texts.cast(pa.large_binary())
    offsets, row, done = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64), 0, []
    while not done or row < len(texts):
        last = min(len(texts), max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1))
        done.append(of(texts[row:last], offsets[row : last + 1]))
        row = last
    return pa.concat_arrays(done)


def _placed(texts: pa.Array, offsets: np.ndarray, finders: list[Finder], literals: Literals) -> Iterator[tuple[str | None, list[tuple[int, list[int]]] | None]]:
    """Each text with the numbers of the finders of which a start stands in it and the places, in order; None where these have to be looked for one by one."""
    start, data = offsets - offsets[0], np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    at, rule = literals.places(data)
    # Sorted as one number: text and finder, then place; texts of a chunk are under 2^31 bytes, or one text that is.
    order = np.sort((((np.searchsorted(start, at, "right") - 1) * len(finders) + rule) << 32) | at)
    at, order = order & 0xFFFFFFFF, order >> 32
    of = order // len(finders)
    chars = at - start[of]
    if len(at) and (wide := data >= 0x80).any():
        # Characters, not bytes.
        wide &= data < 0xC0
        wide = np.cumsum(wide, dtype=np.int32)
        chars -= wide[at] - wide[start[of]]
    chars = chars.tolist()
    new = np.flatnonzero(np.diff(order, prepend=-1))
    rules, ends, rows = (order[new] % len(finders)).tolist(), [*new[1:].tolist(), len(at)], np.searchsorted(of[new], np.arange(len(texts) + 1)).tolist()
    new = new.tolist()
    for i, (s, sound) in enumerate(map(_decoded, texts.to_pylist())):
        if s is not None and not (sound and (s.isascii() or not any(x in s for x in _FOLDED))):
            yield s, None
        else:
            yield s, [(rules[g], chars[new[g] : ends[g]]) for g in range(rows[i], rows[i + 1])]


def found(text: Column, rules: Iterable[Anchored]) -> Column:
    """For each rule an array of what its group takes in a text, in order; an empty array for a null text."""
    rules = tuple(rules)

    @F.arrow_udf("array<array<string>>")
    def find(texts: pa.Array) -> pa.Array:
        finders = [Finder(r) for r in rules]
        literals = Literals(finders)

        def of(chunk: pa.Array, offsets: np.ndarray) -> pa.Array:
            of_text, of_rule, values = [0], [0], []
            for s, places in _placed(chunk, offsets, finders, literals):
                if s is not None:
                    t, have = Text(s), 0
                    for k, at in places if places is not None else ((k, f.places(t)) for k, f in enumerate(finders)):
                        of_rule += [len(values)] * (k - have)
                        have, f = k + 1, finders[k]
                        values += [s[slice(*m.span(f.group))] for m in f.matches(t, at)]
                        of_rule.append(len(values))
                    of_rule += [len(values)] * (len(finders) - have)
                of_text.append(len(of_rule) - 1)
            lists = pa.ListArray.from_arrays(pa.array(of_rule, pa.int32()), pa.array(values, pa.string()))
            return pa.ListArray.from_arrays(pa.array(of_text, pa.int32()), lists)

        return _in_chunks(texts, of)

    return find(text.cast("binary"))


def replaced(text: Column, rules: Iterable[Anchored]) -> Column:
    """s (null where no rule matches), and the labels of the rules that match, in order, with n, the numbers of their matches; each rule runs on what the one before left."""
    rules = tuple(rules)

    @F.arrow_udf("struct<s: string, labels: array<string>, n: array<int>>")
    def replace(texts: pa.Array) -> pa.Array:
        finders = [Finder(r) for r in rules]

        def of(chunk: pa.Array, _: np.ndarray) -> pa.Array:
            scrubbed, ends, labels, ns = [], [0], [], []
            for s, _ in map(_decoded, chunk.to_pylist()):
                counts = {}
                if s is not None:
                    t = Text(s)
                    for f, rule in zip(finders, rules, strict=True):
                        at, n, out = 0, 0, []
                        for m in f.matches(t, f.places(t)):
                            out += (s[at : m.start()], *(x if isinstance(x, str) else s[slice(*m.span(x))] for x in f.to))
                            at, n = m.end(), n + 1
                        if n:
                            s = "".join((*out, s[at:]))
                            t = Text(s)
                            counts[rule.label] = counts.get(rule.label, 0) + n
                scrubbed.append(s if counts else None)
                labels += counts.keys()
                ns += counts.values()
                ends.append(len(ns))
            lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (pa.array(labels, pa.string()), pa.array(ns, pa.int32())))
            return pa.StructArray.from_arrays([pa.array(scrubbed, pa.string()), *lists], ["s", "labels", "n"])

        return _in_chunks(texts, of)

    return replace(text.cast("binary"))
