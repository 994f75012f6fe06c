"""Secret detection: every detector over every text, in one narrow stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.rows import exploded
from .anchored import Anchored, found
from .registry import SCAN_SPECS, Detector, Vectorised
from .text import pieces

HIT = {"detector": "string", "rank": "int", "finding_id": "string", "token_type": "string", "severity": "string", "title": "string", "at": "int", "value": "string", "metadata": "map<string,string>"}


def _as_hits(column: Column, fields: tuple[str, ...]) -> Column:
    return column.cast(f"array<struct<{', '.join(f'{f}: {HIT[f]}' for f in fields)}>>")


def _any_of(text: Column, literals: tuple[str, ...], any_case: bool) -> Column:
    hit = F.lit(False)
    for literal in literals:
        hit = hit | (F.lower(text).contains(literal) if any_case else text.contains(literal))
    return hit if literals else F.lit(True)


#: Texts of fewer bytes are one piece.
_SHORT = 400


def _seen(text: Column, joins: tuple[str, ...], cut: bool) -> Column:
    """What detectors look at, worked out once for a text: s, l (lower case), and pieces of both as parts if it is cut."""
    seen = lambda s: F.struct(s.alias("s"), F.lower(s).alias("l"))

    def parts(whole: Column) -> Column:
        pairs = F.when(F.octet_length(whole["s"]) < _SHORT, F.array(whole)).otherwise(F.transform(pieces(whole["s"], joins, any_case=True), seen))
        return F.struct(whole["s"].alias("s"), whole["l"].alias("l"), pairs.alias("parts"))

    return sc.bound(seen(text), parts) if cut else seen(text)


def _holds(seen: Column, d: Detector) -> Column:
    """Whether a text or a piece of it holds a literal of the detector's gate."""
    return _any_of(seen["l" if d.any_case else "s"], d.gate, False)


def _may_hold(text: Column, d: Detector) -> Column:
    """The same for one literal alone: a text is lowered only if it holds what a match needs, and the literal neither as it stands nor in capitals."""
    held = _any_of(text, d.gate, False)
    if d.any_case:
        held = held | _any_of(text, tuple(x.upper() for x in d.gate), False) | _any_of(text, d.gate, True)
    return text.contains(d.needs) & held if d.needs else held


def _hits(seen: Column, d: Detector, now: Column, how: str, fields: tuple[str, ...]) -> Column:
    """The detector's hits, in order. how: seen is a text ("alone"), one with its lower case ("whole") and its parts ("parts"), or an array of the matches ("found")."""

    def of_value(value: Column, at: Column) -> Column:
        makes = {
            "detector": lambda: F.lit(d.name), "rank": lambda: F.lit(d.rank), "finding_id": lambda: d.of("finding_id", value), "token_type": lambda: d.of("token_type", value), "severity": lambda: d.of("severity", value), "title": lambda: d.of("title", value),
            "at": lambda: at, "value": lambda: value, "metadata": lambda: _jwt_metadata(value, now) if d.name == "jwt" else d.metadata(value),
        }
        return F.struct(*(makes[f]().alias(f) for f in fields))

    search = lambda s: F.regexp_extract_all(s, F.lit(d.pattern), F.lit(d.group))
    if how == "found":
        values = seen
    elif how == "parts":
        values = F.flatten(F.transform(F.filter(seen["parts"], lambda p: _holds(p, d)), lambda p: search(p["s"])))
    else:
        values = search(seen if how == "alone" else seen["s"])
    if d.distinct:
        values = F.array_distinct(values)
    if d.keep is not None:
        values = F.filter(values, d.keep)
    hits = F.transform(values, of_value)
    if how != "found":
        hits = F.when(_may_hold(seen, d) if how == "alone" else _holds(seen, d), hits).otherwise(F.array())
    return _as_hits(hits, fields)


def _jwt_metadata(token: Column, now: Column) -> Column:
    def of(claims: Column) -> Column:
        subtype = sc.jwt_subtype(claims)
        kind = F.when(subtype.isNotNull(), F.create_map(F.lit("jwt_subtype"), subtype)).otherwise(F.map_from_entries(F.array().cast("array<struct<key string, value string>>")))
        none = F.map_from_entries(F.array().cast("array<struct<key string, value string>>"))
        return F.when(claims.isNull(), none).otherwise(F.map_concat(sc.jwt_standard(claims, now), sc.jwt_extras(claims, subtype), kind))

    return sc.bound(sc.jwt_claims(token), of)


def _found(d: Vectorised, column: Column, fields: tuple[str, ...]) -> Column:
    """The hits of a vectorised detector, worked out in a column of their own."""

    def of(hit: Column, at: Column) -> Column:
        makes = {"detector": F.lit(d.name), "rank": F.lit(d.rank), "finding_id": F.lit(d.finding_id or d.name), "token_type": F.lit(d.token_type or d.name), "severity": F.lit(d.severity), "title": F.lit(d.title or d.name), "at": at, "value": hit["value"], "metadata": hit["metadata"]}
        return F.struct(*(makes[f].alias(f) for f in fields))

    return _as_hits(F.transform(F.coalesce(column, F.array().cast("array<struct<value string, metadata map<string,string>>>")), of), fields)


def detect_all(texts: DataFrame, text: str = "text", specs: tuple[Detector | Vectorised, ...] = SCAN_SPECS, now: int = 0, fields: tuple[str, ...] = tuple(HIT)) -> DataFrame:
    """One row for each hit, with all columns of texts but the text itself, and the hit's own fields, of which only those asked for are worked out.

    Null and empty texts have none. now (in seconds) tells expired tokens. A text that holds no detector's literal costs
    a few substring searches and no pattern. Vectorised detectors work in the same pass, each on the texts that its gate
    lets through; hits keep the order of specs. Where several detectors name the literals that their matches begin with,
    one Arrow stage finds the matches of all of them. Of the others, those with joins search only the pieces of a text
    that hold a literal of their gate; for one detector alone neither pays.
    """
    plain = [d for d in specs if isinstance(d, Detector)]
    anchored = [d for d in plain if d.starts]
    anchored = anchored if len(anchored) > 1 else []
    local = [d for d in plain if d.joins is not None and d not in anchored]
    joins = tuple(dict.fromkeys(j for d in local for j in d.joins))
    cut, whole = len(local) > 1, [d for d in plain if d not in anchored]
    alone = len(whole) == 1 and len(whole[0].gate) == 1
    rows, makes = texts, []
    if anchored:
        rows = rows.withColumn("__anchored", found(F.col(text), (Anchored(d.pattern, d.starts, d.gate, d.group) for d in anchored)))
    for i, d in enumerate(specs):
        if isinstance(d, Vectorised):
            rows = rows.withColumn(f"__found{i}", d.find(F.when(_any_of(F.col(text), d.gate, d.any_case), F.col(text))))
            makes.append(lambda seen, d=d, i=i: _found(d, F.col(f"__found{i}"), fields))
        elif d in anchored:
            makes.append(lambda seen, d=d: _hits(F.get(F.col("__anchored"), F.lit(anchored.index(d))), d, F.lit(now), "found", fields))
        else:
            makes.append(lambda seen, d=d: _hits(seen, d, F.lit(now), "alone" if alone else "parts" if cut and d.joins is not None else "whole", fields))
    hits = lambda seen: F.concat(*(make(seen) for make in makes)) if len(makes) > 1 else makes[0](seen)
    every = sc.bound(_seen(F.col(text), joins, cut), hits) if whole and not alone else hits(F.col(text))
    out = exploded(rows, F.when(F.col(text).isNotNull(), every), "__hit")
    return out.select(*[F.col(f"`{c}`") for c in texts.columns if c != text], "__hit.*")


def detect(texts: DataFrame, name: str, text: str = "text", specs: tuple[Detector | Vectorised, ...] = SCAN_SPECS, now: int = 0, fields: tuple[str, ...] = tuple(HIT)) -> DataFrame:
    """detect_all with the detectors of one name."""
    return detect_all(texts, text, tuple(d for d in specs if d.name == name), now, fields)
