"""Benchmark decontamination by template windows, with Spark's own functions only.

Numbers, names and units become typed placeholders. Windows of the resulting template are hash-joined between documents
and benchmark items, so that a question with other numbers or names still meets its original; then each placeholder's
values must agree: one value of the item stands for one value of the document throughout, and the other way round.

A capital at the beginning of a sentence may or may not begin a name. Windows that start with such a word stand in a second
template too, in which it and others like it are names; each template's stretches are checked on their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Tokens of a window; a shorter item is one window of its own length. Under LEAST tokens it counts only word for word,
#: and up to WHOLE tokens only as a document's whole text.
WINDOW, LEAST, WHOLE = 10, 5, 2
#: Benchmark windows up to so many (each some 300 bytes) are broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 200_000
BROADCAST_IDS = 2_000_000

#: Units that may follow a number.
UNITS = (
    "mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "min", "h", "percent", "degrees", "meter", "meters", "metre", "metres", "kilometers", "kilometres", "miles", "feet", "inches",
    "grams", "kilograms", "pounds", "ounces", "liters", "litres", "gallons", "seconds", "minutes", "hours", "days", "weeks", "months", "years", "dollars", "cents", "euros", "usd", "eur", "mph", "kmh",
)

#: Marks the beginning of a word that looks like a name: an upper-case letter after lower case, a digit, a comma or a semicolon and white space.
NAME_MARK = "\x01"
#: Marks the beginning of any other word that begins with an upper-case letter, such as a sentence's first.
CAPITAL_MARK = "\x02"


def tokens_of(text: Column) -> Column:
    """Lower-case tokens of a text; a name and another capital word keep their marks, and a number its inner points and commas as middle dots."""
    digits = F.regexp_replace(F.regexp_replace(text, r"([0-9])[.,]([0-9])", "$1·$2"), r"([0-9])[.,]([0-9])", "$1·$2")
    named = F.regexp_replace(digits, r"([\p{Ll}0-9,;][ \t\n\r\f]+)(\p{Lu})", f"$1{NAME_MARK}$2")
    marked = F.regexp_replace(named, r"(^|[^\p{L}\p{M}\p{N}·\x01])(\p{Lu})", f"$1{CAPITAL_MARK}$2")
    return F.filter(F.split(F.lower(marked), r"[^\p{L}\p{M}\p{N}·\x01\x02]+"), lambda w: w != "")


def _said(tokens: Column) -> Column:
    """The tokens without marks."""
    return F.transform(tokens, lambda w: F.ltrim(w, F.lit(NAME_MARK + CAPITAL_MARK)))


def _templates(marked: Column) -> Column:
    """The plain template, the one in which capital words are names, and for items under LEAST tokens the bare words."""
    return F.array(_kinds(marked, lambda w: w), _kinds(marked, lambda w: w, True), _said(marked))


def _which(length: Column, capitals: Column) -> Column:
    return F.when(length < LEAST, F.lit(2)).otherwise(capitals.cast("int"))


def _is_number(w: Column) -> Column:
    return (w >= "0") & (w < ":")


def _kinds(tokens: Column, literal, capitals: bool = False) -> Column:
    """Each token's placeholder, or literal(token); with capitals, capital words are names too."""
    before = lambda i: F.coalesce(_is_number(F.get(tokens, i - 1)), F.lit(False))
    name = (lambda w: w.startswith(NAME_MARK) | w.startswith(CAPITAL_MARK)) if capitals else (lambda w: w.startswith(NAME_MARK))
    plain = (lambda w: w) if capitals else (lambda w: F.ltrim(w, F.lit(CAPITAL_MARK)))
    return F.transform(
        tokens,
        lambda w, i: F.when(name(w), literal(F.lit("<name>"))).when(_is_number(w), literal(F.lit("<num>"))).when(w.isin(*UNITS) & before(i), literal(F.lit("<unit>"))).otherwise(literal(plain(w))),
    )


def _bound(value: Column, body) -> Column:
    """body of a value that is worked out once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(tokens: Column, lengths: list[int]) -> Column:
    """position, length, capitals and template hash of each window, and of those that begin with a capital word in the second template."""
    none = F.array().cast("array<struct<position int, length int, capitals boolean, hash bigint>>")

    def at(places: Column, hashes: Column, n: int, capitals: bool) -> Column:
        return F.transform(places, lambda i: F.struct(i.alias("position"), F.lit(n).alias("length"), F.lit(capitals).alias("capitals"), F.xxhash64(F.slice(hashes, i + 1, n)).alias("hash")))

    def of_tokens(t: Column) -> Column:
        size = F.size(t)
        starts = F.filter(F.transform(t, lambda w, i: F.when(w.startswith(CAPITAL_MARK), i)), lambda i: i.isNotNull())
        # A text without capital words at a beginning needs no second template.
        bare = F.transform(_said(t), lambda w: F.xxhash64(w)) if lengths[0] < LEAST else F.lit(None)
        both = F.struct(bare.alias("bare"), _kinds(t, F.xxhash64).alias("plain"), F.when(F.size(starts) > 0, _kinds(t, F.xxhash64, True)).alias("named"), starts.alias("starts"))

        def of_hashes(h: Column) -> Column:
            parts = []
            for n in lengths:
                fits = size >= n if n > WHOLE else size == n
                parts.append(F.when(fits, at(F.sequence(F.lit(0), size - n), h["plain" if n >= LEAST else "bare"], n, False)).otherwise(none))
                if n < LEAST:
                    continue
                parts.append(F.when(fits, at(F.filter(h["starts"], lambda i, n=n: i <= size - n), h["named"], n, True)).otherwise(none))
            return F.concat(*parts)

        return _bound(both, of_hashes)

    return _bound(tokens, of_tokens)


def _cut(tokens: Column, position: Column, length: Column) -> Column:
    return F.slice(tokens, position + 1, length)


def _wordy(template: Column) -> Column:
    """Whether two fifths of a window at least are words."""
    return 5 * F.size(F.filter(template, lambda w: w.isin("<name>", "<num>", "<unit>"))) <= 3 * F.size(template)


def benchmark_windows(benchmark: DataFrame, all_windows: bool = False) -> DataFrame:
    """item_id, item_position, length, capitals, hash, item_tokens, item_template, item_windows of the windows of which two fifths at least are words, or of all. Those of items under LEAST tokens are among them whatever they hold."""
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    items = items.withColumn("marked", tokens_of(F.col("text"))).where(F.size("marked") > 0)
    items = items.withColumn("tokens", _said(F.col("marked"))).withColumn("templates", _templates(F.col("marked")))
    n = F.least(F.size("tokens"), F.lit(WINDOW))
    placed = items.withColumn("length", n).withColumn("item_position", F.explode(F.sequence(F.lit(0), F.size("tokens") - n)))
    placed = placed.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("capitals")).where(~F.col("capitals") | F.get("marked", F.col("item_position")).startswith(CAPITAL_MARK))
    cut = placed.select(
        "item_id", "item_position", "length", "capitals", _cut(F.col("tokens"), F.col("item_position"), F.col("length")).alias("item_tokens"), _cut(F.get("templates", _which(F.col("length"), F.col("capitals"))), F.col("item_position"), F.col("length")).alias("item_template"),
        (F.size("tokens") - n + 1).alias("item_windows"),
    )
    short = F.col("length") < LEAST
    kept = cut.where(_wordy(F.col("item_template")) | (short | F.lit(all_windows)) & ~F.col("capitals"))
    return kept.withColumn("hash", F.xxhash64(F.transform("item_template", lambda w: F.xxhash64(w)))).groupBy("item_id", "length", "capitals", "item_windows", "hash", "item_tokens", "item_template").agg(F.min("item_position").alias("item_position"))


def _pairs(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Each document's window (position, doc_tokens) with each window of an item of its template; one of fewer words, or of an item under LEAST tokens, only word for word."""
    lengths = sorted(r.length for r in windows.select("length").distinct().collect()) or [WINDOW]
    small = windows.count() <= BROADCAST_WINDOWS
    hint = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    places = docs.select("doc_id", F.explode(_windows(tokens_of(F.col("text")), lengths)).alias("w")).select("doc_id", "w.*")
    wanted = windows.select("hash", "length", "capitals").distinct().withColumnsRenamed({"hash": "h", "length": "l", "capitals": "c"})
    met = places.join(hint(wanted), (F.col("hash") == F.col("h")) & (F.col("length") == F.col("l")) & (F.col("capitals") == F.col("c")), "left_semi")
    met = materialise(met.groupBy("doc_id").agg(F.collect_set(F.struct("position", "length", "capitals", "hash")).alias("places")), "places")

    few = met.count() <= BROADCAST_IDS
    ids = met.select(F.col("doc_id").alias("met_id"))
    hit = docs.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("met_id"), "left_semi").distinct()
    hit = hit.select("doc_id", tokens_of(F.col("text")).alias("marked")).withColumn("tokens", _said(F.col("marked"))).withColumn("templates", _templates(F.col("marked"))).join(met, "doc_id")
    cut = lambda p: F.struct(*(p[c].alias(c) for c in ("position", "length", "capitals", "hash")), _cut(F.col("tokens"), p["position"], p["length"]).alias("doc_tokens"), _cut(F.get("templates", _which(p["length"], p["capitals"])), p["position"], p["length"]).alias("doc_template"))
    seen = hit.select("doc_id", F.explode(F.transform("places", cut)).alias("p")).select("doc_id", "p.*")
    exact = lambda template, tokens: F.when(_wordy(F.col(template)) & (F.col("length") >= LEAST), F.lit(0).cast("long")).otherwise(F.xxhash64(tokens))
    seen, items = seen.withColumn("exact", exact("doc_template", "doc_tokens")), windows.withColumn("exact", exact("item_template", "item_tokens"))
    return seen.join(hint(items), ["hash", "length", "capitals", "exact"]).where((F.col("doc_template") == F.col("item_template")) & ((F.col("exact") == 0) | (F.col("doc_tokens") == F.col("item_tokens"))))


def _agreeing(pairs: DataFrame) -> DataFrame:
    """The stretches of pairs whose values agree."""
    slots = F.filter(
        F.transform(F.arrays_zip("item_template", "item_tokens", "doc_tokens"), lambda z: F.struct(z["item_template"].alias("kind"), z["item_tokens"].alias("item"), z["doc_tokens"].alias("doc"))),
        lambda z: z["kind"].isin("<name>", "<num>", "<unit>"),
    )
    # One stretch: windows of one template at one distance between document and item.
    stretches = (
        pairs.withColumn("slots", slots)
        .groupBy("doc_id", "item_id", "item_windows", "capitals", (F.col("position") - F.col("item_position")).alias("shift"))
        .agg(F.collect_set("item_position").alias("at"), F.collect_set(F.when(F.col("doc_tokens") == F.col("item_tokens"), F.col("position"))).alias("exact"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    )
    one_to_one = (F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["item"])))) == F.size("slots")) & (F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["doc"])))) == F.size("slots"))
    return stretches.where(one_to_one)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, coverage, n_exact, n_slots, kind: one row for each document and item that it holds.

    n_windows: distinct windows of the item in stretches of the document whose values agree with the item's; coverage:
    their share of the item's windows; n_exact: places of the document that hold one word for word; n_slots: distinct placeholder values; kind:
    verbatim, or reparameterised if no window is word for word. Items of fewer than LEAST tokens are found word for word
    only, those of up to WHOLE tokens where they are a document's whole text. Rows with a null id, null and empty texts
    give nothing; repeated rows count once; other columns, whatever their names, are not read.
    """
    windows = materialise(benchmark_windows(benchmark), "benchmark")
    return (
        _agreeing(_pairs(docs, windows))
        .groupBy("doc_id", "item_id", "item_windows")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_windows"), F.size(F.array_distinct(F.flatten(F.collect_list("exact")))).cast("long").alias("n_exact"), F.size(F.array_distinct(F.flatten(F.collect_list("slots")))).cast("long").alias("n_slots"))
        .select("doc_id", "item_id", "n_windows", (F.col("n_windows") / F.col("item_windows")).alias("coverage"), "n_exact", "n_slots", F.when(F.col("n_exact") > 0, "verbatim").otherwise("reparameterised").alias("kind"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item's window; all columns stay, whatever their names, and so do rows with a null id.

    Null and empty texts stay; repeated rows stay or go together; an empty table gives none.

    A window that is word for word an item's counts whatever the values around it and however many placeholders it has.
    """
    pairs = materialise(_pairs(docs, materialise(benchmark_windows(benchmark, all_windows=True), "benchmark")), "pairs")
    verbatim = pairs.where("doc_tokens = item_tokens").select("doc_id")
    agreeing = _agreeing(pairs.where(_wordy(F.col("item_template")))).select("doc_id")
    found = verbatim.union(agreeing).distinct()
    return docs.alias("d").join(found.alias("f"), F.col("d.doc_id") == F.col("f.doc_id"), "left_anti")


_TOKENS_SQL = r"""list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''),
    '([0-9])[.,]([0-9])', '\1·\2', 'g'), '([0-9])[.,]([0-9])', '\1·\2', 'g'), '([\p{Ll}0-9,;][ \t\n\r\f]+)(\p{Lu})', '\1' || chr(1) || '\2', 'g'), '(^|[^\p{L}\p{M}\p{N}·\x01])(\p{Lu})', '\1' || chr(2) || '\2', 'g')), '[^\p{L}\p{M}\p{N}·\x01\x02]+'), lambda w: w <> '')"""


def _template_sql(capitals: bool) -> str:
    name = "starts_with(w, chr(1))" + (" OR starts_with(w, chr(2))" if capitals else "")
    return f"""list_transform(m, lambda w, i: CASE WHEN {name} THEN '<name>' WHEN w >= '0' AND w < ':' THEN '<num>'
    WHEN w IN ({", ".join(f"'{u}'" for u in UNITS)}) AND i > 1 AND m[i - 1] >= '0' AND m[i - 1] < ':' THEN '<unit>' ELSE ltrim(w, chr(2)) END)"""


_SPLIT = f"m, list_transform(m, lambda w: ltrim(w, chr(1) || chr(2))) AS t, [{_template_sql(False)}, {_template_sql(True)}, list_transform(m, lambda w: ltrim(w, chr(1) || chr(2)))] AS p"
_SLOTS = "('<name>', '<num>', '<unit>')"
_WORDY = lambda p: f"5 * len(list_filter({p}, lambda w: w IN {_SLOTS})) <= 3 * n"

ORACLE = f"""
WITH d0 AS (SELECT DISTINCT doc_id, {_TOKENS_SQL} AS m FROM documents WHERE doc_id IS NOT NULL),
d AS (SELECT doc_id, {_SPLIT} FROM d0),
b0 AS (SELECT DISTINCT item_id, {_TOKENS_SQL} AS m FROM benchmark WHERE item_id IS NOT NULL),
b AS (SELECT item_id, {_SPLIT}, least(len(m), {WINDOW}) AS n, len(m) - least(len(m), {WINDOW}) + 1 AS item_windows FROM b0 WHERE len(m) > 0),
bw0 AS (SELECT *, unnest(range(0, len(t) - n + 1)) AS ip FROM b),
bw1 AS (SELECT item_id, n, item_windows, ip, c, t[ip + 1:ip + n] AS it, p[c][ip + 1:ip + n] AS pt FROM bw0, (SELECT unnest([1, 2, 3]) AS c) WHERE CASE WHEN n < {LEAST} THEN c = 3 ELSE c = 1 OR c = 2 AND starts_with(m[ip + 1], chr(2)) END),
bw AS (SELECT item_id, n, item_windows, c, pt, it, min(ip) AS ip FROM bw1 WHERE {_WORDY("pt")} OR n < {LEAST} GROUP BY ALL),
lens AS (SELECT DISTINCT n FROM bw),
dw0 AS (SELECT doc_id, n, m, t, p, unnest(range(0, len(t) - n + 1)) AS pos FROM d, lens WHERE len(t) >= n AND (n > {WHOLE} OR len(t) = n)),
dw AS (SELECT doc_id, n, pos, c, t[pos + 1:pos + n] AS dt, p[c][pos + 1:pos + n] AS pt FROM dw0, (SELECT unnest([1, 2, 3]) AS c) WHERE CASE WHEN n < {LEAST} THEN c = 3 ELSE c = 1 OR c = 2 AND starts_with(m[pos + 1], chr(2)) END),
m AS (SELECT doc_id, item_id, item_windows, pos, ip, c, dt, it, dt = it AS same,
    list_filter(list_transform(range(1, n + 1), lambda i: {{'k': dw.pt[i], 'i': it[i], 'd': dt[i]}}), lambda z: z.k IN {_SLOTS}) AS slots FROM dw JOIN bw USING (n, c, pt) WHERE dt = it OR n >= {LEAST} AND {_WORDY("dw.pt")}),
s AS (SELECT doc_id, item_id, item_windows, c, pos - ip AS shift, list(DISTINCT ip) AS ats, list(DISTINCT pos) FILTER (same) AS exact, list_distinct(flatten(list(slots))) AS slots FROM m GROUP BY ALL),
ok AS (SELECT * FROM s WHERE len(list_distinct(list_transform(slots, lambda x: {{'k': x.k, 'i': x.i}}))) = len(slots) AND len(list_distinct(list_transform(slots, lambda x: {{'k': x.k, 'd': x.d}}))) = len(slots)),
g AS (SELECT doc_id, item_id, item_windows, len(list_distinct(flatten(list(ats))))::BIGINT AS n_windows, coalesce(len(list_distinct(flatten(list(exact)))), 0)::BIGINT AS n_exact, len(list_distinct(flatten(list(slots))))::BIGINT AS n_slots FROM ok GROUP BY ALL)
SELECT doc_id, item_id, n_windows, n_windows / item_windows AS coverage, n_exact, n_slots, CASE WHEN n_exact > 0 THEN 'verbatim' ELSE 'reparameterised' END AS kind FROM g
"""
