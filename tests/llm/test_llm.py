"""The corpus operators: odd rows, brute force, round trips and held-out accuracy."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from leakloom.llm import decontaminate, jaccard_join, language_id, license_scan, mixing, ngram_lm, queries, syncmers, token_count, token_files, toxicity
from leakloom.llm.components import components
from leakloom.llm.elias_fano import EliasFano

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, n int, node string, label int, shard string, b string, score double"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))


def odd_rows(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    texts = [None, "", " \t\n", "one", "Two words", "a b c d e f g h", "a b c d e f g h", LONG, LONG + " end", "é漢字 <|endoftext|> 12.5 kg", "under the MIT license", None]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i == 5 else f"s{i % 3}", None, 1, 2, "x", 3, "y", "z", 0.5) for i, t in enumerate(texts)]
    rows += [rows[6], (None, "a b c d", None, None, None, 1, 2, "x", 3, "y", "z", 0.5)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def each(spark, labels, benchmark):
    return {
        "toxicity": lambda d: toxicity.toxicity_digest(d, labels), "tokens": lambda d: token_count.count_tokens(d, queries.tokenizer_path("byte_bpe_50k.json")), "licenses": license_scan.license_digest, "jaccard": jaccard_join.jaccard_components,
        "lm": ngram_lm.score_digest, "fingerprints": syncmers.fingerprint_digest, "language": language_id.language_digest, "files": lambda d: token_files.token_file_digest(d, queries.tokenizer_path("word_bpe_49k.json")), "mixing": mixing.mix_digest,
    }


@pytest.mark.parametrize("name", ["toxicity", "tokens", "licenses", "jaccard", "lm", "fingerprints", "language", "files", "mixing"])
def test_odd_rows(spark, labels, name):
    run = each(spark, labels, None)[name]
    rows = odd_rows(spark)
    out = run(rows).collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(r.doc_id for r in rows.collect())
    assert run(rows.limit(0)).collect() == []


def test_odd_rows_decontamination(spark):
    rows = odd_rows(spark)
    benchmark = spark.createDataFrame([(1, "a b c d e f g h"), (2, None), (3, ""), (None, "x")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(rows, benchmark).collect()}
    assert found == {(5, 1), (6, 1)}
    assert decontaminate.contaminated(rows.limit(0), benchmark).count() == 0
    assert decontaminate.contaminated(rows, benchmark.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(rows, benchmark).columns == rows.columns


def test_reparameterised(spark):
    item = "the shop where Tom works sold 12 kg of apples and then Tom sold 7 kg of pears to the man"
    docs = spark.createDataFrame([(1, "so " + item.replace("Tom", "Ann").replace("12", "95").replace("7", "3.5")), (2, "so " + item.replace("Tom works", "Ann works").replace("12", "7")), (3, "clean " * 30)], "doc_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.contaminated(docs, spark.createDataFrame([(9, "so " + item)], "item_id long, text string")).collect()}
    assert rows[1].kind == "reparameterised" and rows[1].n_exact == 0
    assert set(rows) == {1}


def test_verbatim_windows_are_dropped(spark):
    item = "so the shop where Tom works sold 12 kg of apples and then Tom sold 7 kg of pears to the man"
    numbers = "add 1 2 3 4 5 6 7 8 9 10 11 now"
    edited = item.replace("Tom works", "Ann works").replace("12", "7")  # 13 tokens stay word for word
    texts = [edited, f"x {numbers} y", numbers.replace("1", "3"), "clean " * 30, item.replace("Tom", "Ann").replace("12", "95")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame([(9, item), (8, numbers)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.drop_contaminated(df, benchmark).collect()} == {2, 3}


def test_decontamination_sql(spark, docs, same_as_sql):
    same_as_sql(queries.QUERIES["op3_decontamination"](spark, SF), queries.ORACLES["op3_decontamination"])


def test_toxicity_held_out(spark):
    folder = SF.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity_digest(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.8 and hit / sum(r.predicted for r in rows) > 0.9


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = language_id.language_digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def fuzz(n: int):
    letters = [*"abcXYZ'sdtrevml 019  \t\n\r\x0b\x1c\x85\xa0é漢²Ⅷ_-.!|<>€ 　ΣσςİǅñªÓ", "<|endoftext|>", "<|startoftext|>", "'ll", "́"]
    rng = random.Random(4)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_as_the_library_has_them(spark, docs, file):
    texts = fuzz(1500) + [r.text for r in docs.limit(60).collect()]
    tokenizer = token_count.load_tokenizer(queries.tokenizer_path(file))
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    if file.startswith("byte"):
        assert {r.doc_id: r.n_tokens for r in token_count.count_tokens(df, queries.tokenizer_path(file)).collect()} == {i: len(x) for i, x in want.items()}
    else:
        at = 0
        for r in sorted(token_files.token_file_digest(df, queries.tokenizer_path(file)).collect()):
            ids = np.asarray([*want[r.doc_id], 2], "<u4")
            assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
            at += len(ids)


def test_license_scan():
    n, spans = license_scan.scan_text("x Under the MIT-License, under the mit license. undr the mit licence; CC by/nc cc by nc")
    assert n == 19
    assert [(s["first_word"], s["label"], s["edits"]) for s in spans] == [(1, "mit", 0), (5, "mit", 0), (9, "mit", 2), (13, "cc-by-nc", 0), (16, "cc-by-nc", 0)]
    assert license_scan.scan_text("under the bsd license")[1][0]["label"] == "bsd"


def test_license_notices_in_a_row():
    spans = lambda text: [(s["first_word"], s["last_word"], s["edits"]) for s in license_scan.scan_text(text)[1] if s["label"] == "gpl"]
    assert spans("gnu generl publc license gnu generl publi license") == [(0, 3, 2), (4, 7, 2)]
    assert sorted(spans("gnu generl publc license or the gnu general public license")) == [(0, 3, 2), (6, 9, 0)]
    assert spans("gnu generl publc license " * 3000) == [(4 * i, 4 * i + 3, 2) for i in range(3000)]


def test_other_licences_are_not_taken_for_these():
    for text in ("apache license version 1", "apache license version 1.1", "mozilla public license version 1", "creative commons attribution commercial", "under the kit license", "under the bsx license"):
        assert license_scan.scan_text(text)[1] == [], text
    for text, label in (("apache licence version 2", "apache-2"), ("creative commons atribution non commercial", "cc-by-nc"), ("mozila public license version 2", "mpl-2"), ("undr the mit licence", "mit")):
        assert {s["label"] for s in license_scan.scan_text(text)[1]} == {label}, text


def test_license_base_by_hand(spark, docs):
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    extra = spark.createDataFrame([(10**6, "x Under THE mit-license. Apache License, Version 2; cc by nc by-nc CC by NC")], "doc_id long, text string")
    rows = {r.doc_id: r for r in license_scan.license_digest(docs.select("doc_id", "text").union(extra)).collect()}
    for r in docs.select("doc_id", "text").union(extra).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        found = [(i, k) for k, p in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts, got = [i for i, _ in found], rows[r.doc_id]
        assert (got.n_words, got.n_base, got.first_word, got.last_word, got.base_labels) == (len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({k for _, k in found})))
        assert set(filter(None, got.base_labels.split(","))) <= set(got.labels.split(","))
    assert rows[10**6].n_base == 4


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = set(zip(*(w[j:] for j in range(k)))) if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, t in sets.items():
            if j < i and s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {(i, len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_jaccard_brute_force(spark, k, percent):
    rng = random.Random(k)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 60))] for _ in range(25)]
    rows = []
    for i in range(220):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 4))):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 9)}"
        rows.append((i, " ".join(w[: rng.randint(max(1, len(w) - 3), len(w))]).title()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in jaccard_join.jaccard_components(df, words=k, percent=percent).collect()} == brute_components(rows, k, percent)


def test_jaccard_brute_force_in_blocks(spark, monkeypatch):
    """Several blocks of an index entry, node ids joined by a shuffle, near copies of one text."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    rng = random.Random(9)
    base, rows = [f"w{i}" for i in range(40)], []
    for i in range(150):
        w = list(base) if i % 5 else [f"v{rng.randint(0, 30)}" for _ in range(12)]
        for _ in range(rng.choice((0, 1, 1, 2, 5))):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 40)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in jaccard_join.jaccard_components(df, words=2, percent=80).collect()} == brute_components(rows, 2, 80)


def test_jaccard_pairs_stand_in_their_first_shared_entry(spark, monkeypatch):
    """Heads lose no pair; a document of several texts has none to go by."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "HEAD", 3)
    real, seen = jaccard_join.rest_pairs, []

    def both(entries, labels, rows, percent, nearest=False):
        if not nearest:
            headed, plain = (collections.Counter((min(p), max(p)) for p in real(entries, labels.limit(0), r, percent).collect()) for r in (rows, rows.withColumn("head", F.lit(b""))))
            seen.append((headed, plain))
        return real(entries, labels, rows, percent, nearest)

    monkeypatch.setattr(jaccard_join, "rest_pairs", both)
    rng, rows = random.Random(4), []
    for i in range(90):
        w = [f"w{j}" for j in range(60 + rng.randint(0, 3))]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 99)}"
        rows.append((i % 80, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    jaccard_join.jaccard_components(df, words=3, percent=60).collect()
    (headed, plain), = seen
    assert set(headed) == set(plain) and len(plain) > 500
    assert headed.total() <= plain.total()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 99), (7, 7)], "a long, b long")
    assert {(r.node, r.label) for r in components(edges).collect()} == {(i, 0) for i in range(41)} | {(99, 99), (100, 99)}


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, most in ((1, 1), (5, 3), (3000, 3000), (20_000, 10**9)):
        values = np.sort(rng.integers(0, most + 1, n)).astype(np.uint64)
        coded = EliasFano(*(np.asarray(x) for x in EliasFano.of(values).arrays()))
        assert (coded.get(np.arange(n)) == values).all()
        asked = np.concatenate((rng.integers(0, most + 5, 500).astype(np.uint64), values[:500]))
        assert (coded.successor(asked) == np.searchsorted(values, asked)).all()


def test_lm_base_scores(spark, docs):
    tokens = {r.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")), None] for r in docs.collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    counts = collections.Counter(t for i, x in tokens.items() if fold(i) != 1 for t in x)
    total, kinds = sum(counts.values()), len(counts)
    rows = ngram_lm.score_digest(docs).collect()
    for r in rows:
        x = tokens[r.doc_id]
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in x)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(x), sum(counts[t] > 0 for t in x), total, fold(r.doc_id) == 1)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def model_by_hand(texts, least):
    """Unquantised probabilities of pairs and triples, and back-off weights, from plain counts."""
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", t.lower()), "</s>"] for t in texts]
    one = collections.Counter(t for x in tokens for t in x)
    base = sum(one.values()) + 0.5 * (len(one) + 1)
    p1 = lambda w: (one[w] + 0.5) / base
    pairs, triples = collections.Counter(), collections.Counter()
    for x in tokens:
        y = ["<s>", *x]
        pairs.update(zip(y, y[1:]))
        triples.update(zip(y, y[1:], y[2:]))
    context = collections.Counter()
    for (a, _), n in pairs.items():
        context[a] += n
    p2 = {k: (n - 0.75) / context[k[0]] for k, n in pairs.items() if n >= least}
    p3 = {k: (n - 0.75) / pairs[k[:2]] for k, n in triples.items() if n >= least}

    def weights(table, lower):
        kept, below = collections.Counter(), collections.Counter()
        for k, p in table.items():
            kept[k[:-1]] += p
            below[k[:-1]] += lower(k[1:])
        return {k: (1 - kept[k]) / (1 - below[k]) for k in kept}

    w2 = weights(p2, lambda k: p1(k[0]))
    bigram = lambda a, b: p2.get((a, b), w2.get((a,), 1) * p1(b))
    w3 = weights(p3, lambda k: p2[k])
    trigram = lambda a, b, c: p3.get((a, b, c), w3.get((a, b), 1) * bigram(b, c))

    def score(text):
        y = ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", text.lower()), "</s>"]
        return sum(math.log10(bigram(y[0], y[1]) if i == 1 else trigram(*y[i - 2 : i + 1])) for i in range(1, len(y)))

    return score


@pytest.mark.parametrize(("least", "wide_at"), [(2, 1 << 26), (1, 1 << 26), (2, 40)])
def test_lm_scores_by_hand(spark, docs, least, wide_at):
    texts = sorted(r.text for r in docs.where("text <> ''").collect() if r.text.isascii())[:120]
    score = model_by_hand(texts, least)
    model = ngram_lm.train(spark.createDataFrame([(t,) for t in texts], "text string"), least, wide_at)
    assert (len(model.pairs.wide[0]) > 3) == (wide_at == 40)
    asked = [*texts[:60], "unknown words here", texts[3][:200] + " odd", ""]
    got = []
    for t in asked:
        h, rows = ngram_lm.token_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        got.append(model.log10(h, rows, model.singles(h)[1]).sum())
    want = np.array([score(t) for t in asked])
    # Eight-bit codes move single tokens by a few hundredths, and a context whose words leave little over by more.
    off = np.abs(np.array(got) - want) / np.array([len(t.split()) + 1 for t in asked])
    assert off.max() < 0.05 and off.mean() < 0.01, (off.max(), off.mean())


def test_lm_probabilities_sum_to_one(spark, docs):
    texts = docs.where("text <> ''").select("text")
    model = ngram_lm.train(texts)
    words = sorted({w for r in texts.collect() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text))})
    head = texts.orderBy("text").first().text.split()
    for context in ([], head[:1], head[:2], ["never", "seen"]):
        data = "\n".join(" ".join([*context, w]) for w in [*words, "neverseenword"]).encode()
        cuts = np.cumsum([0] + [len(x) + 1 for x in data.split(b"\n")])
        h, rows = ngram_lm.token_hashes(np.frombuffer(data + b"\n", np.uint8), cuts)
        logp = model.log10(h, rows, model.singles(h)[1])
        at = np.flatnonzero(np.diff(rows, append=-1) != 0) - 1  # the word before each end
        end_h, end_rows = ngram_lm.token_hashes(np.frombuffer(" ".join(context).encode(), np.uint8), np.array([0, len(" ".join(context).encode())]))
        end = model.log10(end_h, end_rows, model.singles(end_h)[1])[-1]
        assert abs((10 ** logp[at]).sum() + 10**end - 1) < 0.03


def test_edited_texts(spark, docs, monkeypatch):
    monkeypatch.setattr(syncmers, "TOGETHER", 30)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    want = {i: hashlib.sha256((t[: len(t) - len(t) // 2] + rows[(at + 1) % len(rows)][1][: len(t) // 2]).encode()).hexdigest() for at, (i, t) in enumerate(rows)}
    got = syncmers.fingerprint_digest(docs).collect()
    assert {r.doc_id: r.edited_sha256 for r in got} == want
    assert np.mean([r.near_edited for r in got]) > 0.2 > 0.05 > np.mean([r.near_next for r in got])


def test_anchors_are_context_free(spark):
    words = [f"w{i}" for i in range(300)]
    edited = ["new"] * 7 + words[:150] + ["odd"] + words[150:]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited))], "doc_id long, text string")
    a, b = ({x["hash"] for x in r.anchors} for r in syncmers.fingerprints(df).orderBy("doc_id").collect())
    assert len(a - b) <= syncmers.K and len(a) > 50


def test_fingerprints_by_hand(spark, docs, monkeypatch):
    """From anchors on: distinct least hashes with first places, and likeness by places, against plain Python."""
    monkeypatch.setattr(syncmers, "KEPT", 20)
    cjk = "".join(chr(0x4E00 + i * 37 % 5000) for i in range(400))
    extra = spark.createDataFrame([(10**6, cjk), (10**6 + 1, cjk[:200] + "一" + cjk[200:]), (10**6 + 2, None), (10**6 + 3, ""), (10**6 + 4, "a b")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(extra)
    base = {r.doc_id: r for r in syncmers.fingerprints(rows).collect()}

    def kept(r):
        first = {}
        for x in r.anchors:
            first.setdefault(x["hash"], x["position"])
        return sorted(first.items())[:20]

    def like(a, b):
        union = sorted({*dict(a), *dict(b)})[:20]
        both = sorted((dict(a)[h], dict(b)[h]) for h in union if h in dict(a) and h in dict(b))
        n = sum(len(both) == 1 or (i > 0 and both[i - 1][1] < y) or (i + 1 < len(both) and y < both[i + 1][1]) for i, (_, y) in enumerate(both))
        return n / len(union) if union else 1.0

    ids = sorted(base, reverse=True)
    following = dict(zip(ids, ids[1:] + ids[:1]))
    got = {r.doc_id: r for r in syncmers.fingerprint_digest(rows).collect()}
    for i in ids:
        assert got[i].fingerprint == "".join(f"{h & (2**64 - 1):016x}{p:08x}" for h, p in kept(base[i])), i
        assert math.isclose(got[i].near_next, like(kept(base[i]), kept(base[following[i]]))), i
    # One character put into Chinese text leaves the other anchors.
    assert got[10**6 + 1].near_next > 0.6


def test_swapped_anchors_do_not_match(spark):
    pairs = "array<struct<hash: long, position: int>>"
    df = spark.createDataFrame([([(1, 0), (2, 5), (3, 9)], [(1, 20), (2, 5), (3, 1)]), ([(1, 0), (2, 5), (3, 9)], [(1, 3), (2, 8), (4, 0)])], f"a {pairs}, b {pairs}")
    assert [r[0] for r in df.select(syncmers.likeness(F.col("a"), F.col("b"))).collect()] == [0.0, 0.5]


def test_mixing_targets(spark, docs):
    docs = docs.withColumn("source", F.when(F.col("source") == "src3", None).otherwise(F.col("source")))
    rows = mixing.mix_digest(docs).collect()
    assert [tuple(r) for r in sorted(rows)] == [tuple(r) for r in sorted(mixing.mix_digest(docs.repartition(7)).collect())]
    assert all(r.taken <= 2 * r.size for r in rows)
    taken = collections.Counter()
    for r in rows:
        taken[(r.source_size, r.target)] += r.taken
    assert all(abs(n - target) <= 1 for (_, target), n in taken.items())
    assert math.isclose(sum(t for _, t in taken), 1.5 * sum(r.size for r in rows), rel_tol=1e-9)


def test_mixed_documents_match_the_plan(spark, docs):
    out = mixing.mix_documents(docs)
    n = out.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert n == mixing.mix_digest(docs).agg(F.sum("taken")).first()[0]
    assert set(docs.columns) < set(out.columns)


def test_partial_pass_draws_blocks_by_rank(spark):
    # One source of 1200 words in blocks of 7, of which 600 words are taken.
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(12)), "s") for i in range(100)], "doc_id long, text string, source string")
    rows = mixing.plan_mix(df, share=0.5, block_words=7, shards=4).collect()
    blocks = {p.block for r in rows for p in r.pieces}
    assert sum(r.taken for r in rows) == 600
    assert len(blocks) in (86, 87) and max(blocks) - min(blocks) > 120
    for size, rest in ((1200, 600), (1200, 1), (1200, 1199), (14, 13), (5, 3), (7, 6)):
        k, last = mixing.drawn_blocks(size, rest, 7, 19)
        n = -(-size // 7)
        lengths = {r: min(7, size - 7 * b) for b, r in enumerate(mixing.permuted(np.arange(n), np.full(n, n), 19).tolist())}
        assert sum(lengths[r] for r in range(k - 1)) + last == rest and 0 < last <= lengths[k - 1]


def test_mix_keeps_quotas_and_order(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(100)), "s") for i in range(60)], "doc_id long, text string, source string")
    options = {"block_words": 30, "shards": 4, "share": 1.0}
    planned = collections.Counter()
    for r in mixing.plan_mix(df, **options).collect():
        for p, shard in zip(r.pieces, r.shards, strict=True):
            planned[shard] += p.n
    out = mixing.mix_documents(df, **options).withColumn("part", F.spark_partition_id()).collect()
    got = collections.Counter()
    for r in out:
        got[r.shard] += len(r.text.split())
    assert got == planned and max(got.values()) - min(got.values()) <= 30
    assert collections.Counter(w for r in out for w in r.text.split()) == collections.Counter(f"w{i}x{j}" for i in range(60) for j in range(100))
    assert [(r.part, r.shard, r.position) for r in out] == sorted((r.part, r.shard, r.position) for r in out)
    assert all(r.part == r.shard for r in out) and len({r.doc_id for r in out[:10]}) > 5


def test_split_tree_is_exact():
    tree = mixing.SplitTree((100, 37, 0, 5), 6, 3)
    source = np.repeat(np.arange(4), (100, 37, 0, 5))
    shard = tree.shard_of(source, np.concatenate([np.arange(n) for n in (100, 37, 0, 5)]))
    sizes = np.bincount(shard, minlength=6)
    assert sizes.sum() == 142 and sizes.max() - sizes.min() <= 3


def test_pipeline(spark, docs, labels):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    kept = toxicity.drop_toxic(docs, labels)
    ids = brute_components([(r.doc_id, r.text) for r in kept.collect()], 5, 80)
    first = {i for i, _, c in ids if i == c}
    leaked = {r.doc_id for r in decontaminate.contaminated(kept, benchmark).collect()}
    clean = kept.where(F.col("doc_id").isin([*(first - leaked)]))
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r.doc_id for r in mixing.mix_documents(clean).collect())


def test_stages_keep_odd_rows_and_clashing_columns(spark, labels):
    rows = odd_rows(spark)
    for name in ("s", "r", "at", "range", "start", "local", "copy", "row", "target", "shards", "position", "pieces", "held_id", "dropped_id", "component_id", "part", "words", "whole", "rest"):
        rows = rows.withColumn(name, F.lit(f"user {name}"))
    benchmark = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    stages = {"toxicity": lambda d: toxicity.drop_toxic(d, labels), "jaccard": jaccard_join.keep_one_of_each, "decontamination": lambda d: decontaminate.drop_contaminated(d, benchmark), "mixing": mixing.mix_documents}
    for name, stage in stages.items():
        out = stage(rows)
        got = out.collect()
        assert out.columns[: len(rows.columns)] == rows.columns and got, name
        for r in got:
            assert all(r[c] == f"user {c}" for c in ("s", "r", "at", "range", "row", "target", "shards", "position", "held_id", "dropped_id", "part")) and (r["size"], r["n"], r["shard"]) == (1, 2, "y"), name
        assert stage(rows.limit(0)).collect() == [], name
    out = mixing.mix_documents(rows)
    assert out.columns[len(rows.columns) :] == ["mix_shard", "mix_position"]
    assert {r.doc_id for r in out.collect()} >= {3, 4, 7, None} and not {0, 1, 2} & {r.doc_id for r in out.collect()}


def test_draws_from_many_blocks_are_exact():
    counts = np.array([3 * 10**12, 10**11, 5, 0, 7 * 10**9])
    tree = mixing.SplitTree(tuple(counts.tolist()), 8, 3)
    left = tree.split(0, 8, counts)
    assert left.sum() == counts.sum() // 2 and (left >= 0).all() and (left <= counts).all()
    assert abs(left[0] / counts[0] - 0.5) < 1e-4


def test_rare_language_is_learned_and_numerals_are_no_letters(spark, docs):
    rare = spark.createDataFrame([(10**6 + i, "ωδε λογος και " * 8, "xx") for i in range(9)], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").union(rare)
    model = language_id.fit(both, max_rows=100)
    assert "xx" in model.languages and model.predict("λογος και ωδε")[0] == "xx"
    assert [model.predict(t)[0] for t in ("²", "½", "Ⅷ", "12 .", "", None)] == ["und"] * 6


def test_other_tokenizers_are_refused(spark, docs):
    with pytest.raises(ValueError, match="not known"):
        token_count.count_tokens(docs, queries.tokenizer_path("word_bpe_49k.json"))
    with pytest.raises(ValueError, match="not known"):
        token_files.token_file_digest(docs, queries.tokenizer_path("byte_bpe_50k.json"))
