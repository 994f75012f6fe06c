"""Collocations, conversation repair and URL filters: brute force, SQL, odd rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from leakloom.llm import collocations, conversations, decontaminate, mixing, ngram_lm, queries, url_filter

# --- collocations


def mined(rows, least, longest, most, share):
    """The contract, word for word."""
    pieces = collections.defaultdict(list)
    for text, lang in rows:
        lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
        pieces[lang or "und"] += [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]
    out = []
    for lang, all_pieces in pieces.items():
        f = collections.Counter(tuple(p[i : i + k]) for p in all_pieces for k in range(1, longest + 1) for i in range(len(p) - k + 1))
        n = sum(map(len, all_pieces))
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in found.items():
            inside = any(p == q[i : i + len(p)] for q, b in found.items() if len(q) > len(p) and 100 * b >= share * a for i in range(len(q) - len(p) + 1))
            if not inside:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows_.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]], n))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], x[5], -x[0]) for i, x in enumerate(sorted(rows_)[:most])]
    return sorted(out)


def phrases(spark, rows, **options):
    df = spark.createDataFrame([(i, t, lang, 1, "x") for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, n int, word string")
    return sorted(tuple(r) for r in collocations.collocations(df, **options).collect())


@pytest.mark.parametrize(("shards", "share", "most"), [(1, 100, 2000), (3, 60, 4)])
def test_collocations_brute_force(spark, shards, share, most, monkeypatch):
    monkeypatch.setattr(collocations, "TALLY", 50)
    monkeypatch.setattr(collocations, "KNOWN", 5)
    rng = random.Random(shards)
    words = ["A", "b", "é漢", "d'", "E-e", "ff", "İx"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ";", "\x0b"]) for _ in range(rng.randint(0, 60)))
    rows = [(text(), rng.choice(["en", "en", None, "und", "d e"])) for _ in range(40)] + [(None, "en"), ("", None), ("one two three four five six", "fr")] + [("one two three four five six", "fr")] * 5
    assert phrases(spark, rows, least=6, shards=shards, share=share, most=most) == mined(rows, 6, 5, most, share)


def test_collocations_sql(spark, same_as_sql):
    folder = SF.replace("0.001", "0.01")
    same_as_sql(queries.QUERIES["op11_collocations"](spark, folder), queries.ORACLES["op11_collocations"], folder)


def test_collocations_of_nothing_and_of_one_long_text(spark):
    assert phrases(spark, [], least=2) == []
    assert phrases(spark, [(None, None)], least=2) == []
    rows = [("a b c " * 30_000, "en")]
    assert phrases(spark, rows, least=100) == mined(rows, 100, 5, 2000, 100)


def test_saturated_maps_change_nothing(spark, monkeypatch):
    """Maps of 64 bits let nearly every phrase pass; the rows stay the same."""
    monkeypatch.setattr(collocations, "BLOCK", 8)
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    rows = [(f"x y z w{i % 7} q x y r{i} s{i}", "en") for i in range(60)]
    assert phrases(spark, rows, least=8) == mined(rows, 8, 5, 2000, 100)


# --- conversations


def cheapest(turns, costs, most_inserts):
    """cost, audit, repaired lines of the best edits, by trying all."""
    best = None
    gaps = [""] + ["I" * i for i in range(1, most_inserts + 1)]
    for inserts in itertools.product(gaps, repeat=len(turns) + 1):
        for letters in itertools.product("DKR", repeat=len(turns)):
            audit = "".join(a + b for a, b in zip(inserts, [*letters, ""], strict=True))
            for roles in itertools.product("ua", repeat=sum(x in "IR" for x in audit)):
                own, given, cost, initials, lines = iter(turns), iter(roles), 0, "", []
                for x in audit:
                    role, text, fault = ("", "", "") if x == "I" else next(own)
                    if x == "K" and role[:1] not in ("s", "u", "a"):
                        cost = None
                        break
                    if x == "D":
                        cost += costs.delete
                        continue
                    if fault in ("blank", "duplicate"):
                        cost = None
                        break
                    cost += {"K": costs.keep, "R": costs.rerole, "I": costs.insert}[x] + (costs.truncated if fault == "truncated" else 0)
                    role = role if x == "K" else {"u": "user", "a": "assistant"}[next(given)]
                    initials += role[:1]
                    lines.append(f"{role}:{text}")
                if cost is not None and re.fullmatch(r"(s?(ua)+)?", initials):
                    best = min(best, (cost, audit, lines)) if best else (cost, audit, lines)
    return best


@pytest.mark.parametrize(("costs", "inserts"), [(conversations.Costs(), 1), (conversations.Costs(insert=1, delete=3), 2), (conversations.Costs(rerole=2, delete=2, insert=2, truncated=0), 1)])
def test_cheapest_edits_by_trying_all(costs, inserts, monkeypatch):
    monkeypatch.setattr(conversations, "TURNS", 2)
    monkeypatch.setattr(conversations, "_LOW", 27)
    monkeypatch.setattr(conversations, "_HIGH", 30)
    conversations.edges.cache_clear()
    rng = random.Random(1)
    for _ in range(60):
        turns = [(rng.choice(["system", "user", "user", "assistant", "assistant", " ", "tool"]), f"t{i}", rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for i in range(rng.randint(0, 3 if inserts == 2 else 4))]
        repair, edits = conversations.Repair(costs), []
        for i, (role, text, fault) in enumerate(turns):
            edits += repair.add(conversations.Turn(i, role, text, fault))
        edits += repair.end()
        cost, audit, lines = cheapest(turns, costs, inserts)
        assert "".join(e for e, _, _ in edits) == audit
        assert [f"{role}:{t.text if t else ''}" for _, role, t in edits if role] == lines
    conversations.edges.cache_clear()


def test_repair_does_not_depend_on_the_ranking(monkeypatch):
    rng = random.Random(3)
    turns = [conversations.Turn(i, rng.choice(["system", "user", "assistant", "assistant", "x"]), f"t{i}", rng.choice(["", "", "", "blank", "truncated"])) for i in range(400)]

    def audit(size):
        monkeypatch.setattr(conversations, "TURNS", size)
        monkeypatch.setattr(conversations, "_LOW", 9 * (size + 1))
        monkeypatch.setattr(conversations, "_HIGH", 9 * (size + 1) + 3)
        conversations.edges.cache_clear()
        repair = conversations.Repair(conversations.Costs())
        return "".join(e for turn in turns for e, _, _ in repair.add(turn)) + "".join(e for e, _, _ in repair.end())

    assert audit(7) == audit(1000)
    conversations.edges.cache_clear()


def test_conversations_sql(spark, same_as_sql):
    folder = SF.replace("0.001", "0.01")
    same_as_sql(queries.QUERIES["op12_conversation_repair"](spark, folder), queries.ORACLES["op12_conversation_repair"], folder)


def test_conversations_odd_rows(spark):
    rows = [(None, None, None, None), (None, 3, "user", "x."), (1, None, "user", "a?"), (1, None, "user", "a?"), (1, 5, "assistant", "b " * 50_000 + "."), (2, 1, "system", "s."), (2, 1, "system", "s."), (3, 7, "", " \t\x0b"), (4, 9, "assistant", "né")]
    rows += [(k, 0, "user", "gone.") for k in range(100, 140)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, copy int, fault string")
    out = {r.conv_id: r for r in conversations.conversation_digest(df).collect()}
    assert set(out) == {r[0] for r in rows} and len(out) == df.select("conv_id").distinct().count()
    dropped = [k for k in range(100, 140) if zlib.crc32(f"{k}:0".encode()) % 20 == 0]
    assert dropped
    for k in dropped:
        assert tuple(out[k])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert out[3].audit == "D" and out[3].blank == 1 and out[3].gaps == 0
    assert conversations.conversation_digest(df.limit(0)).collect() == []
    edits = conversations.repaired(df).where("conv_id = 2").collect()
    assert [(r.edit, r.role, r.fault) for r in edits] == [("D", None, ""), ("D", None, "duplicate")]


def test_repaired_texts_stay(spark):
    df = spark.createDataFrame([(1, 0, "user", "q?"), (1, 1, "user", "more?"), (1, 2, "assistant", "yes."), (1, 3, "user", "")], "conv_id long, turn long, role string, text string")
    kept = [(r.edit, r.role, r.text) for r in conversations.repaired(df).collect()]
    assert kept == [("D", None, "q?"), ("K", "user", "more?"), ("K", "assistant", "yes."), ("D", None, "")]


# --- URL filters


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "https://example.com/en/1", "https://example.com/EN/1", "https://a.b.example.com/en/", "https://notexample.com/en/", "http://x.net/es/1", "http://net/fr/", "http://x.net/de/", "ftp://com", "ftp://com/", "x://q.com?/en/", "://a.net/fr/#", "http://a.com/b://c.net/es/", "é://ÄB.com/ü", "http://x.org/" + "p/" * 40_000]


def by_hand(url):
    host = path = ""
    if url and "://" in url:
        host, path = re.fullmatch(r"(?s)([^/?#]*)([^?#]*).*", url.partition("://")[2]).groups()
        host = host.translate({i: i + 32 for i in range(65, 91)})
    fits = [r for r in url_filter.RULES if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def test_url_rules_by_hand(spark):
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS)] + [(None, URLS[5], "h", "p"), (5, URLS[5], "h", "p")], "page_id long, url string, host string, path string")
    rows = url_filter.filter_urls(df).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        host, path, rule, verdict = by_hand(URLS[5 if r.page_id is None else r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    assert url_filter.filter_urls(df.limit(0)).collect() == []


def test_url_classifier_from_a_given_table(spark):
    """Held-out accuracy on hosts it has not seen."""
    rng = random.Random(5)
    url = lambda bad: f"https://{''.join(rng.choices('abcdef', k=6))}.org/{'win-cash' if bad else 'articles'}/{rng.randint(0, 9999)}"
    table = spark.createDataFrame([(url(i % 2), "block" if i % 2 else "allow") for i in range(200)], "url string, verdict string")
    pages = spark.createDataFrame([(i, url(i % 2)) for i in range(200)], "page_id long, url string")
    rows = url_filter.filter_urls(pages, labelled=table).collect()
    assert sum((r.verdict == "block") == bool(r.page_id % 2) for r in rows) >= 196


def test_url_classifier_on_rules_it_has_not_seen(spark):
    """Learnt from half of the URLs that rules judge, tried on the other half, whose rules it doesn't see."""
    pages = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/pages.parquet")
    ruled = url_filter.judged_by_rules(pages.select("page_id", "url")).where("ruled IS NOT NULL")
    table = ruled.where("page_id % 2 = 0").select("url", F.col("ruled").alias("verdict"))
    other = ruled.where("page_id % 2 = 1")
    out = url_filter.filter_urls(other.select("page_id", "url"), rules=(), labelled=table).join(other.select("page_id", "ruled"), "page_id")
    right, n = out.agg(F.count_if(F.col("verdict") == F.col("ruled")), F.count(F.lit(1))).first()
    assert right / n > 0.97


# --- decontamination: names at a sentence's start, short items


def test_names_at_the_start_of_a_sentence(spark):
    items = ["Tom has 12 apples and 7 pears", "Tom Smith paid 30 dollars for 5 kg of rice", "What is 12 + 7", "Yes", "There were 3 birds in a tree. Tom saw 9 of them fly away to the big lake near his town"]
    texts = [
        "Ann has 95 apples and 3 pears", "well. Ann Jones paid 41 dollars for 6 kg of rice!", "so What is 12 + 7 then", "yes", "Yes and so on", "What is 13 + 7", "clean words " * 20, "Ann has 7 apples and 7 pears",
        "There were 5 birds in a tree. Ann saw 8 of them fly away to the big lake near his town", "the small lake. Ann saw 8 of them fly away to the big lake near his town", None, "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.kind for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert found == {(0, 0): "reparameterised", (1, 1): "reparameterised", (2, 2): "verbatim", (3, 3): "verbatim", (8, 4): "verbatim", (9, 4): "verbatim"}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, benchmark).collect()} == {4, 5, 6, 7, 10, 11}


@pytest.mark.parametrize("bound", ["BROADCAST_WINDOWS", "BROADCAST_IDS"])
def test_decontamination_by_shuffle_joins(spark, monkeypatch, bound):
    docs, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, decontaminate.contaminated(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, bound, 0)
    assert want and sorted(map(tuple, decontaminate.contaminated(docs, benchmark).collect())) == want


# --- mixing: the permutation, and each document's share by hand


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_permutations(n):
    orders = {tuple(mixing.permuted(np.arange(n), np.full(n, n), seed).tolist()) for seed in range(60)}
    assert all(sorted(x) == list(range(n)) for x in orders)
    assert len(orders) > min(60, math.factorial(min(n, 8))) // 2
    if n > 100:  # neighbours don't stay neighbours
        assert all(sum(abs(a - b) == 1 for a, b in itertools.pairwise(x)) < 12 for x in orders)


def test_permutations_of_huge_sources():
    n = 10**18 + 7
    some = np.concatenate((np.arange(5000), n - 1 - np.arange(5000)))
    with np.errstate(over="raise"):
        places = mixing.permuted(some, np.full(len(some), n), 5)
    assert len(set(places.tolist())) == len(some) and (places >= 0).all() and (places < n).all()
    assert abs(places.astype(float).mean() / n - 0.5) < 0.02
    mixed = mixing.permuted(np.array([4, 4, 7]), np.array([9, 10**12, 9]), 5)
    assert mixed.tolist() == [int(mixing.permuted(np.array([b]), np.array([s]), 5)[0]) for b, s in ((4, 9), (4, 10**12), (7, 9))]


def test_words_taken_of_each_document_by_hand(spark):
    """A plain list of each source's blocks, those drawn cut out of it, against taken."""
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randint(0, 90)), rng.choice(["a", "a", "b", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.plan_mix(df, block_words=16, shards=4).collect()
    at = {r.doc_id: r.at for r in df.select("doc_id", F.xxhash64("doc_id", F.lit(17)).alias("at")).collect()}
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    want = mixing.targets(dict(sizes))
    for source, size in sizes.items():
        # The order of ranges is that of unsigned hashes, within a range that of signed ones.
        own = sorted((r for r in rows if r[2] == source), key=lambda r: ((at[r[0]] & (1 << 64) - 1) >> 58, at[r[0]], r[0]))
        stream = [d for d, text, _ in own for _ in text.split()]
        whole, rest = divmod(round(want[source]), size)
        blocks = [stream[i : i + 16] for i in range(0, size, 16)]
        rank = mixing.permuted(np.arange(len(blocks)), np.full(len(blocks), len(blocks)), 19)
        taken = collections.Counter(stream * whole)
        for b in sorted(range(len(blocks)), key=lambda b: rank[b]):
            taken.update(blocks[b][:rest])
            rest -= len(blocks[b][:rest])
        assert {r.doc_id: r.taken for r in out if r.source == source} == {d: taken[d] for d, _, _ in own}


def test_mixing_by_shuffle_joins(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, mixing.mix_digest(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix_digest(docs).collect())) == want


# --- the word model's files


def test_an_absent_shard_is_an_error(spark):
    texts = spark.createDataFrame([(f"a b c w{i % 9} d e",) for i in range(200)], "text string")
    model = ngram_lm.train(texts)
    shard = int(model.words.written[0])
    folder = ngram_lm.local_folder(model.words.path)
    empty = next(i for i in range(1 << model.words.bits) if i not in set(model.words.written.tolist()))
    assert model.words.open(empty) is None
    os.rename(f"{folder}/shard={shard}", f"{folder}/gone")
    ngram_lm._mapped.clear()
    with pytest.raises(FileNotFoundError):
        model.words.open(shard)


def test_few_maps_give_the_same_scores(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    model = ngram_lm.train(docs.select("text"))
    data = "the of and a to in is you that it".encode()
    h, rows = ngram_lm.token_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    run = lambda: model.log10(h, rows, model.singles(h)[1])
    want = run()
    monkeypatch.setattr(ngram_lm, "MOST_MAPPED", 1)
    ngram_lm._mapped.clear()
    assert (run() == want).all() and len(ngram_lm._mapped) == 1


def test_model_paths_are_qualified(spark):
    assert ngram_lm.qualified(spark, "/tmp/x y") == "file:/tmp/x y"
    assert ngram_lm.local_folder("file:/tmp/x") == "/tmp/x"
