"""Filter audit, ranked search and exact deduplication against plain versions."""

import hashlib
import itertools
import math
import os
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute

from spiketide.llm import audit, exact, lexical

rng = np.random.default_rng(1)
COMMON, RARE = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(400)]
DOCS = "doc_id long, text string, lang string, part string, mask int, digest string, id long, n long, item string"


def prose(n):
    return " ".join(rng.choice(COMMON if rng.random() < 0.7 else RARE) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    """Nulls, empty texts, copies in other cases, repeated rows, repeated and null ids, a long text, ties."""
    texts = [prose(n) for n in (5, 40, 120, 300, 130, 9, 60, 200)] + [None, "", "  \n", "ONE Two", "one two", "A$B", "Ünï Cödé Ü ÜB", "ünï cödé ü üb", "x" * 300, "W" * 99]
    texts += [prose(20_000), texts[3], texts[3].upper(), texts[2], "c1 r1", "c1 r1", "C1 r1"]
    rows = [(i, t, ["en", "de", None, ""][i % 4]) for i, t in enumerate(texts)]
    return rows + [(3, texts[3], "en"), (3, texts[3], "en"), (None, texts[3], "de"), (None, None, None), (5, "another text", "fr"), (40, prose(110) + " #", "en")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, x, "p", 1, "g", None, 7, "i") for d, t, x in rows], DOCS).repartition(3)


def audited(docs, good, toxic):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    parts = defaultdict(list)
    for d, t, lang in docs:
        t = t or ""
        fails = {
            "A": len(words(t)) < 100, "B": 100 * len(set(words(t))) < 80 * len(words(t)), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > least[t],
        }
        parts[lang or ""].append((fails, d in good, d in toxic))
    out, total = {}, Counter()
    for part, rows in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for k, f in enumerate(order):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                fails = [r for r in rows if r[0][f]]
                alone = sum(sum(r[0].values()) == 1 for r in fails)
                out[part, order, k + 1] = (len(left), len(gone), len(fails) - len(gone), alone, sum(r[1] for r in gone), sum(r[2] for r in gone))
                total[part, f] += len(gone)
    return sorted((*key, *v, total[key[0], key[1][key[2] - 1]]) for key, v in out.items())


def test_audit(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 1), (3, 0, 0), (18, 0, 1), (40, 1, None), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = audit.orders(audit.masks(frame(spark, docs), labels))
    assert sorted(tuple(r) for r in found.collect()) == audited(docs, {1, 3, 40}, {3, 18})
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_of_nothing(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.orders(audit.masks(frame(spark, docs).filter("false"), labels)).isEmpty()


def ranked(docs, items, k):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", brute.lower(t))
    bags = [(d, Counter(cut(t))) for d, t, _ in docs]
    count, length = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    asked = defaultdict(set)
    for item, text in items:
        if item is not None:
            asked[item] |= set(cut(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for d, bag in bags:
            n, score = bag.total(), 0
            for t in terms & bag.keys():
                m = 100 - 50 + 50 * n * count // length
                score += math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


ITEMS = [(1, "c1 C2 c3 r1 r2 r3"), (2, "r5 r6 unknown"), (3, None), (4, "unknown words"), (5, ""), (None, "c1"), (1, "r9 one"), (6, " ".join(COMMON)), (7, "Ünï ünï c4"), (8, "c1"), (9, " ".join(RARE[:60]))]


@pytest.mark.parametrize(("k", "block"), [(3, 1 << 16), (50, 1 << 16), (5, 20)])
def test_search(spark, docs, monkeypatch, k, block):
    monkeypatch.setattr(lexical, "BLOCK_WORDS", block)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = lexical.search(frame(spark, docs), items, k).select("item", "place", "id", "score")
    assert sorted((tuple(r) for r in found.collect()), key=lambda r: r[:2]) == ranked(docs, ITEMS, k)


def test_search_through_all_tiers(spark, monkeypatch):
    """Many documents, so that tiers differ, some items are proven early and others fall through."""
    many = [(i, prose(int(rng.integers(1, 60))), "en") for i in range(1500)]
    many += [(2000 + i, " ".join(RARE[:60]), "en") for i in range(8)]
    rounds, old = [], lexical._round
    monkeypatch.setattr(lexical, "_round", lambda index, tiers, lists, *a: rounds.append((tiers, len(lists))) or old(index, tiers, lists, *a))
    monkeypatch.setattr(lexical, "CELLS", 1000)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = lexical.search(frame(spark, many), items, 6).select("item", "place", "id", "score")
    assert sorted((tuple(r) for r in found.collect()), key=lambda r: r[:2]) == ranked(many, ITEMS, 6)
    assert rounds[0] == (1, 9) and rounds[-1][0] > 1 and rounds[1][1] < 9


def test_sums_are_exact_beyond_doubles():
    cells, values = rng.integers(0, 5, 1000), rng.integers(2**50, 2**52, 1000)
    assert lexical._sums(cells, values, 5).tolist() == [sum(int(v) for c, v in zip(cells, values, strict=True) if c == x) for x in range(5)]


def test_search_of_nothing(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(frame(spark, docs).filter("false"), items).isEmpty()
    assert lexical.search(frame(spark, docs), items.filter("false")).isEmpty()


def copies(docs):
    groups = defaultdict(list)
    for d, t, _ in docs:
        groups[brute.lower(t)].append(d)
    keep = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    return sorted(((d, keep[brute.lower(t)], len(groups[brute.lower(t)]), hashlib.sha256(brute.lower(t).encode()).hexdigest()) for d, t, _ in docs), key=str)


@pytest.mark.parametrize(("key_bytes", "batch"), [(16, None), (1, None), (0, {"maxFilesPerTrigger": "1"}), (16, {"maxFilesPerTrigger": "1"})])
def test_exact(spark, docs, tmp_path, key_bytes, batch):
    """Short keys make texts share them, so bytes decide; single files make every hit one on state of a former batch."""
    frame(spark, docs).repartition(4).write.parquet(f"{tmp_path}/docs")
    found = exact.deduplicate(spark, f"{tmp_path}/docs", f"{tmp_path}/folder", key_bytes=key_bytes, batch=batch).collect()
    assert sorted(((r["id"], r["keep_id"], r["n"], r["sha"]) for r in found), key=str) == copies(docs)
    kept = [(r["id"], r["sha"]) for r in found if r["kept"]]
    assert len(kept) == len({r["sha"] for r in found}) == len(set(kept))
    assert all(r["id"] == r["keep_id"] for r in found if r["kept"])


def test_exact_takes_up_new_files(spark, docs, tmp_path):
    path, folder = f"{tmp_path}/docs", f"{tmp_path}/folder"
    frame(spark, docs[:15]).write.parquet(path)
    assert exact.deduplicate(spark, path, folder).count() == 15
    frame(spark, docs[15:]).write.mode("append").parquet(path)
    found = exact.deduplicate(spark, path, folder).collect()
    assert sorted(((r["id"], r["keep_id"], r["n"], r["sha"]) for r in found), key=str) == copies(docs)


def test_exact_of_nothing(spark, docs, tmp_path):
    frame(spark, docs).filter("false").write.parquet(f"{tmp_path}/docs")
    assert exact.deduplicate(spark, f"{tmp_path}/docs").isEmpty()


def test_normalised_changes_nothing_but_ascii_capitals(spark):
    texts = ["ABC xyz É İ ẞ", "PLAIN Ascii 123", "", None, "ǅ Σ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(exact.normalised(F.col("t"))).collect()
    assert [r[0] for r in rows] == [brute.lower(t) for t in texts]
