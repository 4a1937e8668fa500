"""Lines that documents share, lexical search and spelling variants against brute force, with odd rows and small limits."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewright.llm import entries, lexical, lines, variants
from lorewright.llm.treap import Treap

DOC = "doc_id long, text string, line string, h1 long, rec string"
ODD = [(None, "x" * 50, "a", 1, "r"), (None, "x" * 50 + "\n", "a", 1, "r"), (50, "", "a", 1, "r"), (51, None, None, None, None), (52, "ab " * 40_000, "a", 1, "r")]


def docs_of(spark, texts):
    rows = [(i, t, "a", 1, "r") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *rows[:2], *ODD], DOC)


def brute_lines(rows, least=40, documents=5):
    holds = {}
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                holds.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        gone = lambda x: len(h := holds.get(key(x), ())) >= documents and i != max(h, key=lambda d: (d is not None, d))  # noqa: E731, B023
        kept = [x for x in every if not gone(x)]
        out.append((i, "\n".join(kept), len(every), len(every) - len(kept)))
    return out


@pytest.mark.parametrize("hot", [lines.HOT_KEYS, 3])
def test_lines_of_many_documents_go(spark, monkeypatch, hot):
    monkeypatch.setattr(lines, "HOT_KEYS", hot)
    r = random.Random(5)
    common = [f"Shared line number {k} " + "é" * (18 + k % 5) for k in range(12)]
    texts = []
    for i in range(40):
        own = [r.choice([x, x.upper().replace("É", "é"), f" \t{x}\r"]) for x in r.choices(common, k=r.randint(0, 6))]
        texts.append("\n".join([*own, f"only here {i} " + "z" * 60, common[0], common[0]]))
    df = docs_of(spark, texts)
    got = lines.shared_lines(df).select("rec.doc_id", "kept", "n_lines", "n_dropped").collect()
    want = brute_lines([(x.doc_id, x.text) for x in df.collect()])
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and sum(x[3] for x in want) > 40
    assert lines.shared_lines(df.limit(0)).count() == 0
    assert lines.shared_lines(df.filter("false")).columns == ["rec", "kept", "n_lines", "n_dropped"]


def brute_search(items, rows, k=20):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    held = [(i, Counter(split(t))) for i, t in rows]
    n_docs, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            n, score = sum(c.values()), 0
            for t in split(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * (75 + 25 * n * n_docs // total)))
            if score > 0:
                found.append((-score, i is not None, i if i is not None else 0, i))
        out += [(item, rank + 1, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("limits", [(lexical.BLOCK, lexical.ENTRIES, lexical.RANGE), (60, 40, 7)])
def test_search_equals_brute_force(spark, monkeypatch, limits):
    for name, value in zip(("BLOCK", "ENTRIES", "RANGE"), limits, strict=True):
        monkeypatch.setattr(lexical, name, value)
    r = random.Random(6)
    words = [f"w{k}" for k in range(60)] + ["É", "éa", "7b"]
    texts = [" ".join(r.choices(words, k=r.randint(0, 30))) for _ in range(120)] + ["W1 w1, w1!"] * 30
    df = docs_of(spark, texts)
    items = [(1, "w1 w2 w2 É"), (2, None), (3, "nothing-here"), (1, "W5 7b w59"), (None, "w3 éa")]
    it = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.lexical_search(it, df).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_search(items, [(x.doc_id, x.text) for x in df.collect()])))
    assert lexical.lexical_search(it.limit(0), df).count() == 0 and lexical.lexical_search(it, df.limit(0)).count() == 0


def test_treap_finds_the_best_of_every_least(monkeypatch):
    rng = np.random.default_rng(7)
    dense = np.where(rng.random((37, 200)) < 0.2, rng.integers(1, 6, (37, 200)), 0)
    row, column = np.nonzero(dense)
    tree = Treap(row, column, dense[row, column], 37, 200)
    for at_once in (1, 3, 256):
        monkeypatch.setattr("lorewright.llm.treap.AT_ONCE", at_once)
        for least in (0, 4, 9, 1000):
            rows, times = np.array([0, 5, 36, 7]), np.array([1, 2, 1, 3])
            score = (dense[rows] * times[:, None]).sum(axis=0)
            want = sorted(((int(s), -c) for c, s in enumerate(score) if s > least), reverse=True)[:10]
            assert tree.best(rows, times, 10, least) == [(s, -c) for s, c in want]
    assert Treap(row[:0], column[:0], row[:0], 3, 3).best(np.array([1]), np.array([1]), 3) == []


def brute_variants(words, ratio=5):
    one = lambda a: {a[:i] + a[i + 1 :] for i in range(len(a))}
    masks = {}
    for w in words:
        for i in range(len(w)):
            masks.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for w in words:
        near[w] |= {o for i in range(len(w)) for o in masks[w[:i], w[i + 1 :]]} - {w}
        for o in one(w) & words.keys():
            near[w].add(o)
            near[o].add(w)
    form = {w: min(near[w], key=lambda x: (-words[x], x)) if near[w] else None for w in words}
    form = {w: f if f and words[f] >= ratio * words[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else 0) for w, n in words.items())


def shown(df):
    return sorted((x.word, x.form or "", x.root, x.n, x.n_near, x.form_n or 0) for x in df.collect())


@pytest.mark.parametrize("limits", [(20_000, 1_000, 8), (12, 4, 2), (5, 2, 1)])
def test_variants_equal_brute_force(spark, monkeypatch, limits):
    for name, value in zip(("SHARD_MOST", "SHARD_LEAST", "LEAF"), limits, strict=True):
        monkeypatch.setattr(variants, name, value)
    r = random.Random(8)
    words = {}
    for _ in range(60):
        w = "".join(r.choices("abeèéê", k=r.randint(4, 8)))
        words[w] = r.randint(1, 4000)
        for _ in range(4):
            k = r.randrange(len(w))
            words[r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abé") + w[k:], w[:k] + r.choice("abé") + w[k + 1 :]])] = r.randint(1, 400)
    words |= {"a" * 40: 9, "a" * 41: 100, "a" * 42: 9000, "x" * 5000: 7, "x" * 4999 + "y": 70}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert shown(variants.variants(df)) == brute_variants(words)
    assert variants.variants(df.limit(0)).count() == 0


def test_many_words_of_one_vector_are_looked_up(spark, monkeypatch):
    """All words of four accented letters that share a group, and their neighbours: a leaf that no count can split."""
    monkeypatch.setattr(variants, "SHARD_MOST", 50)
    monkeypatch.setattr(variants, "SHARD_LEAST", 50)
    same = [c for c in map(chr, range(0xE0, 0x100)) if ord(c) % variants.OTHERS == 0]
    words = {a + b + c + d: 1 + i for i, (a, b, c, d) in enumerate((a, b, c, d) for a in same for b in same for c in same[:3] for d in same[:2])}
    words |= {w[:3]: 900 for w in list(words)[::7]} | {w + "a": 3 for w in list(words)[::11] if len(w) == 4}
    assert shown(variants.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == brute_variants(words)


def test_words_are_counted_and_slip(spark, data):
    df = docs_of(spark, ["Naïve naïve×÷ NAïVE, ÀÉ", "word's words"])
    got = {x.word: x.n for x in variants.word_counts(df, least_length=2, least_count=1).collect()}
    # two rows twice, and the long text
    assert got["naïve"] == 4 and got["naïve×÷"] == 2 and got["ÀÉ"] == 2 and got["words"] == 2 and got["ab"] == 40_000
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = Counter()
    for x in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", x.text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{x.doc_id}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    assert shown(entries.QUERIES["op11_spelling_variants"](spark, data)) == brute_variants(words)


def test_digests_of_registered_lines(spark, data):
    out = entries.QUERIES["op13_line_dedup"](spark, data)
    texts = [(x.doc_id, x.text) for x in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = {i: (n, g, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, g in brute_lines(texts)}
    assert {x.doc_id: (x.n_lines, x.n_dropped, x.kept_sha256) for x in out.collect()} == want
    assert out.agg(F.count("*")).first()[0] == len(texts)
