"""Operators against brute force, exact round trips and held-out accuracy, with the cases that may trip them."""

import hashlib
import math
import os
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lorewright.llm import ann, bpe, common, dedup, hashing, html, pii, ppm, quality, suffixes, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, sig string, rid string, uid int"


def odd_docs(spark, texts):
    """Texts with ids, then nulls, an empty text, a long one and a repeated row; extra columns with clashing names."""
    rows = [(i, t, "en", "s", "x", "x", "x", 1) for i, t in enumerate(texts)]
    n = len(rows)
    rows += [(n, None, None, None, None, None, None, None), (n + 1, "", "en", "s", "x", "x", "x", 1), (n + 2, "long text " * 30_000, "en", "s", "x", "x", "x", 1)]
    rows += [(n + 3, "same row here", "en", "s", "x", "x", "x", 1)] * 2
    return spark.createDataFrame(rows, SCHEMA)


def sentences(n, seed=1, words=400):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(words)]
    return [" ".join(rng.choice(vocab) for _ in range(rng.randint(20, 90))) for _ in range(n)]


def test_bpe_equals_library(spark):
    path = bpe.default_path()
    lib, own = Tokenizer.from_file(path), bpe.encoder(open(path, encoding="utf-8").read())
    texts = ["", "don't 'sun it's !'s", "ΑΣ ΣΑΣ", "a\x1cb \x00x", "<|endoftext|>hi", "İ ǅ ß ﬁ", "日本語 🎉🎉 éa", "aaaaaaaaaaaaaaa 1234567", "x" * 3000, " a　b", "he'll'll ''''", *sentences(20)]
    for t in texts:
        ids = [int(i) for e in own.text(t) for i in e[0].split()]
        assert ids == lib.encode(t, add_special_tokens=False).ids
        assert own.decode(ids) == " ".join(e[1] for e in own.text(t)) == lib.decode(ids, skip_special_tokens=False)
    df = odd_docs(spark, texts)
    rows = bpe.encode(df, path).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() == r.ids_sha256 and r.n_tokens == len(r.ids)
    assert bpe.encode(df.limit(0), path).count() == 0


def test_pii_base_kinds_equal_patterns(spark):
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice("0123456789 .-+()a@b.") for _ in range(60))
        want = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        digits = lambda s: re.sub(r"\D", "", s)
        want += [(m.start(), "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        want += [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
        assert [s for s in pii.spans(t) if s[1] in pii.BASE] == sorted(want, key=lambda x: (x[0], pii.ORDER[x[1]]))
    t = 'api_key = "abcdef123456" and ssn 123-45-6789, https://user:pw@host.org, IBAN DE89370400440532013000.'
    assert [s[1] for s in pii.spans(t)] == ["secret", "ssn", "login", "email", "iban"]
    assert "abcdef" not in pii.redacted(t, pii.spans(t))
    df = odd_docs(spark, [t])
    assert pii.find(df).count() == df.count() and pii.redact(df).columns == df.columns
    assert pii.find(df.limit(0)).count() == 0


def test_pii_numbers_of_any_length():
    zeros = "0" * 5000
    assert [x[1] for x in pii.spans(f"{zeros}1.1.1.1 and 1.2.3.{'9' * 5000} and 000.0.00.{zeros}")] == ["ip", "ip"]


def test_word_hashes_tell_words_apart():
    flip = str.maketrans("ab", "ba")
    t = "a"
    while len(t) < 4096:
        t += t.translate(flip)
    words = [w[:n] for n in (1, 7, 8, 9, 64, 255, 256, 257, 1024, 4096) for w in (t, t.translate(flip))]
    h = hashing.word_hashes(np.frombuffer(" ".join(words).encode(), np.uint8))
    assert len(set(h.tolist())) == len(words)
    again = hashing.word_hashes(np.frombuffer(("x  " + "\n".join(words)).encode(), np.uint8))
    assert again[1:].tolist() == h.tolist()
    assert len(hashing.word_hashes(np.zeros(0, np.uint8))) == 0


def brute_components(texts, percent=80, width=4):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark):
    rng, texts = random.Random(9), sentences(30)
    base = sentences(1, 4)[0].split() * 2
    for _ in range(60):  # a group that hangs together by chains
        w = base[:]
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(["q1", "q2", "q3", "q4"])
        texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), "one", "one", "two words", ""]
    df = odd_docs(spark, texts)
    want = brute_components({r.doc_id: r.text for r in df.collect()})
    out = dedup.near_duplicates(df).collect()
    assert len(out) == df.count()
    for r in out:
        assert (r.n_shingles, r.component_id) == want[r.rec.doc_id]
    kept = [r for r in out if r.first]
    assert len(kept) == len({want[r.rec.doc_id][1] for r in out if r.n_shingles}) + sum(r.n_shingles == 0 for r in out)
    assert dedup.near_duplicates(df.limit(0)).count() == 0


def test_large_buckets_go_through_prefix_join(spark, monkeypatch):
    rng, base = random.Random(2), sentences(1, 8)[0].split() * 3
    texts = []
    for k in range(80):
        w = base[:]
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = f"z{k}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(dedup, "SMALL", 2)
    want = brute_components(dict(enumerate(texts)))
    assert {r.rec.doc_id: (r.n_shingles, r.component_id) for r in dedup.near_duplicates(df).collect()} == want


def test_templates_under_the_threshold_give_no_pairs(spark, monkeypatch):
    shared = [f"t{k}" for k in range(8)]
    texts = [" ".join([*shared, f"own{i}"]) for i in range(300)]  # five shared shingles of six: 5 / 7
    texts += [" ".join(["u", *shared, *(f"w{k}" for k in range(20)), f"x{i % 3}"]) for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(dedup, "SMALL", 2)
    found = []
    screen = dedup.screen
    monkeypatch.setattr(dedup, "screen", lambda pairs, *a: (found.append(pairs.count()), screen(pairs, *a))[1])
    out = {r.rec.doc_id: (r.n_shingles, r.component_id) for r in dedup.near_duplicates(df).collect()}
    assert out == brute_components(dict(enumerate(texts)))
    assert found[-1] < 100 and max(found) < 12 * len(texts)  # the prefix join; the rounds before it


@pytest.mark.parametrize("part_rows", [400_000, 50])
def test_repeated_passages_equal_brute_force(spark, monkeypatch, part_rows):
    monkeypatch.setattr(suffixes, "PART_ROWS", part_rows)
    rng, texts = random.Random(4), sentences(40)
    passage = "this passage of more than fifty bytes is found in many of the documents"
    texts += [f"{rng.random()} {passage} {rng.random()}" for _ in range(30)] + ["ab" * 90, "ab" * 70, texts[3], texts[3][7:], "é" * 60, "é" * 40]
    df = odd_docs(spark, texts)
    rows = {r.doc_id: (r.text or "").encode() for r in df.collect()}
    least = {}
    for i, b in sorted(rows.items()):
        for s in range(len(b) - 49):
            least.setdefault(b[s : s + 50], i)
    out = suffixes.deduplicate(df).collect()
    assert len(out) == df.count()
    for r in out:
        b = rows[r.doc_id]
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - 49):
            if least[b[s : s + 50]] < r.doc_id:
                gone[s : s + 50] = 1
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(b), int(gone.sum()), hashlib.sha256(kept).hexdigest())
        assert r.n_spans == int((np.diff(gone, prepend=0) == 1).sum())
    assert suffixes.deduplicate(df.limit(0)).count() == 0


def test_staged_tables_leave_no_shuffle_files(spark):
    disks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    written = lambda: {n.rsplit("_", 2)[0] for d in disks for _, _, names in os.walk(d) for n in names if n.startswith("shuffle_")}
    before = written()
    df = spark.range(1000).selectExpr("id", "id % 7 as k").groupBy("k").applyInArrow(lambda t: t, "id long, k long")
    table = common.stage(df, "test")
    end = time.time() + 3  # executors delete them on their own
    while written() - before and time.time() < end:
        time.sleep(0.1)
    assert not written() - before
    assert spark.conf.get(common.FREED) == "false" and sorted(r.id for r in table.collect()) == list(range(1000))


def test_multikey_order_is_lexicographic():
    rng = np.random.default_rng(1)
    words, ids = rng.integers(0, 3, (500, 4)).astype(np.uint64), rng.integers(0, 3, 500)
    order = suffixes.multikey_order(words, ids)
    keys = [(*words[i], ids[i]) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(500))


def test_ppm_is_a_distribution_and_learns(spark):
    texts = sentences(60)
    df = odd_docs(spark, texts)
    counts = ppm.count(df.filter(ppm.fold(df.doc_id) != 2)).cache()
    model = ppm.build(counts)
    for context in (b"", b"abc", texts[0].encode()[:40], b"zzzzz", bytes([200, 201])):
        x = np.frombuffer(context, np.uint8)
        last = ppm.codes(x)[-1] >> np.uint64(8) << np.uint64(8)
        p = 10 ** model.log10(np.arange(256, dtype=np.uint64) | last)
        assert p.sum() == pytest.approx(1, abs=1e-9)
    rows = {r.doc_id: r for r in ppm.score(df, counts).collect()}
    train = [r for r in df.collect() if not rows[r.doc_id].held_out]
    words = [w for r in train for w in (r.text or "").encode().lower().split()]
    n, v = len(words) + len(train), len(set(words)) + 1
    for r in df.collect():
        w = (r.text or "").encode().lower().split()
        base = sum(math.log10((words.count(x) + 1) / (n + v + 1)) for x in w[:200]) if len(w) <= 200 else None
        assert rows[r.doc_id].n_tokens == len(w) + 1 and rows[r.doc_id].train_tokens == n
        if base is not None:
            assert rows[r.doc_id].base_score == pytest.approx(base + math.log10((len(train) + 1) / (n + v + 1)))
    assert ppm.score(df.limit(0), counts).count() == 0


@pytest.mark.parametrize("rare", [2.0**-23, 2.0**-7, 2.0])
def test_ppm_scores_by_every_counted_run(spark, monkeypatch, rare):
    monkeypatch.setattr(ppm, "RARE", rare)
    monkeypatch.setattr(ppm, "CHUNK", 3000)
    df = odd_docs(spark, [*sentences(60), *(f"only here: {i} {t[:40]}" for i, t in enumerate(sentences(30, 7)))])
    counts = ppm.count(df.filter(ppm.fold(df.doc_id) != 2)).cache()
    n = {r.key: r.n for r in counts.filter("kind = 1").collect()}
    runs = []
    for j in range(ppm.ORDER + 1):
        found = {}
        for key, times in n.items():
            short = key & ((1 << (8 * (j + 1))) - 1)
            found[short] = found.get(short, 0) + times
        keys = np.array(sorted(found), np.uint64)
        runs.append((keys, np.array([found[int(k)] for k in keys], float)))
    model = ppm.Model(runs, sum(n.values()))
    for r, text in [(r, text) for r in ppm.score(df, counts).collect() for text in [t.text for t in df.collect() if t.doc_id == r.doc_id][:1]]:
        assert r.score == pytest.approx(model.log10(ppm.codes(ppm.lowered(text))).sum(), abs=1e-6)
    nothing = ppm.count(df.limit(0))
    for r in ppm.score(df.filter("doc_id < 3"), nothing).collect():
        assert r.score == pytest.approx(-math.log10(256) * (len(sentences(60)[r.doc_id].encode()) + 1))


PAGE = """<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><header>Site name</header><nav><a href="/">Home</a></nav>
<div class="cookie-notice">We use cookies.</div><main><article><header><h1>The title &amp; more</h1></header><p>First   para<b>graph</b> with<br>words
 in it, and some more.</p><p>Short.</p><aside>Related</aside><p>Last one&#33;</p></article><section id="comments"><p>A reader writes at length about what was said in this article.</p></section></main>
<form><p>Send us mail</p></form><footer>&copy; us</footer></body></html>"""


def test_html_main_text(spark):
    want = "The title & more\nFirst paragraph with words in it, and some more.\nShort.\nLast one!"
    assert html.main_text(PAGE) == want
    long_ = "This is a long sentence about the subject of this page, with a good many words in it. " * 3
    plain = f"<body><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul><div><p>{long_}<p>Brief.<p>{long_}</div><div class='ad'>Buy now</div>"
    assert html.main_text(plain) == "\n".join([long_.strip(), "Brief.", long_.strip()])
    for odd in ("", "<", "<p", "no tags at all", "<p>" * 2000, "</div></div>", "<script>never closed", "<!-- open", "<a href=\"x>y"):
        html.main_text(odd)
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (2, None, None, "x")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.n_chars) for r in html.extract(df).collect()) == [(1, len(want)), (2, 0), (2, 0)]
    assert html.extract(df.limit(0)).count() == 0


LONG = "This is a long sentence about the subject of this page, with a good many words in it. " * 3


@pytest.mark.parametrize(
    "around",
    [
        "<body class='no-sidebar'>{}</body>", "<body class='comments-open'><main>{}</main></body>", "<body><article class='post tag-legal'>{}</article></body>",
        "<body><form id='aspnet'><div>{}</div></form></body>", "<div class='page-with-sidebar'><article>{}</article><div>More.</div></div>",
        "<body><a name='top'><div>{}</div></body>", "<body><a href='/x'>Unclosed<div>{}</div></body>", "<body><svg><path d='x'><div>{}</div></body>", "<body><object data='x'><div>{}</div></body>",
    ],
)
def test_html_keeps_articles_in_common_markup(around):
    text = html.main_text(around.format(f"<p>{LONG}</p><p>{LONG}</p>"))
    assert text.count(LONG.strip()) == 2
    side = html.main_text(around.format(f"<p>{LONG}</p><p>{LONG}</p><div class='sidebar'><p>Buy this and that.</p></div><ul><li><a href=x>One link of some words</a></li></ul>"))
    assert side == text


def test_html_leaves_out_related_articles_and_block_links():
    cards = "".join(f"<article><a href='/{k}'><h3>Another story {k}</h3><p>What it is about.</p></a></article>" for k in range(4))
    page = f"<body class='comments-open'><div class='page-sidebar'><article><p>{LONG}</p><p>{LONG}</p></article></div><div class='related'>{cards}</div><p>{LONG}</p></body>"
    text = html.main_text(page)
    assert text.count(LONG.strip()) == 3 and "Another story" not in text


def test_html_time_is_in_proportion_to_the_page():
    n = 60_000
    for page in ('<a "x ' * n, '<a "' + '>" <a "' * n, "<div>" * n + "</nav>" * n, "<a " + "b" * 8 * n + ">", "<!x " * n, '<a "x ' * n + ">", "<!--" * n):
        began = time.process_time()
        html.blocks(page)
        assert time.process_time() - began < 5
    assert html.main_text(f'<p title="a > b" data-x=\'"\'>{LONG}</p>') == LONG.strip()


def test_min_cut_equals_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(1, 7)
        s, t = [rng.random() for _ in range(n)], [rng.random() for _ in range(n)]
        e = [(a, b, rng.random()) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        cost = lambda side: sum(t[i] if side[i] else s[i] for i in range(n)) + sum(c for a, b, c in e if side[a] != side[b])  # noqa: E731, B023
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(2**n))
        assert cost(html.min_cut(s, t, e)) == pytest.approx(best)


def test_nearest_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:900] = x[700]  # repeated rows
    rows = [(i, [float(c) for c in v], "x") for i, v in enumerate(x)]
    rows += [(5000, None, "x"), (5020, [0.0] * 16, "x"), (5040, [float("nan")] * 16, "x"), (5060, [1.0, 2.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard string")
    v = ann.valid(df)
    out = ann.nearest(ann.build_index(v, 400), v.filter("vec_id % 20 = 0"), 20, 16).collect()
    got = {}
    for r in out:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = []
    d = x.astype(np.float64)
    for q, near in got.items():
        near.sort()
        assert [r for r, _, _ in near] == list(range(1, len(near) + 1)) and q not in [i for _, i, _ in near]
        if q < 1500:
            s = d @ d[q]
            assert [p for _, _, p in near] == pytest.approx([s[i] for _, i, _ in near])
            s[q] = -np.inf
            best = set(np.sort(s)[-20:].tolist())
            hits.append(np.mean([p >= min(best) - 1e-9 for _, _, p in near]))
    assert np.mean(hits) > 0.9 and set(got) == set(range(0, 1500, 20))
    assert ann.nearest(ann.build_index(v.limit(0)), v.limit(0)).count() == 0


def test_nearest_scores_are_exact_and_ids_stand_once(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 8))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, rows[0], rows[20], (40, [float(c) + 100 for c in x[40]])], "vec_id long, embedding array<double>")
    v = ann.valid(df)
    got = {}
    for r in ann.nearest(ann.build_index(v, 60), v.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 200, 20))
    for q, near in got.items():
        near.sort()
        assert [r for r, _, _ in near] == list(range(1, 21)) and len({i for _, i, _ in near}) == 20
        assert all(s == pytest.approx(float(x[q] @ x[i]), rel=1e-13, abs=1e-13) for _, i, s in near)


def test_nearest_by_id_among_copies_and_in_a_dense_cluster(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[::3] = x[0]  # a third are copies
    x[1::6] = x[1] + rng.normal(scale=1e-4, size=x[1::6].shape)  # a sixth lie close together
    x = np.round(x * 2**14) / 2**14  # sums of products are exact
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    v = ann.valid(df)
    got = {}
    for r in ann.nearest(ann.build_index(v, 1000), v.filter("vec_id % 3 < 2 and vec_id % 10 < 2"), 20, 100).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert len(got) == 400
    hits = []
    for q, near in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -s))[:20].tolist()
        if q % 3 == 0:
            assert [i for _, i in sorted(near)] == best
        elif q % 6 == 1:
            hits.append(len({i for _, i in near} & set(best)) / 20)
    assert np.mean(hits) == 1


def test_toxicity_on_held_out_rows(spark):
    rng, texts = random.Random(5), sentences(900)
    bad = {i for i in range(900) if rng.random() < 0.25}
    texts = [t + (" " + " ".join(rng.sample(["vile", "rotten", "scummy", "nasty"], 2)) if i in bad else "") for i, t in enumerate(texts)]
    df = odd_docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i in bad)) for i in range(900)] + [(None, 1), (3, None)] + [(i, 0) for i in range(0, 900, 7)], "doc_id long, toxic int")
    net = toxicity.train(df.select("doc_id", "text"), labels)
    out = [r for r in toxicity.classify(df, net).collect()]
    assert len(out) == df.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 900]
    assert np.mean([r.predicted == (r.doc_id in bad) for r in held]) > 0.97
    none = toxicity.train(df.select("doc_id", "text"), labels.limit(0))
    assert toxicity.classify(df.limit(0), none).count() == 0


def test_quality_odd_rows(spark):
    good = sentences(40)
    junk = [" ".join(f"{w}###" for w in t.split()) for t in sentences(4, 2)]
    df = odd_docs(spark, [t + " " + " ".join(f"w{k}{i}" for k in range(60)) for i, t in enumerate(good)] + [j + " " + " ".join(f"v{k}$$$" for k in range(60)) for j in junk])
    out = {r.rec.doc_id: r for r in quality.judge(df).collect()}
    assert all(out[i].kept for i in range(40)) and not any(out[i].kept for i in range(40, 44))
    assert out[44].base_failed and out[44].n_words == 0 and out[46].n_repeat_words == 60_000
    assert quality.judge(df.limit(0)).count() == 0


def test_min_length_of_packed_runs():
    x = np.zeros(3, suffixes.ENTRY)
    x["gram"], x["first"] = [1, 5, 2**63], [9, 8, 7]
    assert (suffixes._entries(suffixes._planes(x), 3) == x).all()
    assert isinstance(pa.array([1]), pa.Array)


@pytest.mark.parametrize("tag", ["form", "article", "div class=ad", "aside", "div"])
def test_pages_nested_deeply_take_time_in_proportion(tag):
    """20,000 containers inside each other, of every kind that is looked at; closed and unclosed."""
    name = tag.split()[0]
    for end in ("", f"</{name}>" * 20_000):
        began = time.time()
        html.main_text("".join(f"<{tag}><p>some words here</p>" for _ in range(20_000)) + end)
        assert time.time() - began < 5


def test_pages_with_columns_of_any_names(spark):
    """Columns that are called like those of the result or the steps are no hindrance."""
    df = spark.createDataFrame([(1, "u", f"<article><p>{LONG}</p></article>", "x", 3)], "page_id long, url string, html string, text string, n_chars int")
    assert [(r.page_id, r.url, r.n_chars) for r in html.extract(df).collect()] == [(1, "u", len(LONG.strip()))]
