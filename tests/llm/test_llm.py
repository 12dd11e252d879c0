"""Operators of tracewright.llm against brute force, on small and awkward tables."""

import functools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tracewright.llm import embedding_dedup, html_extraction, lm_scoring, mixing, ngram_join, packing, quality_classifier, quality_rules, token_counts, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, score double, kept boolean, label int"
rng = np.random.default_rng(3)
VOCAB = [f"w{i}" for i in range(300)]


def prose(n):
    return " ".join(rng.choice(VOCAB, n)).capitalize() + "."


@functools.cache
def rows():
    base = prose(120)
    texts = [None, "", "   \n", "One", "Two words", base, base, base.upper(), base.replace("w1", "w2", 1), " ".join([base] * 3), "x " * 5000 + "end.", prose(20000)]
    near = base.split()
    texts += [" ".join([*near[:k], "changed", *near[k + 1 :]]) for k in range(0, 60, 3)]
    texts += [prose(int(n)) for n in rng.integers(3, 200, 60)] + ["Ünï ☃ 😀 <|endoftext|> ok. " * 8, "menu | home | about | us | more | text here.\nGood line of text with words.\n" * 3]
    out = [(i, t, "en", [None, "a", "b", "é"][i % 4], len(t or ""), 7, 0.5, True, 1) for i, t in enumerate(texts)]
    return [*out, out[6], (None, base, "en", None, 1, 1, 0.1, False, 2), (10**12, base, None, "b", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def written(spark, docs, tmp_path_factory):
    """The documents as a table of several files."""
    path = str(tmp_path_factory.mktemp("tables") / "documents.parquet")
    docs.write.parquet(path)
    return spark.read.parquet(path)


def sets_of(k):
    out = {}
    for r in rows():
        w = WORD.findall((r[1] or "").translate(LOW))
        if r[0] is not None:
            out[r[0]] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def joined(sets, percent):
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: top(i) for i in sets}


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 90, 1_500_000), (5, 80, 1_500_000), (3, 90, 1500)])
def test_ngram_join(docs, none, k, percent, block):
    sets, got = sets_of(k), ngram_join.jaccard_components(docs, k, percent, block_shingles=block, max_broadcast=0 if block < 9999 else 1000).collect()
    want = joined(sets, percent)
    assert len(got) == len(rows())
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"]) and (r["doc_id"] is None or r["n_shingles"] == len(sets[r["doc_id"]]))
    if block > 9999:
        assert ngram_join.jaccard_components(none, k, percent).count() == 0


@pytest.mark.parametrize("fan", [8192, 3])
def test_shingles_are_signed_by_exact_counts(written, fan):
    held = Counter(s for r in rows() for s in ngram_join.shingle_sets(pa.array([r[1]], pa.string()), 5)[0].tolist())
    want = Counter()
    for r in rows():
        s = ngram_join.shingle_sets(pa.array([r[1]], pa.string()), 5)[0]
        h = ngram_join.mix(s + ngram_join.PLACE[5])
        order = sorted(range(len(s)), key=lambda i: (held[int(s[i])], int(h[i])))[: len(s) - -(-80 * len(s) // 100) + 1]
        want[(r[0], len(s), tuple(int(h[i]) for i in order if held[int(s[i])] > 1))] += 1
    got = Counter((r["doc_id"], r["n"], tuple(x % (1 << 64) for x in r["signed"])) for r in ngram_join.counted_rows(written, 5, 80, 2000 if fan < 9 else 1 << 23, fan).collect())
    assert got == want


def test_trie_join_is_exact():
    base = rng.choice(4000, 60, replace=False)
    sets = [np.unique(np.append(rng.choice(base, int(n), replace=False), rng.choice(4000, int(m)))).astype(np.uint64) for n, m in zip(rng.integers(40, 60, 80), rng.integers(0, 9, 80), strict=True)]
    for percent in (70, 80, 90):
        want = joined({i: set(s.tolist()) for i, s in enumerate(sets)}, percent)
        label = dict(enumerate(range(len(sets))))
        for a, b in ngram_join.join_sets(sets, percent):
            x, y = label[a], label[b]
            label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
        assert label == want


def test_quality_classifier(spark, docs, none):
    good = [(i, prose(60)) for i in range(1000, 1200)]
    junk = [(i, " ".join(w + "###" for w in prose(60).split())) for i in range(2000, 2200)]
    table = spark.createDataFrame(good + junk, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in junk] + [(5, None)], "doc_id bigint, quality int")
    model = quality_classifier.fit(table, labels)
    got = quality_classifier.score(table, model).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == (r["doc_id"] < 2000) for r in held]) > 0.97
    odd = quality_classifier.score(docs, model).collect()
    assert len(odd) == len(rows()) and all(0 <= r["score"] <= 1 for r in odd)
    assert all(r["score"] == 0 for r in odd if r["doc_id"] in (0, 1, 2))
    assert quality_classifier.score(none, model).count() == 0
    assert quality_classifier.fit(table, labels.where("quality = 9")).constant == 0.5
    assert quality_classifier.keep_good(docs, model).columns == docs.columns


def test_html_extraction(spark):
    page = '<html><head><title>T</title></head><body><header>top</header><nav><a href="/">home</a></nav><div class="cookie-notice">c</div><article><h1>Head &amp; more</h1><p><b>one\n two<br>three<p>four <i>five</i><div class="share">tweet</div><form>f</form><section id="comments"><p>nice</p></section><script>var x="</p>";</script></article><aside>s</aside><footer>f</footer></body></html>'
    assert html_extraction.extract(page) == "Head & more\n\none two three\n\nfour five"
    assert html_extraction.extract("<body><p>a<p>b<ul><li>c<li>d</ul>") == "a\n\nb\n\nc\n\nd"
    assert html_extraction.extract("no markup & more") == "no markup & more"
    plain = [(i, f"http://h.com/{i}", f"<body><div class='x'>same words on every page</div><div class='y'>text {i} of the page</div></body>") for i in range(20)]
    df = spark.createDataFrame([*plain, (50, None, None), (51, "x", ""), (52, "http://h.com", page)], "page_id bigint, url string, html string")
    for most in (100, 0):
        got = {r["page_id"]: r for r in html_extraction.extract_pages(df, most).collect()}
        assert got[3]["text"] == "text 3 of the page" and got[3]["n_chars"] == 18
        assert got[50]["text"] == "" and got[51]["text"] == "" and got[52]["text"].startswith("Head")
    assert html_extraction.extract_pages(df.limit(0)).count() == 0


def test_embedding_dedup(spark):
    base = rng.normal(size=(40, 8)).astype(np.float32)
    vectors = [v.tolist() for v in np.concatenate([base, base + rng.normal(scale=0.03, size=base.shape), base[:10], base[:5] * 3])]
    data = [(i, v, i % 3) for i, v in enumerate(vectors)] + [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, vectors[0], None), (904, [None] * 8, 1), (905, [1.0, 2.0], 1), (906, [], 1), (None, vectors[1], 1), (907, [1e30] * 8, 1), (908, [2e30] * 8, 1)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>, label int")
    ok = [(i, np.array(v, float) / np.linalg.norm(np.array(v, float)), g) for i, v, g in data if i is not None and (i < 900 or i in (905, 907, 908))]
    links = {i: [j for j, w, h in ok if j != i and g == h and len(v) == len(w) and v @ w >= 0.98] for i, v, g in ok}
    for block, partners in ((512, 16), (8, 2)):
        got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, block=block, partners=partners).collect()}
        assert len(got) == len(data)
        for i, _, _ in data:
            assert got[i]["n_links"] == len(links.get(i, [])), i
            seen, todo = {i}, [i]
            while todo:
                new = set(links.get(todo.pop(), [])) - seen
                seen |= new
                todo += new
            assert got[i]["component_id"] == (min(seen) if i is not None else None)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_url_filter(spark):
    urls = {"http://a.EXAMPLE.com/en/7x?q": ("example.com/en/7", "allow"), "http://a.com/en/": ("com/en/", "block"), "http://notexample.com/en/7": ("com/en/", "block"), "x://example.net/de/8": ("example.net/de/8", "block"), "x://b.net/de/8": ("net/de/", "allow"), "example.com/en/7": (None, "allow"), None: (None, "allow"), "http://com#/en/": (None, "allow"), "http://org/es/a://b/en/": ("org/es/", "block")}
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    for r in url_filter.filter_urls(df).collect():
        assert (r["rule"], r["verdict"]) == list(urls.values())[r["page_id"]]


def test_packing(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = defaultdict(list)
    for r in rows():
        texts[r[0]].append(tok.encode(r[1] or "", add_special_tokens=False).ids + [1])
    got = packing.pack_documents(docs).collect()
    by, windows = defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    assert by.keys() == texts.keys()
    for i, pieces in by.items():
        assert sum(r["length"] for r in pieces) == sum(map(len, texts[i]))
        if len(texts[i]) == 1:
            at, ids = 0, texts[i][0]
            for r in sorted(pieces, key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids)
                at += r["length"]
                assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes())
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack_documents(none).count() == 0


def test_ids_of_long_white_space():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (" " * 1_000_000 + "x", "\n" * 600_000 + " y", "a  b" + " \n\t" * 200_000 + "<|endoftext|>" + " " * 600_000 + "<|endoftext|> z", "é" + "\u3000" * 600_000 + "é", " " * 60_000 + "1" + " " * 700_000, "a" * 300_000 + " " * 600_000):
        assert packing.token_ids(text).tolist() == [*tok.encode(text, add_special_tokens=False).ids, packing.END_ID]
    for text in ("a" + " " * 90_000 + "b", "x \n" * 70_000, " " * 70_000):  # both ways where both can go
        assert packing.beyond_pattern(text) == packing.token_ids(text)[:-1].tolist()


def test_tiers_and_step_groups(written):
    got = packing.pack_documents(written).collect()
    windows, groups = defaultdict(int), defaultdict(dict)
    for r in got:
        windows[r["sequence_id"]] += r["length"]
        groups[r["step_group"]][r["sequence_id"]] = r["tier"]
    assert all(r["tier"] == windows[r["sequence_id"]] for r in got)
    for g in groups.values():
        assert sum(g.values()) <= packing.STEP_TOKENS
    whole = [g for g in groups.values() if sum(g.values()) == packing.STEP_TOKENS]
    assert len(groups) - len(whole) <= written.rdd.getNumPartitions()


def test_quality_rules(docs, none):
    got = {r["doc_id"]: r for r in quality_rules.with_rules(docs, ["doc_id"]).collect()}
    for r in rows():
        w = WORD.findall(r[1] or "")
        n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        inside = {i + j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(8)}
        g = got[r[0]]
        assert (g["n_words"], g["n_repeat_words"], g["word_chars"]) == (len(w), len(inside), sum(map(len, w)))
        assert g["base_failed"] == (len(w) < 20 or 100 * len(inside) > 30 * len(w))
        assert not (g["kept"] and g["base_failed"])
    assert got[5]["kept"] and quality_rules.clean(docs).columns == docs.columns
    assert quality_rules.clean(docs).count() == sum(got[r[0]]["kept"] for r in rows())
    assert quality_rules.with_rules(none).count() == 0


@pytest.mark.parametrize(("per_bucket", "digits"), [(256, 3), (1, 1)])
def test_mixing(docs, none, per_bucket, digits, monkeypatch):
    monkeypatch.setattr(mixing, "LEVEL_DIGITS", digits)
    got = mixing.schedule(docs, rows_per_bucket=per_bucket).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += sum(r["takes"])
        target[r["source"]] = r["target"]
        assert all(0 <= t <= r["size"] for t in r["takes"])
    weight = dict(zip([*sorted(k for k in sizes if k), None], (3, 1, 2, 3), strict=False))
    left, money, full = set(sizes), 1.5 * sum(sizes.values()), {}
    while True:
        share = {s: money * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * sizes[s]}
        if not over:
            break
        full |= {s: 2 * sizes[s] for s in over}
        money -= sum(2 * sizes[s] for s in over)
        left -= over
    for s, t in (full | share).items():
        assert math.isclose(target[s], t) and abs(taken[s] - t) <= 1
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(none).count() == 0
    assert mixing.schedule(none).count() == 0


def test_token_counts(docs, none):
    scores, find = token_counts.pieces(), token_counts.pattern().findall

    @functools.cache
    def best(data):
        at = [(0.0, 0)]
        for end in range(1, len(data) + 1):
            at.append(max((at[s][0] + scores[data[s:end]], at[s][1] - 1) for s in range(max(0, end - 140), end) if data[s:end] in scores))
        return -at[-1][1]

    want = Counter()
    for r in rows():
        found = find(r[1] or "")
        want[r[0], len(found), sum(best(p.encode()) for p in found), len((r[1] or "").encode())] += 1
    for most in (1_000_000, 50):
        got = Counter((r["doc_id"], r["n_pre_tokens"], r["n_tokens"], r["n_bytes"]) for r in token_counts.count_tokens(docs, max_nodes=most).collect())
        assert got == want
    trie = token_counts.ForwardTrie(scores)
    for long in ("ab" * 3000, "x" * 5000, "".join(VOCAB) * 5, "é" * 2500):
        assert trie.insert(long) == best(long.encode())
    assert token_counts.count_tokens(none).count() == 0
    text = "some words, and more " * 60_000
    assert [find(text, a, b) for a, b in token_counts.spans(text)] and sum((find(text, a, b) for a, b in token_counts.spans(text)), []) == find(text)


@pytest.mark.parametrize(("order", "block", "fan"), [(1, 1 << 23, 8192), (3, 1 << 23, 8192), (2, 2000, 4), (3, 3000, 2)])
def test_lm_scoring(written, none, order, block, fan):
    words = [(r[0], WORD.findall((r[1] or "").translate(LOW))) for r in rows()]
    c = Counter(tuple(w[j : j + o]) for _, w in words for o in range(1, order + 1) for j in range(len(w) - o + 1))
    total, want = sum(len(w) for _, w in words), {}
    for i, w in words:
        s = 0.0
        for j in range(len(w)):
            o = min(order, j + 1)
            while o > 1 and c[tuple(w[j - o + 1 : j + 1])] < 2:
                s, o = s + math.log(0.4), o - 1
            s += math.log(c[tuple(w[j - o + 1 : j + 1])] / (c[tuple(w[j - o + 1 : j])] if o > 1 else total))
        want[i] = s / len(w) if w else None
    got = lm_scoring.score_documents(written, order, block_bytes=block, fan=fan).collect()
    assert len(got) == len(rows())
    for r in got:
        assert (r["score"] is None) == (want[r["doc_id"]] is None) and (r["score"] is None or math.isclose(r["score"], want[r["doc_id"]]))
    assert lm_scoring.score_documents(none, order).count() == 0
