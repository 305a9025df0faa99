"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every
operator and stage, and brute-force versions of what SQL cannot express."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duocount.llm import (binary_ids, decontaminate, jaccard_join, lm_score, packing, quality, quality_rules,
                          token_count, toxicity, url_filter)
from duocount.llm.queries import tokenizer_path

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long, node long, rank long"


@pytest.fixture(scope="module")
def odd(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from every other animal it has ever seen"
    long = " ".join(f"word{i % 977}x{i}" for i in range(40_000))
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", None, "a"), (4, base, "en", None), (5, base, "en", "a"),
            (5, base, "en", "a"), (6, base + " today", "en", "a"), (7, "two words", "en", "a"), (8, "Two\tWORDS", "en", "a"),
            (9, long, "en", "a"), (None, base, "en", "a"), (10, "é́ 漢字 😀 <|endoftext|> İ\x85x", None, None), (11, "x" * 5000, "de", "b")]
    return spark.createDataFrame([(*r, 0, 1.5, 7, 3, 9) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def by_id(df, *columns):
    return sorted((tuple(r) for r in df.select("doc_id", *columns).collect()), key=lambda r: (r[0] is None, *map(str, r)))


def whole_ids(docs, end):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return [(r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids + [end]) for r in docs.select("doc_id", "text").collect()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["odd", "small"])
def test_binary_ids_equal_the_library(spark, request, name):
    docs = request.getfixturevalue(name)
    store = binary_ids.write_sequences(docs, tokenizer_path("word_bpe_49k.json"), 1, length=64)
    got = binary_ids.read_documents(spark, store).collect()
    assert sorted(((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(
        ((d is None, d, len(i), crc(i)) for d, i in whole_ids(docs, 1)), key=str)
    at = 0
    for r in sorted(got, key=lambda r: r.start):  # gapless, ascending, null first
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id if r.doc_id is not None else -1 for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    file = store.file(store.parts[0].part)
    ids, mask = file.sequence(0)
    assert len(ids) == 64 and mask.dtype == bool and not ids.flags.owndata
    column = file.reader.get_batch(0)   # ids and mask bits are views of the mapped file, at the addresses of its buffers
    assert file.ids(0).ctypes.data == column.column("ids").flatten().buffers()[1].address
    assert file.mask_bits(0).buffers()[1].address == column.column("mask").flatten().buffers()[1].address
    before = pa.total_allocated_bytes()
    views = [(file.ids(b), file.mask_bits(b)) for b in range(file.batches())]
    assert pa.total_allocated_bytes() == before and len(views) == file.batches()   # nothing was copied by Arrow
    assert (file.mask(0)[0] == mask).all()


def test_encoder_equals_the_library_on_mixed_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from duocount.llm.encode import IdEncoder
    rng = np.random.default_rng(6)
    pieces = ["don't", "DON'T", "it's", "İstanbul", "e\u0301", "\u0301x", "<|endoftext|>", "<|EndOfText|>", "a<|startoftext|>b", "x\x85y", "漢字", "ǅ", "ß",
              "...", "--a--", "12ab34", "\u00a0", "\u2003z", "😀👍🏽", "’s", "ΑΣ", "\x1c", "word", "Word", "WORD", "'", "'re'll", "w" * 90, "\ufb01"]
    texts = ["", None, " \n"] + ["".join(pieces[i] + (" ", "\n", "", "\t\r ")[rng.integers(4)] for i in rng.integers(0, len(pieces), rng.integers(1, 30)))
                                for _ in range(400)]
    t, e = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), IdEncoder(tokenizer_path("word_bpe_49k.json"))
    for _ in range(2):   # the second time from the cache
        got = e(pa.array(texts))
        for x, ids in zip(texts, got):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(x or "", add_special_tokens=False).ids, x


def test_encoder_keeps_words_and_tails_once(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from duocount.llm import encode
    path = tokenizer_path("word_bpe_49k.json")
    t, e = Tokenizer.from_file(path), encode.IdEncoder(path)
    texts = ["zyxqua zyxqua. Zyxqua, (zyxqua zyxqua...", "zyxqua", "zyxqua.", "...", None, "über, über", "it's. a.b 12. x" + "y" * 90 + "!"]
    monkeypatch.setattr(encode, "CACHE_ENTRIES", 12)
    for k in range(3):   # unknown, known, and after the table was emptied
        for some in (texts, texts[::-1], texts[:1]):
            wanted = [t.encode(x or "", add_special_tokens=False).ids for x in some]
            assert [np.frombuffer(ids, "<u4").tolist() for ids in e(pa.array(some))] == wanted
    e = encode.IdEncoder(path)
    e(pa.array(texts[:5]))
    assert len(e.known) == 5   # zyxqua . , ... (zyxqua
    assert e._encode_words([b"one", "\u0130".encode(), b"two"]) == e._encode(["one", "\u0130", "two"])   # two units


@pytest.mark.parametrize("name", ["odd", "small"])
def test_packing_places_every_id_once(request, name):
    docs = request.getfixturevalue(name)
    limit = 512
    rows = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), 2, limit).collect()
    wanted = []
    for d, ids in whole_ids(docs, 2):
        wanted += [(d is None, d, s, min(limit, len(ids) - s), crc(ids[s:s + limit]), len(ids)) for s in range(0, len(ids), limit)]
    assert sorted(((r.doc_id is None, r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows), key=str) == sorted(wanted, key=str)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= limit and sorted(ends) == list(range(len(ends)))


def test_shortest_pack_first_by_hand():
    slots = packing.shortest_pack_first({6: 2, 4: 1, 3: 2, 1: 3}, 10)
    used = {}
    for length, _, first, offset, count in slots.tolist():
        for s in range(first, first + count):
            used.setdefault(s, []).append((offset, length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 10
    assert sum(len(p) for p in used.values()) == 8 and len(used) == 3


@pytest.mark.parametrize("name", ["odd", "small"])
def test_token_counts_equal_the_library(request, name):
    import sentencepiece
    docs = request.getfixturevalue(name)
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = by_id(token_count.token_counts(docs, tokenizer_path("piece_bpe_32k.model"), 100), "n_bytes", "n_tokens", "over_limit")
    wanted = [(r.doc_id, len((r.text or "").encode()), n := len(sp.encode(r.text or "")), n > 100) for r in docs.collect()]
    assert got == sorted(wanted, key=lambda r: (r[0] is None, *map(str, r)))


def brute_classes(docs):
    import re
    nodes = []
    for r in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))
        sh = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        nodes.append((r.doc_id, sh))
    label = {d: d for d, _ in nodes if d is not None}
    for a, x in nodes:
        for b, y in nodes:
            if None not in (a, b) and x and y and 100 * len(x & y) >= 75 * len(x | y) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return sorted(((d, len(s), label.get(d)) for d, s in nodes), key=lambda r: (r[0] is None, *map(str, r)))


@pytest.mark.parametrize("name", ["odd", "small"])
def test_jaccard_classes_equal_all_pairs(request, name):
    docs = request.getfixturevalue(name)
    assert by_id(jaccard_join.jaccard_classes(docs), "n_shingles", "component_id") == brute_classes(docs)


def test_jaccard_region_recursion_equals_all_pairs():
    rng = np.random.default_rng(3)
    centres = [rng.choice(5000, 80, replace=False) for _ in range(12)]
    sets = []
    for i in range(400):
        s = set(centres[i % 12].tolist())
        for x in rng.choice(sorted(s), rng.integers(0, 16), replace=False):
            s.remove(x)
            s.add(int(rng.integers(5000, 9000)))
        sets.append(np.array(sorted(s), dtype=np.uint64))
    parent = list(range(400))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(400):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    wanted = {frozenset(k for k in range(400) if root(k) == root(i)) for i in range(400)}
    region = jaccard_join._Region(sets, np.arange(400), 75)
    region.join(np.arange(400))
    assert {frozenset(np.flatnonzero(region.root == r).tolist()) for r in set(region.root.tolist())} == wanted
    half = jaccard_join._Region(sets, np.arange(400) // 200 * 1000 + np.arange(400), 75)
    half.across(np.arange(200), np.arange(200, 400))
    for i, j in half.links:
        assert (i < 200) != (j < 200) or root(i) == root(j)


def test_lm_scores_equal_a_loop(small):
    docs = small.limit(20)
    vocab = lm_score.vocabulary(docs)
    net = lm_score.train(docs, vocab, rounds=1, stride=2)
    got = {r.doc_id: (r.n_tokens, r.log_probability) for r in lm_score.score(docs, vocab, net).collect()}
    from duocount.llm.words import buffers, word_hashes
    import pyarrow as pa
    for r in docs.collect()[:5]:
        words, row = word_hashes(*buffers(pa.array([r.text])))
        t = vocab.tokens(words).astype(int)
        total = 0.0
        for i in range(len(t)):
            h = net.bias.astype(float).copy()
            for k, p in enumerate(lm_score._PLACES):
                h = h + net.embedding[k][t[i + p] if 0 <= i + p < len(t) else lm_score.EDGE]
            h = np.maximum(h, 0)
            for z, pick in ((h @ net.cls + net.cls_bias, t[i] // lm_score.MEMBERS),
                            (h @ net.member[t[i] // lm_score.MEMBERS] + net.member_bias[t[i] // lm_score.MEMBERS], t[i] % lm_score.MEMBERS)):
                total += z[pick] - np.log(np.exp(z).sum())
        assert got[r.doc_id][0] == len(t) and got[r.doc_id][1] == pytest.approx(total, rel=1e-4)


def test_lm_learns_and_scores_odd_rows(odd, nothing, small):
    vocab = lm_score.vocabulary(small)
    trained, blank = lm_score.train(small, vocab), lm_score.Network()
    mean = [lm_score.score(small, vocab, n).agg(F.sum("log_probability") / F.sum("n_tokens")).first()[0] for n in (trained, blank)]
    assert mean[0] > mean[1] + 0.5
    rows = {(r.doc_id, r.n_tokens): r for r in lm_score.score(odd, vocab, trained).collect()}
    assert rows[1, 0].log_probability == 0 and rows[1, 0].mean_log_probability is None
    assert rows[9, 40_000].log_probability < 0
    empty = lm_score.vocabulary(nothing)
    assert lm_score.score(nothing, empty, lm_score.train(nothing, empty)).count() == 0


def test_lm_trains_on_every_position(spark):
    from duocount.llm.words import buffers, word_hashes
    import pyarrow as pa
    docs = spark.createDataFrame([(1, "one two three four five")], "doc_id long, text string")
    vocab = lm_score.vocabulary(docs)
    words, row = word_hashes(*buffers(pa.array(["one two three four five"])))
    t, at = vocab.tokens(words), np.arange(5)
    context = lm_score.contexts(t, row, at)
    blank, trained = (n.log_probability(context, t) for n in (lm_score.train(docs, vocab, rounds=0), lm_score.train(docs, vocab)))
    assert (trained > blank).all()
    for turn in range(lm_score.ROUNDS):
        assert lm_score.targets(np.array([0, 3, 3, 20]), turn).tolist() == list(range(20))
    assert lm_score.targets(np.array([0, 3, 3, 10]), 0, 4).tolist() == [0, 3, 7]


def test_lm_step_and_lookup_equal_plain_ones():
    rng = np.random.default_rng(4)
    row = np.array([0, 0, 1, 4, 4, 40, 700])
    tokens = np.minimum(rng.pareto(0.4, 700) * 3, lm_score.TOKENS - 1).astype(np.int32)
    around, at = lm_score.Windows(tokens, row), rng.permutation(700)
    own = lm_score.Trainer(lm_score.Network().flat)
    plain, memory = lm_score.Network(), np.full(own.net.flat.size, 1e-8)
    for some in (at[:300], at[300:]):
        own.learn(*around(some), 0.1)
        g = lm_score.Network(np.zeros(plain.flat.size))
        for i in some:   # one position at a time, every weight moved
            text = np.searchsorted(row, i, side="right") - 1
            near = [tokens[i + p] if row[text] <= i + p < row[text + 1] else lm_score.EDGE for p in lm_score._PLACES]
            assert lm_score.contexts(tokens, row, np.array([i]))[:, 0].tolist() == near
            c, m = divmod(int(tokens[i]), lm_score.MEMBERS)
            h = np.maximum(sum(plain.embedding[k][w].astype(float) for k, w in enumerate(near)) + plain.bias, 0)
            p, q = (np.exp(z) / np.exp(z).sum() for z in (h @ plain.cls + plain.cls_bias, h @ plain.member[c] + plain.member_bias[c]))
            p[c] -= 1
            q[m] -= 1
            back = (plain.cls @ p + plain.member[c] @ q) * (h > 0)
            for part, x in ((g.cls, np.outer(h, p)), (g.cls_bias, p), (g.member[c], np.outer(h, q)), (g.member_bias[c], q), (g.bias, back),
                            *((g.embedding[k][w], back) for k, w in enumerate(near))):
                part += x
        g = g.flat / len(some)
        memory += g * g
        plain = lm_score.Network((plain.flat - 0.1 * g / (np.sqrt(memory) + 1e-6)).astype(np.float32))
    moved = plain.flat != lm_score.Network().flat
    assert moved.any() and ((own.net.flat != lm_score.Network().flat) <= moved).all()
    assert np.abs(own.net.flat - plain.flat).max() < 2e-3 and np.abs(own.net.flat - plain.flat).mean() < 1e-6
    head = np.uint64(7) << np.uint64(48)
    hashes = np.array([head + np.uint64(5), np.uint64(3), head, np.uint64(2 ** 64 - 1), head + np.uint64(1)], np.uint64)
    words = np.concatenate([hashes, hashes + np.uint64(2), rng.integers(0, 2 ** 63, 50).astype(np.uint64)])
    known = {int(w): k for k, w in enumerate(hashes)}
    other = lm_score.TOKENS - lm_score.FREQUENT
    assert lm_score.Vocabulary(hashes).tokens(words).tolist() == [known.get(int(w), lm_score.FREQUENT + int(w) % other) for w in words]


@pytest.fixture(scope="module")
def labelled(spark):
    sf = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def shares(scored, labels, label):
    rows = scored.where("held_out").join(labels, "doc_id").select("predicted", label).collect()
    one = [r for r in rows if r[1] == 1]
    zero = [r for r in rows if r[1] == 0]
    return np.mean([r[0] for r in one]), np.mean([r[0] for r in zero])


def test_quality_and_toxicity_on_held_out_rows(spark, labelled):
    from duocount.llm import queries as q
    sf = "/root/testdata/sf0.1"
    good, bad = shares(q.op9_quality(spark, sf), labelled[1], "quality")
    assert good > 0.85 and bad < 0.1
    caught, wrong = shares(q.op8_toxicity(spark, sf), labelled[1], "toxic")
    assert caught > 0.75 and wrong < 0.03


def test_toxicity_equals_noisy_or_and_finds_sentences(spark):
    from duocount.llm.words import _hash_spans
    word = np.frombuffer(b"awful", np.uint8)
    h = _hash_spans(word, np.array([0]), np.array([5]))
    model = toxicity.Model(h, np.array([6.0]), -4.0, 0.1)
    docs = spark.createDataFrame([(1, "Good day. You awful, AWFUL man! Bye"), (2, None), (3, "...")], "doc_id long, text string")
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    s = lambda z: 1 / (1 + np.exp(-z))
    assert rows[1].score == pytest.approx(1 - (1 - s(-4)) ** 2 * (1 - s(2)))
    assert [(x.start, x.length) for x in rows[1].sentences] == [(10, 21)]
    assert rows[2].score == rows[3].score == pytest.approx(s(-4))


def test_models_on_odd_rows(spark, odd, nothing):
    for docs in (odd, nothing):
        n = docs.count()
        model = toxicity.train(docs, spark.createDataFrame([(1, 1), (None, 0), (4, None)], "doc_id long, toxic int"))
        assert toxicity.score(docs, model).count() == n
        table = quality.feature_table(docs)
        scorer = quality.train(table, table.select("doc_id"), table.select("doc_id"))
        assert scorer is None and {r.score for r in quality.score(table, scorer).collect()} <= {0.5}
        assert quality.keep_good(docs, scorer, 0.3).count() == n


def test_rules_on_odd_rows(odd, nothing):
    rows = quality_rules.judge(odd, odd.columns).collect()
    assert len(rows) == odd.count() and all(not r.kept for r in rows if r.n_words < 50)
    long = next(r for r in rows if r.row.doc_id == 9)
    assert long.n_words == 40_000 and long.n_repeat_words == 0
    assert quality_rules.judge(nothing, nothing.columns).count() == 0


def test_limits_are_drawn_quantiles_of_each_group(spark):
    """Against lists in memory; values below 64, which the sketch keeps exactly. Sources that differ have limits that differ."""
    import random

    rng = random.Random(6)
    names = list(quality_rules.MEASURES)
    sizes = {("en", "a"): (400, 60), ("en", "b"): (90, 20), ("de", "a"): (3, 9), (None, None): (50, 40)}
    rows = [(lang, source, *[rng.randrange(most) for _ in names]) for (lang, source), (n, most) in sizes.items() for _ in range(n)]
    table = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{m} long" for m in names))
    got = {(r.lang, r.source): r.fence for r in quality_rules.limits(quality_rules.sketches(table)).collect()}
    assert set(got) == set(sizes)
    for (lang, source), fence in got.items():
        for k, m in enumerate(names):
            groups = [[r[2 + k] for r in rows if keep(r)] for keep in (
                lambda r: r[:2] == (lang, source), lambda r: r[0] == lang, lambda r: True)]

            def drawn(share):
                own, parent, corpus = (sorted(g)[-(-len(g) * share // 1000) - 1] for g in groups)
                w, v = (len(g) / (len(g) + quality_rules.PRIOR) for g in groups[:2])
                return w * own + (1 - w) * (v * parent + (1 - v) * corpus)

            low, mid, top = (drawn(x) for x in (quality_rules.BOTTOM, quality_rules.MIDDLE, quality_rules.TOP))
            assert fence[m].high == pytest.approx(top + quality_rules.REACH * (top - mid))
            assert fence[m].low == pytest.approx(low - quality_rules.REACH * (mid - low) if quality_rules.MEASURES[m] else -1)
            assert len({f[m].high for f in got.values()}) == len(sizes)


def test_contained_items(spark, odd, nothing):
    text = odd.where("doc_id = 4").first().text
    items = spark.createDataFrame([(1, " ".join(text.split()[3:15])), (2, None), (3, ""), (4, "not here at all my friend"), (4, "two words")],
                                  "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(odd, items).collect()}
    assert got == {(4, 1), (5, 1), (6, 1), (7, 4), (8, 4)}
    assert decontaminate.contained_items(nothing, items).count() == 0
    assert decontaminate.contained_items(odd, items.limit(0)).count() == 0


def test_url_verdicts(spark):
    rules = [url_filter.rule("allow", "org/"), url_filter.rule("block", "bad.com/")]
    link = '<a href="https://www.bad.com/x">x</a>'
    rows = [(1, "http://A.org/p?q", link, 1), (2, "http://bad.com/", None, 1), (3, "http://spam.net/a/b#c", link * 3, 1), (4, None, "", 1),
            (5, "no scheme", link, 1), (6, "http://quiet.info?x", None, 1), (3, "http://spam.net/a/b#c", link * 3, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host long")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {(1, "a.org", "/p", "org/", "allow"), (2, "bad.com", "/", "bad.com/", "block"), (3, "spam.net", "/a/b", None, "block"),
                   (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "quiet.info", "", None, "allow")}
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_url_ranks_settle_along_a_long_chain(spark):
    rules = [url_filter.rule("block", "h0.com/")]
    rows = [(0, "http://h0.com/", None)] + [(i, f"http://h{i}.com/", f'<a href="http://h{i - 1}.com/">x</a>') for i in range(1, 13)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.distrust) for r in url_filter.judge_urls(pages, rules).collect()}
    assert {v for v, _ in got.values()} == {"block"}
    assert [got[i][1] for i in range(13)] == pytest.approx([0.15 * 0.85 ** i for i in range(13)], abs=1e-8)
    edges = spark.createDataFrame([("a.com", "b.com", 1), ("b.com", "a.com", 1)], "src string, dst string, weight long")
    with pytest.raises(RuntimeError):
        url_filter.propagate(edges, spark.createDataFrame([("trust", "a.com", 1)], "kind string, host string, mass long"), limit=8)


def test_pipeline_stages(spark, odd, nothing, small):
    import corpus_pipeline as p
    for docs in (odd, nothing, small):
        for _, stage in p.STAGES[:-1]:
            left = stage(spark, docs, SMALL)
            assert left.columns == docs.columns and left.count() <= docs.count()
        assert p.STAGES[-1][1](spark, docs, SMALL).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    classes = {r[0]: r[2] for r in brute_classes(small)}
    stay = sorted(r.doc_id for r in p.jaccard_dedup(spark, small, SMALL).collect())
    assert stay == sorted(d for d, c in classes.items() if d == c)
    odd_left = sorted((r.doc_id for r in p.jaccard_dedup(spark, odd, SMALL).collect()), key=str)
    assert odd_left == sorted([1, 2, 3, 4, 7, 9, None, 10, 11], key=str)


def test_pipeline_decides_by_row(spark):
    import corpus_pipeline as p
    item = next(r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").collect() if len((r.text or "").split()) >= 8)
    copied = " ".join(f"alpha{i}" for i in range(60))
    clean = " ".join(f"beta{i}" for i in range(60))
    other = " ".join(f"gamma{i}" for i in range(60))
    rows = [(3, copied), (5, clean), (5, copied + " end"), (6, "leak " + item + " leak"), (6, other), (None, item), (None, "delta " + other),
            (8, ""), (8, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("k")).withColumn("_g", F.lit(1))
    left = p.jaccard_dedup(spark, docs, SMALL)
    assert left.columns == docs.columns and {(r.key, r["_g"]) for r in left.collect()} == {("k", 1)}
    found = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert found == sorted([(d, t) for d, t in rows if t not in ("", copied + " end")] + [(8, "")], key=str)
    left = p.decontamination(spark, docs, SMALL)
    found = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert found == sorted([(d, t) for d, t in rows if item not in (t or "")], key=str)


def test_pipeline_run_packs_what_the_stages_keep(spark):
    import corpus_pipeline as p
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
    wanted = {d: len(i) for d, i in whole_ids(docs, 2)}
    rows = p.run(spark, SMALL).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == wanted
    assert sum(r.length for r in rows) == sum(wanted.values())
