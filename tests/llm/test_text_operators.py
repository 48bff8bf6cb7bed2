"""Encoding, counting, mixing, grading, scoring and near duplicates on small fixtures."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from ember.llm import bagminhash, bpe, katz, mixing, ordinal, token_counts
from ember.llm.vocabulary import merged, read_vocabulary

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("hot", [1 << 19, 5])
def test_encode_and_decode_equal_the_library(spark, messy, hot):
    got = bpe.decode(bpe.encode(messy, WORD, hot=hot), read_vocabulary(WORD)).collect()
    want = library(WORD)
    texts = [r for r in messy.collect()]
    assert len(got) == len(texts)
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    for t in texts:
        ids = want.encode(t.text or "", add_special_tokens=False).ids
        for r in by_id[t.doc_id]:
            assert r.n_tokens == len(ids)
            assert list(r.ids) == ids and np.frombuffer(bytes(r.packed), "<u4").tolist() == ids
            assert r.decoded == want.decode(ids, skip_special_tokens=False)


def test_encode_of_nothing(spark, nothing):
    assert bpe.encode(nothing, WORD).count() == 0


def test_long_and_short_merges_agree():
    voc = read_vocabulary(WORD)
    random.seed(1)
    for _ in range(30):
        word = "".join(random.choice("thein ga") for _ in range(200)).replace(" ", "").encode()
        short = voc.symbols(word)
        while len(short) > 1:  # plain restatement: best rank, leftmost
            ranked = [(voc.merges[p][0], i) for i, p in enumerate(zip(short, short[1:])) if p in voc.merges]
            if not ranked:
                break
            i = min(ranked)[1]
            short[i : i + 2] = [voc.merges[short[i], short[i + 1]][1]]
        assert merged(voc.symbols(word), voc.merges) == short


def test_token_counts_equal_the_library(spark, messy, nothing):
    want = library(BYTE)
    texts = collections.defaultdict(list)
    for r in messy.collect():
        texts[r.doc_id].append(r.text or "")
    rows = token_counts.count_tokens(messy, BYTE, limit=12).collect()
    assert len(rows) == messy.count()
    for r in rows:
        text = texts[r.doc_id][0]
        assert r.n_bytes == len(text.encode())
        assert r.n_tokens == len(want.encode(text, add_special_tokens=False).ids)
        assert r.over_limit == (r.n_tokens > 12)
    assert token_counts.count_tokens(nothing, BYTE).count() == 0


def test_whole_tokens_are_proven(spark):
    voc = read_vocabulary(BYTE)
    whole = token_counts.whole_tokens(voc)
    lib = library(BYTE)
    sample = sorted(whole)[::997]
    assert len(whole) > 30_000
    assert all(len(lib.encode(w, add_special_tokens=False).ids) == 1 for w in sample)


def fill(sizes, weights, share, cap):
    """Iterated water-filling, the definition."""
    left, target, open_ = share * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        level = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if level * weights[i] >= cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = level * weights[i]
            break
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
            open_.remove(i)
    return target


def test_mix_fills_to_capped_targets(spark, messy, nothing):
    rows = mixing.mix_sources(messy).collect()
    assert len(rows) == messy.count()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += r.size
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = dict(zip(order, fill([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5, 2.0)))
    taken = collections.Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in order:  # repeated rows at the cut may share a word less
        assert abs(taken[s] - want[s]) <= 2
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(messy).collect()))
    assert mixing.mix_sources(nothing).count() == 0


def test_repeated_documents_keep_columns(spark, messy, nothing):
    out = mixing.repeat_documents(messy)
    assert out.columns == messy.columns
    assert mixing.repeat_documents(nothing).count() == 0
    words = sum(len((r.text or "").split()) for r in messy.collect())
    got = sum(len((r.text or "").split()) for r in out.collect())
    longest = 40_000
    assert abs(got - 1.5 * words) <= longest


def labelled(spark, n=600):
    random.seed(2)
    good = [f"wort{i}" for i in range(80)]
    docs, labels = [], []
    for i in range(n):
        kind = i % 3
        words = [random.choice(good) for _ in range(random.randrange(8, 60))]
        if kind == 0:
            words[random.randrange(len(words))] = "scoundrel"
        if kind == 1:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, 0 if kind == 1 else 1, 1 if kind == 0 else 0))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_classifier_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = ordinal.train(docs, labels, sample=200)
    rows = ordinal.grade_documents(docs, model).collect()
    assert (np.diff(model.thresholds) > 0).all()
    right = np.mean([r.keep == (r.doc_id % 3 == 2) for r in rows])
    assert right > 0.97
    assert all(r.tail <= r.expected_grade <= 2 for r in rows)


def test_classifier_edges(spark, messy, nothing):
    docs, labels = labelled(spark, 60)
    assert ordinal.train(docs, labels.limit(0)) is None
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0), (4, 1, None)], labels.schema))
    model = ordinal.train(docs, odd.unionByName(odd), sample=50)
    rows = ordinal.grade_documents(messy, model).collect()
    assert all(not r.keep and r.tail == 0 for r in rows if not (r.text or "").split())
    assert ordinal.select_documents(messy, None).columns == messy.columns
    assert ordinal.select_documents(messy, None).count() == sum(bool((r.text or "").split()) for r in rows)
    assert ordinal.grade_documents(nothing, model).count() == 0


def katz_by_hand(rows):
    uni, bi, ctx = collections.Counter(), collections.Counter(), collections.Counter()
    parsed = []
    for doc_id, text in rows:
        key = ("" if doc_id is None else str(doc_id)).encode()
        words = katz.words_of(text)
        parsed.append((doc_id, zlib.crc32(key) % 10 == 0, words))
        if zlib.crc32(key) % 10:
            seq = ["<s>", *words, "</s>"]
            uni.update(seq[1:])
            bi.update(zip(seq, seq[1:]))
            ctx.update(seq[:-1])
    d1, d2 = (katz.discounts([sum(c == r for c in counts.values()) for r in range(1, 7)]) for counts in (uni, bi))
    kept = lambda c, d: c * (d[c - 1] if c <= 5 else 1)
    n = sum(uni.values())
    p = {w: kept(c, d1) / n for w, c in uni.items()}
    unknown = 1 - sum(p.values())
    followers = collections.defaultdict(list)
    for (h, w), c in bi.items():
        followers[h].append((w, c))
    alpha = {h: (1 - sum(kept(c, d2) for _, c in f) / (ctx[h] + katz.ESCAPE)) / (1 - sum(p[w] for w, _ in f)) for h, f in followers.items()}
    for h, f in followers.items():  # every context's probabilities add up to 1
        seen = sum(kept(c, d2) / (ctx[h] + katz.ESCAPE) for _, c in f)
        assert seen + alpha[h] * (1 - sum(p[w] for w, _ in f)) == pytest.approx(1)

    def score(h, w):
        c = bi.get((h, w), 0)
        return math.log10(kept(c, d2) / (ctx[h] + katz.ESCAPE)) if c else math.log10(alpha.get(h, 1) * p.get(w, unknown))

    out = collections.defaultdict(list)
    for doc_id, held, words in parsed:
        seq = ["<s>", *words, "</s>"]
        base = sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (len(uni) + 1))) for w in seq[1:])
        out[doc_id].append((held, len(seq) - 1, sum(w in uni for w in seq[1:]), n, base, sum(map(score, seq, seq[1:]))))
    return out


@pytest.mark.parametrize("hot,size", [(1 << 19, 2_000_000), (30, 5_000)])
def test_katz_equals_the_definition(spark, messy, nothing, hot, size):
    random.seed(4)
    words = [f"t{int(random.paretovariate(0.7))}" for _ in range(9000)]
    more = spark.createDataFrame([(100 + i, " ".join(words[i * 60 : i * 60 + 60])) for i in range(150)], "doc_id bigint, text string")
    docs = messy.select("doc_id", "text").unionByName(more)
    want = katz_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    rows = katz.score_texts(docs, hot=hot, bucket_size=size).collect()
    assert len(rows) == docs.count()
    for r in rows:
        held, tokens, known, n, base, score = want[r.doc_id][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-6)
        assert r.score == pytest.approx(score, rel=1e-9, abs=1e-6)
    assert katz.score_texts(nothing).count() == 0


def test_katz_with_a_poor_sample(spark):
    """2000 short texts in front: the sampled words are few, the other frequent ones are not among them."""
    random.seed(6)
    words = [f"t{int(random.paretovariate(0.7))}" for _ in range(6000)]
    rows = [(i, "a b") for i in range(2000)] + [(5000 + i, " ".join(words[i * 60 : i * 60 + 60])) for i in range(100)]
    want = katz_by_hand(rows)
    for r in katz.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect():
        assert r.score == pytest.approx(want[r.doc_id][0][-1], rel=1e-9, abs=1e-6)


def test_heavy_counters_keep_their_bound():
    rng = np.random.default_rng(8)
    heavy, true = katz.Heavy(50), collections.Counter()
    for _ in range(20):
        h, w = (np.minimum(rng.pareto(0.8, 2000).astype(np.uint64), 99) for _ in "hw")
        heavy.add(h, w)
        true.update(zip(h.tolist(), w.tolist()))
    got = dict(zip(zip(heavy.h.tolist(), heavy.w.tolist()), heavy.count.tolist()))
    assert heavy.n == 40_000 and len(got) <= 50
    assert all(c - 40_000 / 50 <= got.get(p, 0) <= c for p, c in true.items())


@pytest.mark.parametrize("edits", [0, 1])
def test_katz_with_a_copied_long_text(spark, monkeypatch, edits):
    """Pairs of a long text that a third of all rows hold are counted apart from the buckets."""
    rng = random.Random(9)
    words = [f"t{int(rng.paretovariate(0.7))}" for _ in range(12_000)]
    rows = [(i, " ".join(words[i * 60 : i * 60 + 60])) for i in range(200)]
    for i in range(100):
        text = [f"c{j}" for j in range(900)]
        for _ in range(edits):
            text[rng.randrange(900)] = f"e{i}"
        rows.append((1000 + i, " ".join(text)))
    found = []
    monkeypatch.setattr(katz, "hot_pairs", lambda *a, f=katz.hot_pairs: found.append(f(*a)) or found[-1])
    want = katz_by_hand(rows)
    for r in katz.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), bucket_size=200).collect():
        assert r.score == pytest.approx(want[r.doc_id][0][-1], rel=1e-9, abs=1e-6)
    assert len(found[0][0]) > 300


def bag(text, words=5):
    split = (text or "").split()
    return collections.Counter(tuple(split[i : i + words]) for i in range(max(1, len(split) - words + 1))) if split else collections.Counter()


def similarity(a, b):
    common = sum((a & b).values())
    whole = sum(a.values()) + sum(b.values()) - common
    return common / whole if whole else 0.0


def classes_by_hand(rows, threshold=0.8):
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similarity(bags[i], bags[j]) >= threshold - 1e-12:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    ids = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[find(i)].append(doc_id)
    return {i: min((x for x in ids[find(i)] if x is not None), default=None) for i in range(len(rows))}


def copies(n=60):
    """A base text, copies with edits that differ more from each other, and strangers."""
    rng = random.Random(5)
    base = [f"b{rng.randrange(500)}" for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, n):
        text = list(base)
        for _ in range(rng.choice([1, 2, 3, 5, 8])):
            text[rng.randrange(len(text))] = f"e{rng.randrange(10_000)}"
        rows.append((i, " ".join(text)))
    rows += [(n + i, " ".join(f"s{rng.randrange(500)}" for _ in range(rng.randrange(3, 80)))) for i in range(40)]
    rows += [(1000 + i, "same words in every copy of this text " + "la " * 30) for i in range(20)]
    rows += [(2000, "a b"), (2001, "a b"), (2002, "a c")]
    return rows


def test_near_duplicates_equal_brute_force(spark, messy, nothing):
    rows = copies() + [(r.doc_id and r.doc_id + 5000, r.text) for r in messy.collect()]
    want = classes_by_hand(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(docs).collect()}
    for i, (doc_id, text) in enumerate(rows):
        if doc_id is not None:
            assert got[doc_id] == (want[i] if (text or "").split() else doc_id), (doc_id, text and text[:50])
    assert bagminhash.near_duplicates(nothing).count() == 0


def test_one_of_each_class_stays(spark, messy):
    out = bagminhash.keep_one(messy)
    assert out.columns == messy.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(1) == 1 and ids.count(None) == 1
    assert set(ids) == {1, 3, 4, 5, 6, 7, 8, 9, None} | ({2} if similarity(*[bag(r.text) for r in messy.where("doc_id in (1, 2)").dropDuplicates(["doc_id"]).collect()]) < 0.8 else set())


def test_repeated_ids_and_copies_without_id(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, one), (1, two), (2, two), (3, one + " more"), (None, one), (None, one + " end"), (None, "only here without id"), (None, "only here without id"), (4, ""), (4, ""), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = bagminhash.keep_one(docs).collect()
    assert sorted(map(str, out)) == sorted(map(str, docs.where("(doc_id = 1) or (doc_id is null and (text is null or text = ''))").collect() + docs.where("doc_id = 4").limit(1).collect() + docs.where("text like 'only%'").limit(1).collect()))
    roots = {(r.doc_id, r.node): r.root for r in bagminhash.near_duplicates(docs).where("doc_id < 4").collect()}
    assert len(roots) == 4 and len(set(roots.values())) == 2


def test_signatures_are_unbiased():
    rng = random.Random(7)
    texts = []
    for _ in range(120):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(6, 200))]
        texts.append((" ".join(words * rng.choice([1, 1, 3])), " ".join(words[: int(len(words) * 0.8)])))
    left, right = zip(*texts)
    owner, shingle, count = bagminhash.shingle_bags([*left, *right], bagminhash.WordHash())
    s = bagminhash.signatures(owner, shingle, count, 240)
    found = np.array([(s[i] == s[i + 120]).mean() for i in range(120)])
    exact = np.array([similarity(bag(a), bag(b)) for a, b in texts])
    assert abs((found - exact).mean()) < 0.02
    assert (found - exact).std() < 0.06
    assert hashlib.md5(s[:3].tobytes()).digest() == hashlib.md5(bagminhash.signatures(owner, shingle, count, 240)[:3].tobytes()).digest()


@pytest.mark.parametrize("train,held", [("a b c", "a zzz"), ("a a", "a"), ("a a", "b b"), ("", "x"), (None, None)])
def test_katz_without_discounted_words(spark, train, held):
    """Every word occurs too often for a discount: unknown words and exhausted contexts keep a sliver."""
    out = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    inside = [i for i in range(400) if i not in out and zlib.crc32(str(i).encode()) % 10][:30]
    rows = [(i, train) for i in inside] + [(i, held) for i in out]
    got = {r.doc_id: r for r in katz.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    words = [*(train or "").split(), "</s>"]
    n, e = 30 * len(words), katz.ESCAPE
    p = lambda w: 30 * words.count(w) / (n + e) if w in words else e / (n + e)
    follow = collections.Counter(zip(["<s>", *words], words))
    context = collections.Counter(["<s>", *words[:-1]])

    def score(text):
        total, before = 0.0, "<s>"
        for w in [*(text or "").split(), "</s>"]:
            if (before, w) in follow:
                q = 30 * follow[before, w] / (30 * context[before] + e)
            elif before in context:
                kept = 30 * context[before] / (30 * context[before] + e)
                q = (1 - kept) / (1 - sum(p(x) for h, x in follow if h == before)) * p(w)
            else:
                q = p(w)
            total += math.log10(q)
            before = w
        return total

    for i, text in rows:
        assert math.isfinite(got[i].score) and abs(got[i].score - score(text)) < 1e-6


def test_decode_of_odd_ids(spark):
    voc = read_vocabulary(WORD)
    pieces = dict(voc.pieces())
    some = sorted(pieces)[5:8]
    rows = [(1, some), (2, []), (3, None), (4, [some[0], 10**8, some[2], some[0]]), (5, [-1])]
    got = {r.k: r.decoded for r in bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>"), voc).collect()}
    a, b, c = (pieces[i] for i in some)
    assert got == {1: f"{a} {b} {c}", 2: "", 3: None, 4: f"{a} {c} {a}", 5: ""}
    packed = [(k, None if i is None else bytearray(np.array(i, "<i4").tobytes())) for k, i in rows]
    assert got == {r.k: r.decoded for r in bpe.decode(spark.createDataFrame(packed, "k int, packed binary"), voc, ids="packed").collect()}


def test_word_numbers_survive_packing():
    rng = np.random.default_rng(2)
    cases = [[], [0], [2**32 - 2], [0, 1, 2, 3, 2**24, 2**24 - 1, 2**31], rng.zipf(1.3, 200_000) % 2**31, np.zeros(70_000), np.arange(65_536)]
    for case in cases:
        codes = np.asarray(case, dtype=np.int64)
        assert np.array_equal(bpe._unpack(bpe._pack(codes), len(codes)), codes)
