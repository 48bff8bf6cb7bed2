"""Line dedup, periodic runs and the Merkle manifest against plain restatements."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ember.llm import line_runs, merkle, periodic_runs, queries

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, row string, batch int, size int, pos int, words string, runs string"


def documents(spark, rows):
    """Rows of (doc_id, text, lang, source, n_chars) with extra columns that clash with inner names."""
    return spark.createDataFrame([(*r, "k", "r", 1, 2, 3, "w", "u") for r in rows], DOC)


# --- lines -------------------------------------------------------------------

LINES = [f"This line number {i} is long enough to be a boilerplate line" for i in range(6)]


def line_rows():
    rng = random.Random(5)
    rows = []
    for i in range(60):
        lines = [f"own line of document {i}, which nobody else has, part {j}" for j in range(2)] + rng.sample(LINES, rng.randrange(4))
        lines += [rng.choice(["short", "", "  \t" + LINES[0].upper() + "\r", "x" * 39, "é" * 40, "É" * 40])]
        rng.shuffle(lines)
        rows.append((i if i % 13 else None, "\n".join(lines * rng.choice([1, 1, 2])), "en", "a", 1))
    # repeated rows, one id with several texts, nulls, empties, a very long text
    rows += [rows[3]] * 4 + [(59, LINES[1] + "\n" + LINES[2], "en", "a", 1), (59, None, None, None, None), (70, "", "en", "a", 1), (None, None, "x", "a", 1)]
    rows += [(71, "\n".join([LINES[3], "filler"] * 20_000), "en", "a", 1)]
    return rows


def plain_lines(rows, shortest, least):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keys = [[line.strip(" \t\n\x0b\x0c\r").translate(lower) for line in (r[1] or "").split("\n")] for r in rows]
    held = collections.Counter(k for ks in keys for k in set(ks) if len(k) >= shortest)
    order = lambda i: (i is not None, i or 0)
    last = {}
    for r, ks in zip(rows, keys):
        for k in ks:
            last[k] = max(last.get(k, (False, 0)), order(r[0]))
    out = []
    for r, ks in zip(rows, keys):
        lines = (r[1] or "").split("\n")
        kept = [line for line, k in zip(lines, ks) if not (held[k] >= least and order(r[0]) != last[k])]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fan,hot", [(6, 2, 4096), (1, 3, 4096), (4, 3, 2)])
def test_lines_equal_brute_force(spark, monkeypatch, batches, fan, hot):
    monkeypatch.setattr(line_runs, "HOT_SHARE", hot)
    rows = line_rows()
    got = line_runs.drop_repeated_lines(documents(spark, rows), batches=batches, fan=fan).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_lines(rows, 40, 5)


def test_no_run_is_moved_when_a_batch_meets_it(spark):
    runs = line_runs.LineRuns(spark, fan=2)
    some = lambda a, b: spark.range(a, b).select(F.encode(F.col("id").cast("string"), "utf-8").alias("key"), F.col("id").alias("last"))
    runs.add(some(0, 50))
    batch = some(40, 60).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    marked = runs.seen(batch)
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1  # the batch alone is exchanged
    assert {r.key.decode() for r in marked.where("seen").collect()} == {str(i) for i in range(40, 50)}
    runs.add(some(50, 60))
    assert [len(level) for level in runs.levels] == [0, 1]  # compacted
    assert sum(r.count() for r in runs.runs()) == 60
    runs.close()


def test_lines_of_nothing(spark, nothing, messy):
    assert line_runs.drop_repeated_lines(nothing).count() == 0
    assert line_runs.drop_repeated_lines(messy).count() == messy.count()


# --- periodic runs -----------------------------------------------------------


def plain_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        equal = [a == b for a, b in zip(words, words[q:])] + [False]
        start = None
        for i, e in enumerate(equal):
            if e and start is None:
                start = i
            elif not e and start is not None:
                n = i - start + q
                smaller = any(all(words[start + t] == words[start + t + p] for t in range(n - p)) for p in range(1, q))
                if n >= max(6, 4 * q) and not smaller:
                    out.append((start, n, q))
                start = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def run_texts():
    rng = random.Random(9)
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b " * 4 + "a", "a\x0bb\x1cc  a\rb\x1cc " * 5, "é ü " * 9 + "z " + "é ü " * 5]
    for _ in range(120):
        k = rng.choice([1, 2, 3, 5, 40])
        words = [rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMN"[:k]) for _ in range(rng.randrange(1, 70))]
        if rng.random() < 0.6:
            piece = words[: rng.randrange(1, 9)]
            words += piece * rng.randrange(3, 7) + piece[: rng.randrange(len(piece))] + words[:5]
        texts.append(" ".join(words))
    texts.append(" ".join(["x y z w"] * 30_000))
    return texts


def test_runs_equal_brute_force(spark):
    texts = run_texts()
    got = {r.doc_id: r for r in periodic_runs.find_runs(documents(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)])).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts[:-1]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = plain_runs(words)
        assert [tuple(r) for r in got[i].runs] == runs and got[i].n_words == len(words)
        assert got[i].collapsed == collapsed(words, runs)
    assert [tuple(r) for r in got[len(texts) - 1].runs] == [(0, 120_000, 4)] and got[len(texts) - 1].collapsed == "x y z w"


def test_query_of_runs_equals_brute_force(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i if i != 7 else None, None if i % 50 == 9 else " ".join(rng.choice("abcdefgh"[: 2 + i % 7]) for _ in range(rng.randrange(120))), "en", "a", 1) for i in range(400)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    tails = 0
    for doc_id, text, *_ in rows:
        words = (text or "").split()
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            tails += 1
        runs, r = plain_runs(words), got[doc_id]
        best = max(runs, key=lambda x: (x[1] * 840 * 8 * 9 * 11 * 13 * 17 * 19 * 23 * 29 / x[2], -x[0], -x[2]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert tails > 20


def test_many_frequent_words_need_no_square(spark):
    codes = np.random.default_rng(1).integers(0, 4, 200_000)
    at, segment = periodic_runs.surviving(codes, np.zeros(len(codes), int))
    assert len(at) == len(codes)  # nothing is rare, so the lag scan sees everything
    start, length, period = periodic_runs.lag_scan(codes, segment)
    assert len(start) > 0
    for s, n, q in zip(start, length, period):
        piece = codes[s : s + n]
        assert (piece[q:] == piece[:-q]).all() and n >= max(6, 4 * q)


def test_runs_of_nothing(spark, nothing, messy):
    assert periodic_runs.find_runs(nothing).count() == 0
    assert periodic_runs.repeat_tails(messy).count() == messy.count()


# --- manifest ----------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def leaf(r, text):
        fields = [r[0], r[3], r[2], r[4], text]
        return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])

    def tree(nodes):
        """Root and, per node, its (left, right) siblings upwards."""
        steps = [[] for _ in nodes]
        where = list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
            for i, at in enumerate(where):
                run, me = runs[at // 16], at % 16
                steps[i].append((run[:me], run[me + 1 :]))
                where[i] = at // 16
            nodes = [digest(*r) for r in runs]
        return nodes[0], steps

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    inner = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    root, outer = tree([inner[s][0] for s in names])
    out = []
    for s, above in zip(names, outer):
        for (_, _, mine, r), steps in zip(sorted(groups[s], key=lambda x: x[:3]), inner[s][1]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            fold = leaf(r, r[1].translate(lower)) if hit and r[1] is not None else mine
            proof = []
            for left, right in steps + above:
                proof += left + right
                fold = digest(*left, fold, *right)
            out.append((r[0], mine, inner[s][0], root, digest(*proof), fold, fold == root))
    return sorted(out, key=str)


def manifest_rows(sources, per):
    rows = [(i, f"Text {i} ÀÉ", "en", f"s{i % sources}", i) for i in range(sources * per)]
    rows += [(None, "x", "en", "s0", 1), (None, None, None, None, None), (3, None, "de", None, 2), (5, "", "", "", 0), (5, "A", "", "", 0), (5, "A", "", "", 0)]
    return rows + [(10**17 + 1, "X" * 300_000, "en", "s0", 1)]


@pytest.mark.parametrize("sources,per,inner", [(3, 40, 3), (40, 7, 1), (2, 700, 1), (1, 300, 2)])
def test_manifest_equals_plain_restatement(spark, sources, per, inner):
    rows = manifest_rows(sources, per)
    docs = documents(spark, rows)
    got = merkle.manifest(docs, merkle.lowered_text(docs), inner=inner)
    got = got.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256), "folded_root", "verified").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_manifest(rows)
    assert any(not r.verified for r in got)


def test_proof_rebuilds_the_root(spark):
    rows = manifest_rows(3, 40)
    for r in merkle.manifest(documents(spark, rows)).collect():
        h = r.leaf
        for siblings, me in zip(r.proof, r.path):
            h = digest(siblings[: 64 * me], h, siblings[64 * me :])
        assert h == r.root == r.folded_root and r.verified


def test_manifest_of_little(spark, nothing):
    assert merkle.manifest(nothing).count() == 0
    (one,) = merkle.manifest(documents(spark, [(1, "a", "en", "s", 1)])).collect()
    assert one.leaf == one.subroot == one.root and one.proof == [] and one.verified
