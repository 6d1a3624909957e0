import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import leaks, look_alikes, mixture, near_duplicates, pieces, split_overlap, term_counts
from textloom.llm import text as X

SYL = "가나다라마바사아자차카타파하거너더러머버"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYL) for _ in range(4)) for _ in range(n))


# ---- 1


def test_term_counts(spark):
    rows = [
        ("e1", ["A", " a ", None, "", "x  y"], None, 1, "clash"),
        ("e1", ["A", " a ", None, "", "x  y"], None, 2, "clash"),
        ("e2", ["a"], ["a"], 1, None),
        (None, ["a"], ["a"], 1, None),
        ("e3", [], None, None, None),
    ]
    df = spark.createDataFrame(rows, "id string, f array<string>, g array<string>, at int, bits string")
    got = {(r.field_name, r.term): (r.occurrences, r.records, r.mark) for r in term_counts.term_frequencies(df, "id", ["f", "g"], "at", rare_records=1, common_share=0.5).collect()}
    assert got == {("f", "a"): (3, 2, "common"), ("f", "x y"): (1, 1, "rare"), ("g", "a"): (1, 1, "rare")}
    assert term_counts.term_frequencies(df.limit(0), "id", ["f"], "at").count() == 0
    # a hot term over many buckets, against a plain count
    many = spark.range(5000).select(F.col("id").cast("string").alias("id"), F.array(F.lit("hot"), (F.col("id") % 7).cast("string")).alias("f"), F.lit(0).alias("at"))
    got = {r.term: r.records for r in term_counts.term_frequencies(many, "id", ["f"], "at", buckets=16).collect()}
    assert got["hot"] == 5000 and got["0"] == 715


# ---- 2


def brute(texts, least=0.7):
    g = {k: X.gram_set(X.plain_form(v)) for k, v in texts.items()}
    return {(a, b) for a, b in itertools.combinations(sorted(g), 2) if X.likeness(g[a], g[b]) >= least}


def test_near_duplicates(spark):
    r = random.Random(3)
    texts = {}
    for i in range(60):
        t = words(i, 40).split()
        texts[f"a{i:03}"] = " ".join(t)
        u = t[:]
        for _ in range(i % 5):
            u[r.randrange(len(u))] = words(1000 + i, 1)
        r.shuffle(u) if i % 7 == 0 else None
        texts[f"b{i:03}"] = " ".join(u)
    texts["c"] = texts["a000"]
    rows = [(k, None, "", v, "x") for k, v in texts.items()] + [("a000", None, "", texts["a000"], "y"), (None, "t", "s", texts["a001"], "z"), ("short", "t", "s", "가나", None), ("null", "t", "s", None, None), ("empty", None, None, "", None)]
    df = spark.createDataFrame(rows, "id string, title string, scope string, text string, code string")
    got = {(r.a, r.b) for r in near_duplicates.near_duplicate_pairs(df, "id", "text", ["title", "scope", "text"]).collect()}
    assert got == brute(texts)
    assert near_duplicates.near_duplicate_pairs(df.limit(0), "id", "text", ["text"]).count() == 0
    members, links = near_duplicates.near_duplicate_classes(df, "id", "text", ["text"])
    assert {r.rep for r in members.where("key in ('a000', 'c')").collect()} == {"a000"}
    assert links.where("likeness < 0.7").count() == 0


def test_chains_are_those_of_the_pigeonring_condition(spark):
    """Pairs come out exactly where a segment is equal and every chain from it keeps to its budget, hot or not."""
    r = random.Random(5)
    texts = [words(1, 30)]
    for _ in range(50):
        t = texts[r.randrange(len(texts))].split()
        for _ in range(r.randrange(4, 12)):
            t[r.randrange(len(t))] = words(r.randrange(10**6), 1)
        texts.append(" ".join(t))
    h = X.min_hashes([X.plain_form(t) for t in texts], near_duplicates.SEGMENTS * near_duplicates.SYMBOLS)
    own = X.symbols(h, 3).reshape(len(texts), near_duplicates.SEGMENTS, -1)
    full = X.symbols(h, 6).reshape(own.shape)
    want = set()
    for i, j in itertools.combinations(range(len(texts)), 2):
        d = (own[i] != own[j]).sum(1)
        for s in np.flatnonzero((full[i] == full[j]).all(1)):
            sums = np.cumsum(np.take(d, range(s, s + near_duplicates.CHAIN), mode="wrap"))
            if all(x <= (k + 1) * near_duplicates.TAU / near_duplicates.SEGMENTS for k, x in enumerate(sums)):
                want.add(frozenset((str(i), str(j))))
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, text string")
    codes = near_duplicates.coded(df, "key", "text", ["text"], 10).cache()
    classes = near_duplicates.classes_of(codes)
    rep = {x.id: x.rep for x in classes.collect()}
    for limit in (50_000, 3):
        got = [frozenset((rep[x.a], rep[x.b])) for x in near_duplicates.chained_pairs(classes, codes, limit=limit).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert 20 < len(want) < len(texts) * (len(texts) - 1) / 2


def test_recall_near_the_threshold():
    """Of pairs just over 0.7, chains and the Hamming check keep 98 % or more (by construction 99.6 %)."""
    r = random.Random(8)
    kept = total = 0
    for i in range(1200):
        t = words(i, 40).split()
        u = t[:]
        for _ in range(r.randrange(3, 8)):
            u[r.randrange(len(u))] = words(10**6 + 40 * i + r.randrange(40), 1)
        a, b = X.plain_form(" ".join(t)), X.plain_form(" ".join(u))
        if not 0.7 <= X.likeness(X.gram_set(a), X.gram_set(b)) <= 0.74:
            continue
        h = X.min_hashes([a, b], near_duplicates.SEGMENTS * near_duplicates.SYMBOLS)
        own = X.symbols(h, 3).reshape(2, near_duplicates.SEGMENTS, -1)
        same, d = (own[0] == own[1]).all(1) & (h[0] == h[1]).reshape(near_duplicates.SEGMENTS, -1).all(1), (own[0] != own[1]).sum(1)
        bits = sum(((int(x[0]) ^ int(x[1])) & (1 << 64) - 1).bit_count() for x in X.bit_planes(h))
        chains = [np.cumsum(np.take(d, range(s, s + near_duplicates.CHAIN), mode="wrap")) for s in np.flatnonzero(same)]
        met = any(all(x <= (k + 1) * near_duplicates.TAU / near_duplicates.SEGMENTS for k, x in enumerate(c)) for c in chains)
        total, kept = total + 1, kept + (met and bits <= near_duplicates.TAU_BITS)
    assert total > 100 and kept / total >= 0.98


# ---- 3


def check_pieces(got, s, size, overlap, anchors=()):
    """Pieces against the definition, without the operator's code for boundaries."""

    def kind(p):
        run = s[max(0, p - 16) : p]
        blank = run[len(run.rstrip()) :]
        if not blank:
            return 2 if s[p - 1] in "。！？" else 0
        if p == len(s) or s[p].isspace():
            return 0
        lines = len(blank.replace("\r\n", "\n").replace("\r", "\n").split("\n")) - 1
        return 4 if lines > 1 else 3 if lines == 1 else 2 if run.rstrip()[-1:] in tuple(".!?…。！？") else 1

    got = sorted(got)
    assert [p[0] for p in got] == list(range(len(got))) and got[0][3] == 0 and got[-1][2] == len(s)
    for (_, a, b, core, text), after in zip(got, [*got[1:], None], strict=True):
        assert a == max(0, core - overlap) and text == s[a:b] and b - core <= size
        if after:
            assert after[3] == b
            if b not in anchors:
                best = max(range(core + 1, min(core + size, len(s) - 1) + 1), key=lambda p: (kind(p), p))
                assert b == (best if kind(best) else core + size), (core, b, best, kind(best), kind(b))


@pytest.mark.parametrize("range_bytes", [1, 5000, 1 << 20])
def test_pieces_keep_to_the_definition(spark, range_bytes):
    r = random.Random(2)
    long = "".join(r.choice(["가나다 ", "단어. ", "끝!\n", "문단\r\n\r\n", "😀a", "b", "\t", "。다"]) for _ in range(2500))
    rows = [("a", long, 60, 10, 1), ("a", long, 60, 10, 2), ("b", "x" * 5000, 60, None, 1), ("c", "short", 60, 10, 1), ("d", None, 60, 10, 1), ("e", "", 60, 10, 1), (None, long, 60, 10, 1), ("f", long, None, 10, 1), ("g", "y" * 70, 60, 10, 1), ("h", "y" * 71, 60, 10, 1), ("i", "zz" * 30, 1, 0, 1)]
    df = spark.createDataFrame(rows, "key string, body string, size int, overlap int, piece_no int")
    got = pieces.pieces(df, "key", "body", F.col("size"), F.col("overlap"), range_bytes)
    by = {}
    for x in got.collect():
        by.setdefault(x.id, []).append((x.piece_no, x.char_start, x.char_end, x.core_start, x.text))
    assert set(by) == {"a", "b", "h", "i"}
    width = pieces.range_width(60, 10, range_bytes)
    ends = {len(long.encode()[: width * k].decode(errors="ignore")) for k in range(1, len(long.encode()) // width + 1)}
    near = {p for e in ends for p in range(e - 30, e + 2)}
    check_pieces(by["a"], long, 60, 10, near)
    check_pieces(by["h"], "y" * 71, 60, 10)
    check_pieces(by["i"], "zz" * 30, 1, 0)
    assert "".join(x[4] for x in sorted(by["b"])) == "x" * 5000 and max(len(x[4]) for x in by["b"]) == 60
    if range_bytes == 1 << 20:
        assert not any(x[2] in near for x in by["a"][:0]) and [len(x[4]) for x in sorted(by["h"])] == [60, 21]
    assert pieces.pieces(df.limit(0), "key", "body", F.col("size"), F.col("overlap")).count() == 0


def test_file_ranges(spark, tmp_path):
    s = "문장 하나. " * 4000 + "\n\n" + "abc " * 3000
    p = tmp_path / "f.txt"
    p.write_text(s, encoding="utf-8")
    files = spark.createDataFrame([("f", str(p), p.stat().st_size, 100, 20)], "id string, path string, n_bytes long, size int, overlap int")
    got = pieces.cut_ranges(pieces.file_ranges(spark, files, 3333)).collect()
    width = pieces.range_width(100, 20, 3333)
    ends = {len(s.encode()[: width * k].decode(errors="ignore")) for k in range(1, len(s.encode()) // width + 1)}
    check_pieces([(x.piece_no, x.char_start, x.char_end, x.core_start, x.text) for x in got], s, 100, 20, {p for e in ends for p in range(e - 50, e + 2)})


# ---- 4


def test_split_overlap(spark):
    q = [words(i, 14) for i in range(30)]
    results = [("test", "s", f"e{i}", q[i], ["c1", "c2", "c3", f"x{i}"] if i < 2 else [f"x{i}"], 0) for i in range(10)] + [("dev", "s", "same", None, None, 0), ("dev", None, None, q[0], None, 0)]
    train = [("t0", q[0] + " 덧붙임", ["c3", "c2", "c1", "c1", None]), ("t1", q[1].upper(), None), ("t1", q[1].upper(), None), ("same", "", []), ("t9", q[20], ["k1"]), (None, q[3], None)]
    config = [("dev", "z", [" DOC-1 ", None, "unknown", "doc-1"]), ("dev", "y", None)]
    frames = [
        spark.createDataFrame(results, "split string, source string, qid string, query_text string, gold_chunk_ids array<string>, q int"),
        spark.createDataFrame(train, "qid string, question string, gold_chunk_ids array<string>"),
        spark.createDataFrame(config, "split string, source string, exclude_doc_ids array<string>"),
        spark.createDataFrame([("doc-1",), ("doc-2",), (None,)], "doc_id string"),
        spark.createDataFrame([("k1", "doc-1"), ("c1", None), (None, "doc-1")], "chunk_id string, document_key string"),
    ]
    got = {tuple(r) for r in split_overlap.overlaps(*frames).collect()}
    want = {("dev", "s", "same", "same", "qid"), ("test", "s", "e0", "t0", "question"), ("test", "s", "e1", "t1", "question"), ("test", "s", "e0", "t0", "gold_ids"), ("test", "s", "e1", "t0", "gold_ids"), ("dev", "z", "doc-1", "t9", "reserved_document")}
    assert got == want
    assert split_overlap.overlaps(*[f.limit(0) for f in frames]).count() == 0


def test_hot_ids_and_blocks_are_split_without_loss(spark):
    left = spark.createDataFrame([(i, ["hot", "b", "c", f"l{i}"]) for i in range(30)], "k int, ids array<string>")
    right = spark.createDataFrame([(i, ["hot", "b", "c", f"r{i}"]) for i in range(20)] + [(99, ["hot", "b", "x"]), (98, None)], "k int, ids array<string>")
    got = split_overlap.sharing_sets(left, right, limit=4)
    assert {(r.ka, r.kb) for r in got.collect()} == {(i, j) for i in range(30) for j in range(20)}
    q = lambda n, s: spark.createDataFrame([(words(1, 14) + " " + words(s + i, 2),) for i in range(n)], "q string")
    a, b = q(12, 50), q(9, 900)
    want = {tuple(r) for r in split_overlap.alike_texts(a, b).collect()}
    assert want and want == {tuple(r) for r in split_overlap.alike_texts(a, b, limit=3).collect()}


def test_blocks_lose_few_pairs_at_the_threshold():
    assert (1 - 0.7**split_overlap.LANES) ** split_overlap.BLOCKS < 0.0005
    assert split_overlap.RADIUS >= 128 * 0.15 + 3.3 * (128 * 0.15 * 0.85) ** 0.5


# ---- 5


def test_look_alikes(spark):
    rows = [("1", "ABC"), ("2", "АВС"), ("3", "ABC"), ("4", "abc"), ("5", None), (None, "ABC"), ("2", "АВС"), ("6", "")]
    df = spark.createDataFrame(rows, "key string, raw string")
    got = {tuple(r) for r in look_alikes.look_alike_pairs(df, "key", ["raw"]).collect()}
    assert got == {("1", "2"), ("2", "3")}
    assert look_alikes.look_alike_pairs(df.limit(0), "key", ["raw"]).count() == 0
    forms = [r.c for r in df.select(look_alikes.consistent_form("raw").alias("c")).collect()]
    assert forms == ["ABC", "ABC", "ABC", "abc", None, "ABC", "ABC", ""]


# ---- 6


def test_leaks(spark):
    items = [(i, words(i, 40), "k") for i in range(12)] + [(50, "가나", "k"), (51, None, "k"), (None, words(3, 40), "k"), (0, words(0, 40), "k")]
    p = {i: X.plain_form(t) for i, t, _ in items if i is not None and t}
    docs = [(i, words(500 + i, 80)) for i in range(40)]
    docs += [(100, words(901, 30) + p[1][7:67] + words(902, 30)), (101, words(903, 30) + p[2][7:66] + words(904, 30)), (102, "\n".join(items[3][1].split())), (103, None), (104, ""), (None, items[1][1]), (102, "\n".join(items[3][1].split())), (105, items[4][1] + items[5][1])]
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, item_id string")
    e = spark.createDataFrame(items, "item_id long, passage string, doc_id string")
    want = {(k, i) for k, t in docs if k is not None and t for i, q in p.items() if len(q) >= 60 and any(q[j : j + 60] in X.plain_form(t) for j in range(len(q) - 59))}
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(d, e).collect()}
    assert got == want and (100, 1) in got and not any(k == 101 for k, _ in got)
    assert leaks.leaks(d.limit(0), e).count() == 0 == leaks.leaks(d, e.limit(0)).count()


def test_paraphrases_with_production_parameters(spark):
    """Changed every ten or eight characters: found; every four, elsewhere or without the answer: not."""
    base = words(7, 50).replace(" ", "")
    changed = lambda k: "".join("z" if i % k == k - 1 else c for i, c in enumerate(base))
    docs = [(k, words(40 + k, 300) + changed(k) + " ABC-12345 " + words(90 + k, 300)) for k in (10, 8, 4)] + [(1, words(8, 60) + " ABC-12345"), (2, words(9, 60)), (3, changed(10))]
    # the same characters in the same order, but scattered over a long text
    docs.append((5, " ".join(c + w for c, w in zip(base, words(77, len(base)).split(), strict=True)) + " ABC-12345"))
    docs += [(100 + i, words(200 + i, 60)) for i in range(60)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame([(7, base + " ABC-12345")], "item_id long, passage string")
    got = {(r.doc_id, r.kind) for r in leaks.leaks(d, e, paraphrases=True).collect()}
    assert got == {(10, "paraphrase"), (8, "paraphrase")}
    assert leaks.leaks(d, e).count() == 0


def test_truncated_spaces_lose_nothing():
    """Five thousand passages in spaces of 125 with 96 directions: every window with 60 characters is a candidate."""
    n = 5000
    plains = [X.plain_form(words(i, 36)) for i in range(n)]
    g, starts = X.grams(plains, leaks.N)
    terms, number = np.unique(g, return_inverse=True)
    m = leaks.Model(list(range(n)), plains, [[]] * n, terms, starts, number, 60)
    r = np.random.default_rng(1)
    m.weigh(r.uniform(1, 12, len(terms)), starts, number)
    rows = [leaks._latent_space(leaks.RANK)(p).iloc[0] for _, p in m.entries().query("space in (0, 7, 19)").groupby("space")]
    rest = [s for s in range(len(m.edges) - 1) if s not in (0, 7, 19)]
    m.add_spaces(rows)
    for s in rest:  # not needed here
        m.fold[s], m.latent[s] = np.zeros((m.edges[s + 1] - m.edges[s], 1), np.float32), np.zeros((m.edges[s + 1] - m.edges[s], 1), np.float32)
    items = [i for s in (0, 7, 19) for i in range(m.edges[s], m.edges[s + 1], 9)]
    texts = [X.plain_form(words(10**6 + i, 30)) + plains[i][11:71] + X.plain_form(words(2 * 10**6 + i, 30)) for i in items]
    tg, ts = X.grams(texts, leaks.N)
    exact, _ = leaks.candidates(m, leaks.Vocabulary(terms), tg, ts, None)
    assert {(d, i) for d, i in enumerate(items)} <= exact
    assert len({x for x in exact if m.space[x[1]] in (0, 7, 19)}) < 40 * len(items)
    assert all(leaks.common_run(plains[i], t, 60) for i, t in zip(items, texts, strict=True))


def test_svd_and_lcs():
    r = np.random.default_rng(0)
    a = (r.random((15, 40)) < 0.2) * r.random((15, 40))
    item, term = np.nonzero(a)
    m = leaks.randomised_svd(item, term, a[item, term], 15, 15)
    v = a.T @ m
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-3)
    assert np.allclose(a @ v @ v.T, a, atol=1e-3)
    assert leaks.lcs_length("abcbdab", "bdcaba") == 4 and leaks.lcs_length("", "a") == 0
    s = "".join(random.Random(3).choice("abc") for _ in range(300))
    for p in ("abcabca", "aabbccaabb", s[100:110], s[50:57] + "d"):
        assert leaks.common_run(p, s, 6) == any(p[j : j + 6] in s for j in range(len(p) - 5))


def test_blocks_of_passages(spark, monkeypatch):
    monkeypatch.setattr(leaks, "PASS_CHARS", 400)
    items = [(i, words(i, 40)) for i in range(12)]
    d = spark.createDataFrame([(i, words(500 + i, 20) + t[20:120]) for i, t in items], "doc_id long, text string")
    got = {tuple(r)[:2] for r in leaks.leaks(d, spark.createDataFrame(items, "item_id long, passage string")).collect()}
    assert got == {(i, i) for i in range(12)}


# ---- 7


def test_water_fill():
    got = mixture.water_fill({"a": 100, "b": 100, "c": 800}, {"a": (0.5, 2), "b": (0.25, 10), "c": (0.25, 1), "d": (0.5, 1)})
    assert got == {"a": 200.0, "b": 400.0, "c": 400.0}
    assert mixture.water_fill({"a": 10}, {"a": (1.0, 2)}, 1000) == {"a": 20.0}
    assert mixture.water_fill({}, {"a": (1.0, 1)}) == {} and mixture.water_fill({"a": 5}, {"a": (0.0, 3)}) == {}


def test_mix(spark):
    tokens = spark.range(20000).select("id", F.when(F.col("id") % 3 == 0, "big").when(F.col("id") < 200, "tiny").otherwise("mid").alias("source"), (F.col("id") % 40 + 1).alias("n_tokens")).withColumnRenamed("id", "doc_id")
    targets = spark.createDataFrame([("big", 0.2, 2), ("tiny", 0.3, 3), ("mid", 0.4, 2), ("none", 0.1, 1), (None, 0.5, 1), ("null", None, None)], "source string, target_share double, max_repeats int")
    m = mixture.mix(tokens, targets).cache()
    assert m.groupBy("doc_id").count().where("count > 1").count() == 0
    assert m.groupBy("source").agg(F.max("repeats").alias("r")).where("source = 'tiny'").first().r == 3
    s = {r.source: r for r in mixture.shares(m, targets.where("source is not null")).collect()}
    sizes = {r.source: r.n for r in tokens.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    want = mixture.water_fill(sizes, {"big": (0.2, 2), "tiny": (0.3, 3), "mid": (0.4, 2)})
    for k, v in want.items():
        assert abs(s[k].tokens - v) <= 41
    assert s["none"].tokens == 0 and abs(sum(x.actual_share for x in s.values()) - 1) < 1e-9
    assert {tuple(r) for r in m.collect()} == {tuple(r) for r in mixture.mix(tokens.repartition(7), targets).collect()}
    assert mixture.mix(tokens.limit(0), targets).count() == 0 == mixture.mix(tokens, targets.limit(0)).count()


def test_counted_skips_blank_texts(spark):
    df = spark.createDataFrame([(1, "hello 세계", "a"), (2, None, "a"), (3, " \n", "a"), (4, "x", None), (5, "y" * 3000, "b")], "doc_id long, text string, source string")
    got = {r.doc_id: r.n_tokens for r in mixture.counted(df, "doc_id", "text", "source").collect()}
    assert set(got) == {1, 5} and got[1] > 1
