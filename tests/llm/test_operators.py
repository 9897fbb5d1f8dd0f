"""Each training-data operator against a plain version, on small tables with
nulls, empty and long texts, ties, repeated rows and extra columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from rankloom.llm import byte_bpe, jaccard, lz, maxent, packing, pii, quality, queries, suffix_dedup, token_files, urls

WORD = re.compile("[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PROSE = "the quick brown fox jumps over the lazy dog and then runs far away into the deep green forest near home "
ROWS = [
    (0, PROSE * 3, "a"), (1, PROSE * 3, "b"), (2, (PROSE * 3).replace("quick", "slow", 1), None), (3, None, "x"), (4, "", "x"),
    (5, "one two", "x"), (6, "ONE  two\n", "x"), (7, "Mail bob.x@mail.example.org or +44 20 7946 0958, card 4111 1111 1111 1111, ip 10.0.0.256 10.0.0.7", "x"),
    (8, "é日本 ünï ß  x y's I'll 123 !!", None), (9, "".join(chr(97 + i * i % 26) for i in range(9000)) + " " + "ab " * 6000, "long"),
    (9, "repeated id", "x"), (9, "repeated id", "x"), (None, "no id here but some words that are long enough to stay", "x"), (11, "| # | # " * 9, "x"),
]
SCHEMA = "doc_id long, text string, id string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, drop=()):
    return sorted((tuple(r[c] for c in df.columns if c not in drop) for r in df.collect()), key=repr)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(3)
    for n, kinds in ((1, 1), (7, 1), (50, 2), (300, 3), (300, 256)):
        x = rng.integers(0, kinds, n).astype(np.uint8)
        sa, b = suffix_dedup.suffix_array(x), x.tobytes()
        assert list(sa) == sorted(range(n), key=lambda i: b[i:])
        shared = suffix_dedup.common_prefixes(x, sa, lanes=4)
        for i in range(1, n):
            u, v = b[sa[i]:][:50], b[sa[i - 1]:][:50]
            same = next((k for k, (p, q) in enumerate(zip(u, v)) if p != q), min(len(u), len(v)))
            assert shared[sa[i]] == same


def test_suffix_dedup(docs, empty):
    big = 1 << 63
    texts = sorted(((big if d is None else d, (t or "").encode()) for d, t, _ in ROWS))
    first = {}
    for d, t in texts:
        for p in range(len(t) - 49):
            first.setdefault(t[p:p + 50], d)
    want = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first[t[p:p + 50]] < d:
                gone[p:p + 50] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone]) if t else b""
        want.append((None if d == big else d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    assert rows_of(suffix_dedup.digest(docs)) == sorted(want, key=repr)
    assert suffix_dedup.digest(empty).count() == 0
    cut = suffix_dedup.remove(docs)
    assert cut.columns == docs.columns and cut.count() == len(ROWS)


def test_suffix_dedup_ids_that_are_null_or_repeated(spark):
    part = ["".join(chr(97 + (i * i * (k + 3) + i * k) % 26) for i in range(70 + k)) + f" part {k}; " for k in range(6)]
    rows = [(1, part[0]), (1, part[1]), (2, part[2]), (3, "aa " + part[0] + "own words of the first"), (3, part[1] + "second " + part[3] + part[2]),
            (3, "third " + part[3] + " without"), (3, "aa " + part[0] + "own words of the first"), (None, "x " + part[3] + " y"), (None, part[1] + part[4]),
            (None, "z" + part[4] + part[2]), (None, part[1] + part[4]), (None, part[5] * 2), (8, part[1])]
    big = (1 << 63) - 1
    first = {}
    for d, t in sorted((big if d is None else d, t) for d, t in rows):
        for p in range(len(t) - 49):
            first.setdefault(t[p:p + 50], d)
    want = []
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first[t[p:p + 50]] < (big if d is None else d):
                gone[p:p + 50] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t.encode(), np.uint8)[~gone])).hexdigest()))
    table = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    assert rows_of(suffix_dedup.digest(table)) == sorted(want, key=repr)


def test_common_parts_filed_string_by_string(docs, monkeypatch):
    want = rows_of(suffix_dedup.digest(docs))
    monkeypatch.setattr(suffix_dedup, "COMMON", 1)
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", 200)
    assert rows_of(suffix_dedup.digest(docs)) == want


def test_quality(docs, empty):
    got = {r: n for r, n in collections.Counter(rows_of(quality.digest(quality.judge(docs)))).items()}
    want = collections.Counter()
    for d, t, _ in ROWS:
        w = WORD.findall(t or "")
        n = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        rep = len({i + k for i in range(len(w) - 4) if n[tuple(w[i:i + 5])] > 1 for k in range(5)})
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        base = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), rep)
        want[(d, *base, len(w) < 10 or 100 * rep > 20 * len(w))] += 1
    assert collections.Counter(r[:-1] for r, n in got.items() for _ in range(n)) == want
    assert all(not r[-1] for r in got if r[-2])
    assert quality.keep(docs).columns == docs.columns and quality.keep(empty).count() == 0
    # the order of the rules never changes what stays
    other = quality.keep(docs, rules=quality.RULES[::-1])
    assert rows_of(other) == rows_of(quality.keep(docs))


def test_fingerprints(docs, empty):
    rows = {r["doc_id"]: r for r in lz.digest(docs, range_bytes=4000).collect()}
    order = sorted(((1 << 63 if d is None else d, t or "") for d, t, _ in ROWS), key=lambda r: (-r[0], r[1]))
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        if d == 9:
            continue
        half = len(t) // 2
        new = t[:len(t) - half] + nxt[:half]
        r = rows[None if d == 1 << 63 else d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"] and rows[1]["near_next"] == 1.0
    assert rows[2]["near_next"] > 0.5 and lz.digest(empty).count() == 0


def test_fingerprints_of_texts_without_spaces():
    rng = np.random.default_rng(8)
    letters = {"list": "абвгдежзиклм", "tabs": "abcdefghijkl", "none": "abcdefghijkl", "two bytes": "абвгдежзиклм", "spaces": "abcdefghijkl"}
    part = {"list": "\n", "tabs": "\t", "none": "", "two bytes": "", "spaces": " "}
    for kind, own in letters.items():
        text, other = (part[kind].join("".join(own[i] for i in rng.integers(0, 12, 6)) for _ in range(400)) for _ in range(2))
        new = lz.edited(text, other)
        sig, near = lz.fingerprints([text, new], [new, ""])
        assert (sig[0] == near[0]).mean() > 0.2, kind
        assert (sig[1] == near[0]).all()  # the edited form is what its own parse gives
        assert b"".join(lz.units(text.encode())[0]) == text.encode()


def test_urls(spark):
    pages = [(1, "http://a.example.org/es/1"), (2, "https://EXAMPLE.org/en/17?x"), (3, "http://x.com/fr/"), (4, "x.com/de/1"), (5, None),
             (6, "http://badexample.org/es/"), (7, "ftp://a.b.com/de/é#f"), (8, "://org"), (8, "http://net/")]
    got = rows_of(urls.judge(spark.createDataFrame(pages, "page_id long, url string")))
    assert got == sorted([
        (1, "a.example.org", "/es/1", "example.org/es/", "block"), (2, "example.org", "/en/17", "example.org/en/1", "block"),
        (3, "x.com", "/fr/", "com/fr/", "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"),
        (6, "badexample.org", "/es/", "org/", "allow"), (7, "a.b.com", "/de/é", "com/de/", "block"), (8, "org", "", None, "allow"),
        (8, "net", "/", None, "allow")], key=repr)
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_cascade_is_exact_for_long_lists(spark):
    hosts = [f"h{i}.net" for i in range(4000)]
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, h in enumerate(hosts)], "page_id long, url string")
    rules = [("block", h, "/") for h in hosts[::3]]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, rules).collect()}
    assert got == {i: "block" if i % 3 == 0 else "allow" for i in range(4000)}


def test_jaccard(spark, docs, empty):
    more = [(100 + i, " ".join(f"w{(j * 7 + (j // 40 == i % 5) * i) % 211}" for j in range(200)), "x") for i in range(40)]
    table = docs.filter("doc_id IS NULL OR doc_id != 9").unionByName(spark.createDataFrame(more, SCHEMA))
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    sets = {}
    for d, t in texts.items():
        w = WORD.findall((t or "").translate(LOW))
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    group = {d: {d} for d in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                union = group[a] | group[b]
                for x in union:
                    group[x] = union
    want = [(d, len(s), min(group[d], key=lambda x: (x is None, x or 0))) for d, s in sets.items()]
    assert rows_of(jaccard.digest(table)) == sorted(want, key=repr)
    assert jaccard.digest(empty).count() == 0
    assert jaccard.one_of_each(table).count() == len({min(g, key=lambda x: (x is None, x or 0)) for g in group.values()})


def test_jaccard_ids_that_are_null_or_repeated(spark):
    words = [f"w{i}" for i in range(60)]
    text = lambda k: " ".join(f"{w}x{k}" for w in words)
    near = lambda k: text(k) + " more"
    rows = [(None, text(0)), (None, text(1)), (None, text(2)), (None, near(2)), (None, text(0)), (4, text(3)), (4, text(4)), (4, text(5)), (4, text(5)),
            (2, near(4)), (9, text(5)), (None, near(5)), (1, text(6)), (None, near(6)), (7, ""), (None, ""), (None, "\t")]
    table = spark.createDataFrame([(d, t, str(i)) for i, (d, t) in enumerate(rows)], SCHEMA)
    of = {0: None, 1: None, 2: None, 3: 4, 4: 2, 5: 4, 6: 1}
    want = []
    for d, t in rows:
        k = int(t.split()[0].split("x")[1]) if t.split() else None
        want.append((d, max(0, len(t.split()) - 4), d if k is None else of[k]))
    assert rows_of(jaccard.digest(table)) == sorted(want, key=repr)
    kept = jaccard.one_of_each(table)
    assert kept.columns == table.columns
    got = rows_of(kept.select("doc_id", "text"))
    two = [r for r in got if r[1] in (text(2), near(2))]
    assert len(two) == 1
    assert [r for r in got if r not in two] == sorted(
        [(None, text(0)), (None, text(1)), (4, text(3)), (2, near(4)), (4, text(5)), (1, text(6)), (7, ""), (None, ""), (None, "\t")], key=repr)


def test_jaccard_reads_no_text_again_for_its_result(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = jaccard.digest(texts)
    assert not any("documents.parquet" in f for f in out.inputFiles()) and out.count() == texts.count()


def test_jaccard_links(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:60 - i] + [f"own{i}"]), "x") for i in range(20)] + [
        (30, " ".join(words), "x"), (31, " ".join(words).upper(), "x"), (31, " ".join(words), "x"), (31, " ".join(words), "x"),
        (None, "\n".join(words), "x"), (None, " ".join(words[5:]), "x"), (40, "a b", "x"), (41, "A  b", "x"), (42, "", "x"), (43, None, "x"), (44, " ", "x"), (45, "all alone here", "x")]
    table = spark.createDataFrame(rows, SCHEMA)
    docs = {(d, t or "") for d, t, _ in rows}
    sets = {}
    for d, t in docs:
        w = WORD.findall(t.translate(LOW))
        sets[d, t] = frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} - {()})
    near = lambda a, b: len(a & b) and 100 * len(a & b) >= 80 * len(a | b)
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    want = [(d, md5(t or ""), sum(1 for o in docs if o != (d, t or "") and near(sets[o], sets[d, t or ""]))) for d, t, _ in rows]
    assert rows_of(jaccard.link_counts(table)) == sorted(want, key=repr)
    size = collections.Counter(sets.values())
    of = {md5(t): s for (_, t), s in sets.items()}
    got = jaccard.links(table).collect()
    pairs = {frozenset((of[r["md5_a"]], of[r["md5_b"]])) for r in got}
    kinds = list(size)
    assert pairs == {frozenset((a, b)) for a in kinds for b in kinds if a != b and near(a, b)} and len(got) == len(pairs)
    assert all((r["n_docs_a"], r["n_docs_b"]) == (size[of[r["md5_a"]]], size[of[r["md5_b"]]]) for r in got)


def encode_all():
    from tokenizers import Tokenizer

    from rankloom.llm.tokens import vocabulary
    t = Tokenizer.from_file(vocabulary())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids + [1]


def test_token_files(spark, docs, empty):
    got = rows_of(token_files.digest(token_files.round_trip(spark, docs, task_bytes=9000, file_ids=500)))
    encode, at, want = encode_all(), 0, []
    for d, t, _ in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = encode(t)
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    # rows that share id 9 may stand in any order among themselves
    assert sorted((r[0], r[2], r[3]) for r in got if r[0] == 9) == sorted((r[0], r[2], r[3]) for r in want if r[0] == 9)
    assert {r for r in got if r[0] != 9} == {r for r in want if r[0] != 9} and len(got) == len(want)
    assert token_files.round_trip(spark, empty).count() == 0


def test_boundary_list():
    rng = np.random.default_rng(1)
    for n, most in ((1, 1), (5, 1), (700, 3), (2000, 5000)):
        ends = np.cumsum(rng.integers(1, most + 1, n))
        b = token_files.BoundaryList.of(ends)
        assert (b.all() == ends).all() and all(b.select(i) == ends[i] for i in range(n))
        for i, j in ((0, n), (n // 3, n), (n // 2, n // 2 + 1), (max(0, n - 300), n - 1)):
            assert j <= i or (b.between(i, j) == ends[i:j]).all()
    ids, back, flat = token_files.from_bytes(token_files.to_bytes(np.array([5]), np.array([2]), np.array([70000, 1])))
    assert (ids.tolist(), back.all().tolist(), flat.tolist()) == ([5], [2], [70000, 1])
    with pytest.raises(ValueError):
        token_files.from_bytes(token_files.to_bytes(np.array([5]), np.array([2]), np.array([7, 1]))[:-1])


def test_packing(spark, docs, empty):
    encode = encode_all()
    total = sum(len(encode(t)) for _, t, _ in ROWS)
    got = packing.pack_documents(spark, docs, size=512, part_pieces=4).collect()
    assert sum(r["length"] for r in got) == total
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 512
    lengths = np.array([r["length"] for r in got])
    assert packing.lower_bound(lengths, 512) <= len(by) <= packing.lower_bound(lengths, 512) + 1
    assert packing.pack_documents(spark, empty).count() == 0


def test_lower_bound_holds():
    rng = np.random.default_rng(5)
    for _ in range(30):
        x = rng.integers(1, 65, 40)
        assert packing.lower_bound(x, 64) <= packing.best_fit_decreasing(x, 64).max() + 1
    assert packing.lower_bound(np.full(7, 40), 64) == 7


def test_word_memory_is_bounded():
    from rankloom.llm import tokens
    texts = [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}q{i}" for i in range(k, k + 50)) for k in range(0, 3000, 40)]
    want = list(tokens.encoder(tokens.vocabulary()).ids(texts))
    few = tokens.encoder(tokens.vocabulary(), 100)
    few.known.clear(), few.known.parts.clear()
    for text, ids in zip(texts, want):
        assert list(few.ids([text])) == [ids] and len(few.known) <= 100 and len(few.known.parts) <= 100
    assert tokens.encoder(tokens.vocabulary()).known.remembered == tokens.REMEMBERED


def test_batches_of_long_texts_are_small(spark):
    import pyarrow as pa

    def size(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes], pa.int64())], names=["n"])

    long = spark.range(0, 120, 1, 1).selectExpr("repeat('x', 400000) AS text")
    assert max(r["n"] for r in long.mapInArrow(size, "n long").collect()) < 17 << 20


def test_maxent(spark, docs, empty):
    got = collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
                              for r in maxent.scored(spark, docs, chunk_bytes=3000).withColumnRenamed("id", "doc_id").collect())
    toks = [(d, WORD.findall((t or "").translate(LOW)) + [None]) for d, t, _ in ROWS]
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in toks}
    c = collections.Counter(w for d, ws in toks if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for d, ws in toks:
        score = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        want[((1 << 63) - 1 if d is None else d, held[d], len(ws), sum(c[w] > 0 for w in ws), n, round(score, 6))] += 1
    assert got == want
    assert maxent.digest(spark, empty).count() == 0


def test_maxent_row_moves_by_the_chunks_that_saw_it(spark):
    shape = (2, maxent.CLASSES)
    rows = []
    for k in range(6):  # row 0 is seen by all, three times as often by the first; row 1 by the first only
        had = np.array([3 if k == 0 else 1, 5 if k == 0 else 0], "<i8")
        change = np.where(had[:, None] > 0, float(k + 1), 0.0) * np.ones(shape)
        rows.append((0, k, bytearray(maxent._squeeze(change.astype("<f2").tobytes())), bytearray(maxent._squeeze(had.tobytes()))))
    got = maxent.average(spark.createDataFrame(rows, maxent._CHANGES), shape)
    assert np.allclose(got[0], (3 + 2 + 3 + 4 + 5 + 6) / 8, atol=0.01) and np.allclose(got[1], 1.0)


def test_maxent_scores_do_not_depend_on_the_layout(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, six = (dict(maxent.scored(spark, maxent_rows, chunk_bytes=40_000).select("id", "score").collect())
                for maxent_rows in (texts.coalesce(1), texts.repartition(6)))
    assert one == six and len(one) == texts.count()


def test_maxent_beats_counts_on_held_out_texts(spark):
    r = queries.op8_maxent(spark, "/root/testdata/sf0.001").filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert r["sum(score)"] > r["sum(base_score)"]


def test_maxent_history_tells_tokens_of_a_class_apart():
    import pyarrow as pa
    t = pa.table({"id": [0], "text": ["left ping right pong " * 20000], "held_out": [False]})
    tokens = maxent.Tokens.opened(pa.table([pa.array([x], pa.binary()) for x in maxent.Tokens.of(t).packed()], names=maxent._PARTS))
    assert tokens.words == [b"left", b"ping", b"right", b"pong", b""] and len(tokens.code) == 80001
    cls, leaf = np.full(5, 7), maxent.leaves(tokens.words)          # all in one class
    weight = np.zeros((maxent.CLASSES, 1 << maxent.DEPTH), np.int64)
    np.add.at(weight, (cls, leaf), np.bincount(tokens.code) + 1)
    trees = maxent.Trees(weight)
    w = np.zeros((1 + maxent.FEATURES * maxent.ROWS + maxent.TREE_ROWS, maxent.CLASSES), np.float32)

    def shares(at):
        """Of all leaves of the class, for the token after this history."""
        every = np.arange(1 << maxent.DEPTH)
        odds, right, salt, column = trees.ways(np.full(len(every), 7), every)
        seen = np.repeat(tokens.history(np.array([at])), len(every), axis=0)
        x = maxent.tree_odds(w[1 + maxent.FEATURES * maxent.ROWS:].ravel(), odds, maxent.tree_places(seen, salt, column)[1])
        return np.exp(-np.logaddexp(0, (1 - 2 * right) * x).sum(axis=0, dtype=np.float64))

    assert np.allclose(shares(5), weight[7] / weight[7].sum(), atol=1e-6)   # by the counts alone
    maxent.descend(w, tokens, cls, leaf, trees, np.arange(len(tokens.code)))
    ping, pong = leaf[1], leaf[3]
    for at, own, other in ((5, ping, pong), (7, pong, ping)):
        p = shares(at)
        assert abs(p.sum() - 1) < 1e-5 and p[own] > 0.6 and p[other] < 0.2


def test_maxent_steps_agree_with_plain_ones():
    """Weights as a broadcast hands them out; steps against sums over all places at once."""
    import pickle

    import pyarrow as pa
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(words[int(300 * x ** 3)] for x in rng.random(n)) for n in (0, 1, 2, 2500, 3000)]
    tokens = maxent.Tokens.of(pa.table({"id": list(range(5)), "text": texts, "held_out": [False] * 5}))
    assert tokens.words[-1] == b"" and tokens.code[:3].tolist() == [len(tokens.words) - 1, 0, len(tokens.words) - 1]
    cls, leaf = np.arange(len(tokens.words)) % maxent.CLASSES, maxent.leaves(tokens.words)
    weight = np.zeros((maxent.CLASSES, 1 << maxent.DEPTH), np.int64)
    np.add.at(weight, (cls, leaf), np.bincount(tokens.code) + 1)
    trees, at = maxent.Trees(weight), np.arange(len(tokens.code))
    low = 1 + maxent.FEATURES * maxent.ROWS
    w = np.zeros((low + maxent.TREE_ROWS, maxent.CLASSES), np.float32)
    w[0] = rng.random(maxent.CLASSES)

    plain, had = w.astype(np.float64), np.zeros(len(w), np.int64)
    seen, (odds, right, salt, column) = np.ones(w.shape), trees.ways(cls, leaf)
    for i in range(0, len(at), maxent.BATCH):
        own = at[i:i + maxent.BATCH]
        code, hashes = tokens.code[own], tokens.history(own)
        rows = (hashes % np.uint64(maxent.ROWS)).astype(np.int64) + 1 + np.arange(maxent.FEATURES) * maxent.ROWS
        x = np.exp(plain[0] + plain[rows].sum(axis=1))
        x /= x.sum(axis=1, keepdims=True)
        x[np.arange(len(own)), cls[code]] -= 1
        total = np.zeros(w.shape)
        for f in range(maxent.FEATURES):
            np.add.at(total, rows[:, f], x)
            np.add.at(had, rows[:, f], 1)
        seen[:low] += (total[:low] ** 2).sum(axis=1, keepdims=True)
        row, place = maxent.tree_places(hashes, salt[:, code], column[:, code])
        np.add.at(had, row + low, 1)
        tree = plain[low:].ravel()
        x = 1 / (1 + np.exp(-odds[:, code] - tree[place].sum(axis=0))) - right[:, code]
        for f in range(maxent.FEATURES):
            np.add.at(total[low:].reshape(-1), place[f], x)
        seen[low:] += total[low:] ** 2
        rate = np.where(np.arange(len(w)) < low, maxent.RATE, maxent.TREE_RATE)[:, None]
        plain -= rate * total / np.sqrt(seen)

    got = pickle.loads(pickle.dumps(w))
    assert np.array_equal(maxent.descend(got, tokens, cls, leaf, trees, at), had)
    assert np.abs(plain - w).max() > 0.1 and np.allclose(got, plain, atol=1e-4)
    # numpy's indexed addition compares types as objects, and is ten times slower with another one
    steps = maxent.TreeSteps(got[low:].reshape(-1), trees, 1)
    assert steps.summed.dtype is np.dtype(np.float32) and steps.seen.dtype is np.dtype(np.float32)


def test_byte_bpe(spark, docs, empty):
    import public_tokenizers
    import tiktoken
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(byte_bpe.vocabulary()), special_tokens={})
    want = []
    for d, t, _ in ROWS:
        ids = enc.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows_of(byte_bpe.digest(spark, docs, chunk_bytes=4000)) == sorted(want, key=repr)
    assert byte_bpe.digest(spark, empty).count() == 0


def test_byte_bpe_splits_once(spark):
    """What is passed on holds the words, so neither asking nor finishing splits texts again."""
    import public_tokenizers
    import regex
    texts = ["the cat saw  the cat", "", "été 12 日本", "the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    (r,) = byte_bpe.pack(docs, 1 << 20).collect()
    want = [regex.findall(public_tokenizers.PATTERN, t) for t in texts]
    words = byte_bpe._split(byte_bpe._swell(bytes(r["words"])))
    assert sorted(words) == sorted({w.encode() for ws in want for w in ws})
    assert [words[c].decode() for c in byte_bpe._unplaned(bytes(r["codes"]))] == [w for ws in want for w in ws]
    assert np.frombuffer(byte_bpe._swell(bytes(r["sizes"])), "<i8").tolist() == [len(ws) for ws in want]
    assert byte_bpe._unplaned(byte_bpe._planed(np.array([0, 300, 70_000, 1 << 25]))).tolist() == [0, 300, 70_000, 1 << 25]


def test_byte_bpe_joins_byte_strings_of_rows():
    import pyarrow as pa
    token = pa.array([b"a", b"", b"\xc3", b"\xa9z"], pa.large_binary())
    ids = pa.array([np.array(x, "<u4").tobytes() for x in ([9], [0, 2, 3], [], [1], [3, 3])], pa.binary()).slice(1)
    assert byte_bpe.joined(token, ids).to_pylist() == [b"a\xc3\xa9z", b"", b"", b"\xa9z\xa9z"]
    assert byte_bpe.joined(token, ids.slice(1, 2)).to_pylist() == [b"", b""] and not len(byte_bpe.joined(token, ids.slice(0, 0)))


def test_byte_bpe_long_words(spark):
    import random
    import public_tokenizers
    import tiktoken
    ranks = byte_bpe.read_ranks(byte_bpe.vocabulary())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    texts = ["a" * 5000, "日本" * 1500, "哈" * 3001, "x" * 256, "y" * 257, "=-" * 900, "".join(rng.choices("abcdefghij", k=9000)),
             "".join(rng.choices("ab", k=5000)) + " and " + "".join(rng.choices(["日", "語", "é", "tion"], k=2000))]
    texts.append("".join(rng.choices(texts[6], k=100_000)) + "abc" * 300_000)  # a word of a million letters
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in byte_bpe.digest(spark, docs, chunk_bytes=20_000).collect()}
    for d, t in enumerate(texts):
        ids = enc.encode_ordinary(t)
        assert got[d] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()), d


def test_byte_bpe_joins_windows():
    import random
    import public_tokenizers
    import tiktoken
    ranks = byte_bpe.read_ranks(byte_bpe.vocabulary())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def own(x):
        return np.array([ranks[p] for p in byte_bpe.merged(x, ranks)], "<u4").tobytes()

    rng = random.Random(3)
    for _ in range(200):
        word = bytes(rng.choices(b"abAB \xe3\x81\x82t", k=rng.randrange(257, 900)))
        got = byte_bpe.long_word(word, own, ranks, byte_bpe.sizes_of(ranks))
        assert np.frombuffer(got, "<u4").tolist() == list(enc._core_bpe.encode_single_piece(word))


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            doubled = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(digits[::-1]))
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                  "card": 12 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def test_pii(docs, empty):
    texts = [t or "" for _, t, _ in ROWS] + ["a@b@c.d e@f.g.h.. @x.y ..@a.b", "1.2.3.4.5.6.7.8 1.2.3 300.1.1.1 1..2.3.4.5", "+1+12345678901 x +(5 + 123 456-789 0",
                                             "4111111111111111 4111-1111 1111-1111- 0000 0000 0000"]
    for t in texts:
        assert [s[:3] for s in pii.find(t) if s[0] in pii.BASE] == plain_spans(t), t
    assert [s[0] for s in pii.find("pay to IBAN GB82 WEST 1234 5698 7654 32 now")] == ["iban"]
    for t in ("pay ES9121000418450200051332 TODAY", "pay ES91 2100 0418 4502 0005 1332 2024", "DE89370400440532013000", "(NO93 8601 1117 947)",
              "GB82 WEST 1234 5698 7654 32 AND NL91ABNA0417164300."):
        found = [t[a:b].replace(" ", "") for k, a, b, _ in pii.find(t) if k == "iban"]
        assert found and all(len(x) == pii.IBAN_LENGTHS[x[:2]] and pii.mod97(x) for x in found), t
    assert len([s for s in pii.find("GB82 WEST 1234 5698 7654 32 AND NL91ABNA0417164300.") if s[0] == "iban"]) == 2
    for t in ("pay ES9121000418450200051333 TODAY", "ES91210004184502000513321", "xES9121000418450200051332", "ES91 21000418450200051332", "ZZ91 2100", "ES91", "ES91 "):
        assert not [s for s in pii.find(t) if s[0] == "iban"], t
    assert not pii.find("by the assn. 123-45-6789") and pii.find("SSNs: 123-45-6789")
    assert not pii.find("code 123-45-6789 here") and pii.find("my ssn: 123-45-6789")
    assert pii.digest(pii.find_pii(empty)).count() == 0 and pii.digest(pii.find_pii(docs)).count() == len(ROWS)
    assert "<EMAIL>" in pii.redacted(ROWS[7][1]) and pii.redact(docs).columns == docs.columns


def test_pipeline(spark):
    import corpus_pipeline
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert len(corpus_pipeline.STAGES) == 5 and got
    by = collections.defaultdict(int)
    for r in got:
        by[r["sequence_id"]] += r["length"]
    assert max(by.values()) <= packing.SEQUENCE
