"""Centroid clustering, conversation tries and SentencePiece ids against plain
versions, on small tables with nulls, ties, repeats and extra columns."""

import array
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from rankloom.llm import centroids, piece_bpe, prefix_trie


def test_piece_bpe(spark):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.vocabulary())
    rng = random.Random(2)
    texts = [None, "", " ", "  two  blanks ", "\n\tx", "▁a▁", "é日本 ünï ß\x00", "ab " * 4000, " " * 1000, "".join(rng.choice("abcxyz") for _ in range(40_000))]
    texts += ["".join(rng.choice("etaoin shr\n▁") for _ in range(60)) for _ in range(200)]
    rows = [(i if i % 7 else None, t, i) for i, t in enumerate(texts)] + [(1, "again", 0), (1, "again", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long").repartition(3)
    back = piece_bpe.decode(piece_bpe.encode(docs))
    got = collections.Counter((r["doc_id"], tuple(r["ids"]), r["text"]) for r in back.collect())
    want = collections.Counter((d, tuple(lib.encode(t or "")), lib.decode(lib.encode(t or ""))) for d, t, _ in rows)
    assert got == want
    sums = collections.Counter(tuple(r) for r in piece_bpe.digest(back).collect())
    assert sums == collections.Counter((d, len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
                                       for (d, i, t), n in want.items() for _ in range(n))
    assert piece_bpe.digest(piece_bpe.decode(piece_bpe.encode(docs.limit(0)))).count() == 0


def test_piece_bpe_random_strings_and_ids():
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.vocabulary())
    pieces = piece_bpe.Pieces(piece_bpe.vocabulary())
    assert pieces.blanks_first and all(pieces.edges_of(i) for i in pieces.id.values())
    rng = random.Random(11)
    for k in range(6000):
        if k % 3 == 0:
            s = "".join(rng.choice(pieces.text) for _ in range(rng.randint(0, 12)))
        elif k % 3 == 1:
            s = "".join(chr(rng.choice([rng.randint(1, 0x24f), rng.randint(0x3040, 0x9fff), rng.randint(0x10000, 0x10ffff)])) for _ in range(rng.randint(0, 30)))
        else:
            s = " " * rng.randint(0, 40) + rng.choice(["", "a", "hello "]) + "▁" * rng.randint(0, 40)
        assert list(array.array("i", pieces.ids(s))) == lib.encode(s)
        ids = [rng.randrange(300 if rng.random() < .5 else 32000) for _ in range(rng.randint(0, 9))]
        assert pieces.decode(ids) == lib.decode(ids)
    table = pieces.last_tokens("▁token")
    assert [pieces.text[i] for i in table] == ["▁"] + [lib.id_to_piece(lib.encode("token"[:n])[-1]) for n in range(1, 6)]


def plain_clusters(rows, k, rounds, dim):
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e in rows
            if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cs = [v for _, v in first]
    if not cs:
        return []
    for r in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs)) for _, v in kept]
        if r == rounds:
            return [(i, j, d) for (i, _), (d, j) in zip(kept, near)], cs
        for j in range(len(cs)):
            own = [v for (_, v), (_, at) in zip(kept, near) if at == j]
            if own:
                cs[j] = [sum(x) // len(own) for x in zip(*own)]


def test_clusters(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(i % 5, 1) * 3 for _ in range(4)]) for i in range(300)]
    rows += [(5, [0.5, -0.5, 1.0, -1.0])] * 3 + [(None, [9.0, 9.0, 9.0, 9.0]), (400, None), (401, [1.0]), (402, [1.0, None, 1.0, 1.0]),
                                                 (403, [float("nan"), 1.0, 1.0, 1.0]), (404, [float("-inf"), 1.0, 1.0, 1.0]), (405, [1e6, -1e6, 2e6, 0.0])]
    df = spark.createDataFrame([(i, e, 7, "x") for i, e in rows], "vec_id long, embedding array<double>, v int, p string").repartition(3)
    for k, rounds in ((16, 3), (3, 2), (1, 0)):
        got, cs = centroids.cluster(df, k, rounds, 4)
        want, plain = plain_clusters(rows, k, rounds, 4)
        assert cs.tolist() == plain
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    same = spark.createDataFrame([(i, [1.0] * 64) for i in range(5)], "vec_id long, embedding array<float>")
    one = centroids.digest(same).collect()
    assert [(r["cluster"], r["distance"], r["inertia"]) for r in one] == [(0, 0, 0)] * 5
    assert centroids.digest(same.limit(0)).count() == 0
    assert centroids.digest(same.withColumn("vec_id", same.vec_id * None)).count() == 0
    with pytest.raises(Exception, match="component beyond"):
        centroids.digest(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).collect()


def test_pivots_spare_exact_distances():
    rng = np.random.default_rng(0)
    v = (rng.integers(0, 16, 2000)[:, None] * 1000 + rng.integers(-20, 20, (2000, 8))).astype(np.int64)
    cs = np.stack([np.full(8, 1000 * c) for c in range(16)]).astype(np.int64)
    p = np.sqrt(((v[:, None] - cs[None]) ** 2).sum(2)).astype(np.float32).astype(float)
    at, best, exact = centroids.nearest(v, p, cs, centroids._pivot_distances(cs, cs))
    d = ((v[:, None] - cs[None]) ** 2).sum(2)
    assert (at == d.argmin(1)).all() and (best == d.min(1)).all() and exact < 2.1 * len(v)


def plain_trie(rows):
    conv = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            conv[c].append((t is not None, t or 0, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest(), (r, x)))
    own = {c: [a[3] for a in sorted(v)] for c, v in conv.items()}
    whole = {c: own.get(c - int(math.fmod(c, 100)), [])[:zlib.crc32(str(c).encode()) % 6] + own[c][zlib.crc32(str(c).encode()) % 6:] for c in own}
    members, children, out = collections.defaultdict(list), collections.defaultdict(list), []
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
        ends = ",".join(str(c) for c in members[k] if len(whole[c]) == len(k))
        out.append((members[k][0], len(k), members[k[:-1]][0] if k else None, len(members[k]), len(children[k]), leaves[k], saved[k],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_trie(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(c, t if rng.random() < .9 else None, rng.choice(["u", "a", None]), rng.choice(["x", "yé", "zz", None]))
            for c in range(300) for t in range(rng.choice([0, 1, 2, 7, 9]))]
    rows += [(7000, t, "u", str(t % 3)) for t in range(200)] + [(7001, t, "u" if t < 150 else "b", str(t % 3)) for t in range(200)]
    rows += [(None, 1, "a", "b"), (-5, 1, "a", "b"), (-105, 0, "a", "c"), (911, 0, "only", "turn"), (912, 0, "only", "turn")] + rows[:20]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "conv_id long, turn long, role string, text string, depth int, node string")
    monkeypatch.setattr(prefix_trie, "LISTED", 3)
    for nodes in (4096, 6):
        assert sorted(map(tuple, prefix_trie.trie(df.repartition(3), nodes).collect()), key=repr) == plain_trie(rows)
    assert prefix_trie.trie(df.limit(0)).count() == 0
    assert prefix_trie.trie(df.filter("conv_id is null")).count() == 0
    lone = spark.createDataFrame([(101, 0, "a", "b")], "conv_id long, turn long, role string, text string")
    assert list(map(tuple, prefix_trie.trie(lone).collect())) == plain_trie([(101, 0, "a", "b")])


def test_decomposition_of_odd_forests():
    rng = np.random.default_rng(5)
    for shape in ("chain", "star", "random", "two tops"):
        n = 400
        up = {"chain": np.arange(n) - 1, "star": np.full(n, 0), "random": np.array([rng.integers(0, max(i, 1)) for i in range(n)]),
              "two tops": np.arange(n) - 2}[shape]
        is_top = np.arange(n) < (2 if shape == "two tops" else 1)
        depth = np.zeros(n, np.int64)
        for i in np.flatnonzero(~is_top):
            depth[i] = depth[up[i]] + 1
        values = rng.integers(0, 9, (n, 2))
        size, sums = np.ones(n, np.int64), values.copy()
        for i in np.flatnonzero(~is_top)[::-1]:
            size[up[i]] += size[i]
            sums[up[i]] += sums[i]
        node = rng.permutation(n).astype(np.int64)
        top = np.array([0 if shape != "two tops" else i % 2 for i in range(n)])
        deal = rng.permutation(n)
        parent = np.where(is_top, -1, node[np.maximum(up, 0)])
        got = prefix_trie._decomposed(node[deal], depth[deal], parent[deal], size[deal], node[top][deal], np.zeros(n, np.int64), values[deal], np.zeros((n, 2), np.int64))
        assert (got == sums[deal]).all(), shape


def test_piece_bpe_cuts_parts_where_no_piece_crosses():
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.vocabulary())
    pieces = piece_bpe.Pieces(piece_bpe.vocabulary())
    text = "threesti threesti, threesti.\nthreesti### (threesti) threesti\tthreesti; ▁threesti'x 12threesti3 #\n"
    assert list(array.array("i", pieces.ids(text))) == lib.encode(text)
    # a word isn't taken anew for each sign that stands beside it
    assert sum("threesti" in part for part in pieces.known) <= 3
    rng = random.Random(5)
    for _ in range(3000):
        s = "".join(rng.choice(["the", "é", "ß", "日", "本", "1", "20", " ", "\n", ".", ",", "'", "’", "-", "(", "###", "▁", "a", "\U0001f600", "s"]) for _ in range(rng.randint(1, 14)))
        assert list(array.array("i", pieces.ids(s))) == lib.encode(s)
    own = piece_bpe.parts_of(["a", "b", "ab", "a-", "-.", "▁(", ".", "!"])
    assert own("▁(a-.b!!▁▁b!") == ["▁(", "a-.b", "!!", "▁▁b", "!"]
    assert piece_bpe.parts_of(["1", "▁"])("▁1▁") == ["▁1", "▁"]
