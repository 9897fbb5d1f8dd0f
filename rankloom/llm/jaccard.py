"""Operator 5: n-gram Jaccard join by adaptive multi-match prefixes.

A text's set holds the hashes of its distinct 5-word shingles. Each document's
shingles are ordered by how many documents have them, rarest first. Two sets
with a Jaccard similarity of t or more share l of the first
``n - ceil(t n) + l`` shingles of each, for every l. A document takes the l whose
prefix is estimated to cost least (postings to read, and candidates that are
left to verify), so documents with frequent shingles get longer prefixes and
more shared prefix shingles are asked of their partners: as many as the smaller
l of the two. What passes is verified on the whole sets.

Components need fewer links than there are pairs, so groups of near copies are
first linked through leaders: each shingle's postings meet one of their
documents, in a few rounds. Then every pair of different
components that shares enough prefix shingles is verified, so no link between
components is missed and copies are never expanded into all their pairs. The
links themselves are to be had from ``links`` and ``link_counts``, which verify
every pair of different shingle sets: as many rows as there are such links.

Nulls and texts without words have an empty set and no link: their component is
their own id. Texts of fewer than 5 words have one shingle. Equal texts (and
repeated rows) stand as one; different texts of one id, or without an id, each
stand for themselves. Null ids count as larger than others. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import keys as kx
from rankloom.llm.common import NO_ID, ascii_lower, configure, id_text, lean, out_id, pieces, raw, stored, text_bytes
from rankloom.llm.components import components
from rankloom.llm.shingles import sets

#: Similarity as a fraction: 4/5.
UP, DOWN = 4, 5
MOST_SHARED = 6
#: Rounds in which documents meet leaders only.
LED = 2
#: UTF-8 bytes of text in a shard.
SHARD_BYTES = 4 << 20
#: Words of the parity bitmaps: a bit says whether an odd number of a set's
#: shingles fall on it, so two sets differ in as many shingles as bits at least.
BITMAP = 8
_BITS = [f"b{k}" for k in range(BITMAP)]
_DOC = "id long, n long, tokens array<long>, prefix int, asked int, " + ", ".join(f"{b} long" for b in _BITS)


def needed(n: np.ndarray) -> np.ndarray:
    """Least overlap of a set of n with any partner."""
    return -(-n * UP // DOWN)


def prefix(df: np.ndarray, n: int) -> tuple[int, int]:
    """(asked, length): how many shared prefix shingles to ask for, and the
    prefix length that goes with it, for ascending counts ``df`` of a set's
    shared shingles; its n - len(df) other ones come first and cost nothing."""
    own = n - len(df)
    base = n - int(needed(np.int64(n))) - own
    reads = np.concatenate(([0], np.cumsum(df)))
    best = (np.inf, 1, base + 1)
    for asked in range(1, min(MOST_SHARED, int(needed(np.int64(n)))) + 1):
        length = min(len(df), base + asked)
        # a candidate costs about as much as reading its n hashes, eight at a time
        cost = reads[length] + (reads[length] - length) / asked * n / 8
        best = min(best, (cost, asked, length))
    return best[1], best[2]


def bitmap(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s >> np.uint64(8)).astype(np.int64) % (64 * BITMAP), minlength=64 * BITMAP) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def document_sets(docs: DataFrame, classes: DataFrame, shards: int) -> DataFrame:
    """A row for each distinct text (id is its node): n, and (where enough of its shingles
    occur elsewhere for any link) those shingles, rarest first, with the prefix
    length among them and how many of it to ask for."""
    buckets = kx.first_cut(shards)

    def own_sets(left, right):
        left, nodes = kx.standing(left, right)
        data, off = raw(ascii_lower(left.column("text").combine_chunks()))
        return nodes.tolist(), sets(data, off)

    def hand_in(key, left: pa.Table, right: pa.Table) -> pa.Table:
        _, own = own_sets(left, right)
        keys = np.concatenate([np.unique(kx.short(s)) for s in own] or [np.zeros(0, np.uint64)])
        return kx.handed_in(key[0].as_py(), *np.unique(keys, return_counts=True), buckets)

    def out(key, left: pa.Table, right: pa.Table) -> pa.Table:
        known, counts = kx.returned(right)
        rows = []
        for d, s in zip(*own_sets(left, right)):
            n, row = len(s), (None,) * (3 + BITMAP)
            if n and len(known):
                k = kx.short(s)
                at = np.minimum(np.searchsorted(known, k), len(known) - 1)
                hit = known[at] == k
                if hit.sum() >= needed(np.int64(n)):
                    bits = bitmap(s).tolist()
                    s, df = s[hit], counts[at[hit]].astype(np.int64)
                    order = np.lexsort((s, df))
                    asked, length = prefix(df[order], n)
                    row = (s[order].view(np.int64), length, asked, *bits)
            rows.append((d, n, *row))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), *[pa.int64()] * BITMAP]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                        names=["id", "n", "tokens", "prefix", "asked", *_BITS])

    left = kx.by_shard(docs, shards)
    mem = kx.members(classes, shards, "node")
    handed = left.groupBy("shard").cogroup(mem.groupBy("shard")).applyInArrow(
        lean(hand_in), kx._HANDED)
    right = mem.unionByName(kx.shared(handed, shards))
    return left.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(lean(out), _DOC)


def links_among(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar enough."""
    a = own.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    b = own.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    both = F.size(F.array_intersect("t_a", "t_b"))
    return (pairs.join(a, "a").join(b, "b")
            .filter(enough(F.col("n_a"), F.col("n_b"), both)).select("a", "b"))


def enough(n_a, n_b, most):
    """Whether sets of these sizes that share at most ``most`` can be similar enough."""
    return (UP + DOWN) * most >= UP * (n_a + n_b)


def with_components(post: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return post.withColumn("c", F.col("id"))
    return post.join(found.withColumnRenamed("component", "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))


def with_links(links, found, pairs: DataFrame, own: DataFrame):
    """Links so far and their components, with the verified pairs added."""
    new = stored(links_among(pairs, own), "links")
    if not new.count():
        return links, found
    links = new if links is None else links.unionByName(new)
    return links, stored(components(links), "components")


def postings(docs: DataFrame, shard_bytes: int):
    """Rows by digest, distinct texts, their sets, those that can have links, and
    the postings of their prefixes."""
    shards = pieces(text_bytes(docs), shard_bytes)
    named, classes = kx.first_copies(docs)
    classes = stored(classes, "classes")
    info = stored(document_sets(docs, classes, shards), "sets")
    own = info.filter("tokens IS NOT NULL")
    # at: the place among the shared shingles, of which there are m
    post = stored(own.select("id", "n", "asked", F.size("tokens").alias("m"),
                             F.posexplode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("at", "token")), "postings")
    return named, classes, info, own, post


def candidates(now: DataFrame, own: DataFrame) -> DataFrame:
    """Pairs (a, b) of postings with different c that share enough prefix shingles."""
    now = now.join(own.select("id", *_BITS), "id")
    a, b = (now.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "m", "asked", "at", "c", *_BITS))) for s in "ab")
    most = F.least("at_a", "at_b") + F.least(F.col("m_a") - F.col("at_a"), F.col("m_b") - F.col("at_b"))
    differ = sum((F.bit_count(F.col(f"{x}_a").bitwiseXOR(F.col(f"{x}_b"))) for x in _BITS[1:]),
                 F.bit_count(F.col("b0_a").bitwiseXOR(F.col("b0_b"))))
    near = (F.col("n_a") + F.col("n_b") - differ) / 2
    return a.join(b, "token").filter((F.col("id_a") < F.col("id_b")) & (F.col("c_a") != F.col("c_b"))
                                     & enough(F.col("n_a"), F.col("n_b"), most) & enough(F.col("n_a"), F.col("n_b"), near)) \
        .groupBy(F.col("id_a").alias("a"), F.col("id_b").alias("b")).agg(F.count("*").alias("shared"), F.first(F.least("asked_a", "asked_b")).alias("asked")) \
        .filter("shared >= asked").select("a", "b")


def groups(spark: SparkSession, docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(id, digest) of every row of (id, text); and for each text its digest, n
    and the first text (rep, digest) of its component, by smallest id."""
    named, classes, info, own, post = postings(docs, shard_bytes)
    links, found = None, None
    for turn in range(LED):
        # shingles whose documents are in different components, each with a leader:
        # first the document with the fewest shingles of its own, then any
        now = with_components(post, found)
        order = F.xxhash64("id", F.lit(turn)) if turn else F.col("n") - F.col("m")
        led = now.groupBy("token").agg(F.min(F.struct(order.alias("order"), "id", "n", "m", "c")).alias("l"),
                                       F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 != c1") \
            .select("token", *(F.col(f"l.{c}").alias(f"{c}_b") for c in ("id", "n", "m", "c")))
        met = now.join(led, "token").filter((F.col("c") != F.col("c_b")) & enough(F.col("n"), F.col("n_b"), F.least("m", "m_b")))
        links, found = with_links(links, found, met.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b")).distinct(), own)
    now = with_components(post, found)
    open_ = now.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 != c1").select("token")
    links, found = with_links(links, found, candidates(now.join(open_, "token"), own), own)
    texts = classes.join(info.select(F.col("id").alias("node"), "n"), "node")
    own = F.struct("rep", "digest")
    if found is None:
        return named, texts.select("digest", "n", own.alias("first"))
    found = found.withColumnRenamed("id", "node")
    heads = found.join(classes, "node").groupBy("component").agg(F.min(own).alias("first"))
    return named, texts.join(found.join(heads, "component").select("node", "first"), "node", "left").select(
        "digest", "n", F.coalesce("first", own).alias("first"))


def join(spark: SparkSession, docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """id, n_shingles and component of every row of (id, text)."""
    named, texts = groups(spark, docs, shard_bytes)
    return named.join(texts, "digest").select(
        "id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first.rep")).otherwise(F.col("id")).alias("component"))


def digest(docs: DataFrame) -> DataFrame:
    spark = configure(docs.sparkSession)
    out = join(spark, id_text(docs))
    return out.select(out_id(), "n_shingles", F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: the one with its smallest id. Texts without
    words are no copies of others, and one row of each id and text stays."""
    spark = configure(docs.sparkSession)
    named, texts = groups(spark, id_text(docs))
    found = named.groupBy("id", "digest").agg(F.count("*").alias("n_rows")).join(texts, "digest")
    found = stored(found.filter((F.col("n") == 0) | (F.struct("id", "digest") == F.struct("first.rep", "first.digest")))
                   .select("id", "digest", "n_rows"), "first")
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"),
                       F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("id"),
                       kx.digest_of(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("digest"))
    once, more = (rows.join(found.filter(only), ["id", "digest"], "left_semi") for only in ("n_rows = 1", "n_rows > 1"))
    return once.select("row.*").unionByName(more.dropDuplicates(["id", "digest"]).select("row.*"))


def linked_sets(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(digest, set, n_docs, first): each distinct text's shingle set, how many
    documents (rows of different id or text) have that set, and the first; and the verified pairs (a, b) of different sets."""
    named, classes, _, own, post = postings(docs, shard_bytes)
    # equal sets share all their shingles, so those that are wholly shared are compared
    same = F.when(F.size("tokens") == F.col("n"), F.md5(F.array_join(F.col("tokens").cast("array<string>"), ",").cast("binary")))
    keyed = own.select("id", F.coalesce(same, F.col("id").cast("string")).alias("key"))
    firsts = stored(keyed.groupBy("key").agg(F.min("id").alias("set")), "sets")
    of = stored(keyed.join(firsts, "key").select(F.col("id").alias("node"), "set"), "sets")
    alone = firsts.select(F.col("set").alias("id"))
    own, post = own.join(alone, "id", "left_semi"), post.join(alone, "id", "left_semi")
    pairs = stored(links_among(candidates(post.withColumn("c", F.col("id")), own), own), "links")
    texts = classes.join(of, "node", "left").withColumn("set", F.coalesce("set", "node")).select("digest", "set")
    size = named.distinct().join(texts, "digest").groupBy("set").agg(F.count("*").alias("n_docs"), F.min(F.struct("id", "digest")).alias("first"))
    return stored(texts.join(size, "set"), "texts"), pairs


def links(docs: DataFrame) -> DataFrame:
    """A row for each pair of different shingle sets that are similar enough: the
    first document of each, by smallest id, with its text's md5, and how many
    documents have the set."""
    configure(docs.sparkSession)
    texts, pairs = linked_sets(id_text(docs))
    sets_ = texts.select("set", "first", "n_docs").dropDuplicates(["set"])
    for s in "ab":
        pairs = pairs.join(sets_.select(F.col("set").alias(s), F.col("first").alias(f"first_{s}"), F.col("n_docs").alias(f"n_docs_{s}")), s)
    return pairs.select(*(c for s in "ab" for c in (
        F.when(F.col(f"first_{s}.id") != NO_ID, F.col(f"first_{s}.id")).alias(f"doc_id_{s}"),
        F.lower(F.hex(f"first_{s}.digest")).alias(f"md5_{s}"), f"n_docs_{s}")))


def link_counts(docs: DataFrame) -> DataFrame:
    """doc_id, md5 of the text, and n_links of every row: the other documents whose
    sets are similar enough. Documents without words have none."""
    configure(docs.sparkSession)
    found = id_text(docs)
    worded = found.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    texts, pairs = linked_sets(worded)
    size = texts.select("set", "n_docs").dropDuplicates(["set"])
    both = pairs.select(F.col("a").alias("own"), F.col("b").alias("set")).unionByName(pairs.select(F.col("b").alias("own"), F.col("a").alias("set")))
    more = both.join(size, "set").groupBy("own").agg(F.sum("n_docs").alias("more")).withColumnRenamed("own", "set")
    counts = texts.join(more, "set", "left").select("digest", (F.col("n_docs") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    rows = found.select("id", kx.digest_of(F.col("text")).alias("digest"))
    return rows.join(counts, "digest", "left").select(out_id(), F.lower(F.hex("digest")).alias("md5"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
