"""The operators as registered queries over whole tables, and DuckDB SQL for
those that SQL can express."""

from __future__ import annotations

from rankloom.llm import byte_bpe, centroids, jaccard, lz, maxent, packing, pii, piece_bpe, prefix_trie, quality, suffix_dedup, token_files, urls
from rankloom.llm.common import table


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op2_quality_cascade(spark, sf_dir):
    return quality.digest(quality.judge(table(spark, sf_dir, "documents")))


def op3_lz_fingerprint(spark, sf_dir):
    return lz.digest(table(spark, sf_dir, "documents"))


def op4_url_cascade(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


def op5_jaccard_join(spark, sf_dir):
    return jaccard.digest(table(spark, sf_dir, "documents"))


def op6_token_files(spark, sf_dir):
    return token_files.digest(token_files.round_trip(spark, table(spark, sf_dir, "documents")))


def op7_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"))


def op8_maxent(spark, sf_dir):
    return maxent.digest(spark, table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark, sf_dir):
    return byte_bpe.digest(spark, table(spark, sf_dir, "documents"))


def op10_pii(spark, sf_dir):
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op11_centroids(spark, sf_dir):
    return centroids.digest(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_piece_bpe(spark, sf_dir):
    return piece_bpe.digest(piece_bpe.decode(piece_bpe.encode(table(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_quality_cascade, op3_lz_fingerprint, op4_url_cascade, op5_jaccard_join, op6_token_files, op7_best_fit_packing, op8_maxent, op9_byte_bpe, op10_pii,
                                   op11_centroids, op12_prefix_trie, op13_piece_bpe)}

_WORD = r"[^\x20\x09-\x0D]+"
#: One round of clustering, from centroids c<i> (c, v) to c<i + 1>.
_NEAREST = """(select id, v, arg_min(c, (d, c)) as c, min(d) as d from (select k.id, k.v, m.c,
  list_sum(list_transform(list_zip(k.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from k, c{i} m) group by id, v)"""
_ROUND = """a{i} as (select c, list(s order by i) as s, min(n) as n from (select c, i, sum(x) as s, count(*) as n
  from (select c, unnest(v) as x, generate_subscripts(v, 1) as i from {nearest}) group by c, i) group by c),
c{j} as materialized (select c{i}.c, coalesce(list_transform(s, lambda x: cast((x - (x % n + n) % n) / n as bigint)), c{i}.v) as v from c{i} left join a{i} using (c))"""
_ROUNDS = ",\n".join(_ROUND.format(i=i, j=i + 1, nearest=_NEAREST.format(i=i)) for i in range(3))
#: Unsigned crc32 of an ASCII text, bit by bit.
_CRC32 = """xor(list_reduce(list_transform(string_split(cast({x} as varchar), ''), lambda ch: cast(ascii(ch) as bigint)),
  lambda a, b: list_reduce(range(8), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)), xor(a, b)), 4294967295), 4294967295)"""
ORACLES = {
    "op11_centroids": f"""
with k as materialized (select vec_id as id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as materialized (select row_number() over (order by h, v) - 1 as c, v from
  (select sha256('1:' || id) as h, v from k where id is not null order by h, v limit 16)),
{_ROUNDS},
f as (select * from {_NEAREST.format(i=3)}),
t as (select c, cast(sum(d) as bigint) as s from f group by c)
select f.id as vec_id, cast(f.c as integer) as cluster, cast(d as bigint) as distance, s as cluster_inertia,
  cast((select sum(s) from t) as bigint) as inertia, sha256(array_to_string(c3.v, ',')) as centroid_sha256
from f join t using (c) join c3 using (c)""",
    "op12_prefix_trie": f"""
with t as (select conv_id as c, {{'r': coalesce(role, ''), 'x': coalesce(text, '')}} as w, row_number() over (partition by conv_id order by turn nulls first,
    md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) as p from conversations where conv_id is not null),
own as (select c, c - c % 100 as b, {_CRC32.format(x="c")} % 6 as h, list(w order by p) as l from t group by c),
reb as (select o.c, list_concat(coalesce(list_slice(b.l, 1, o.h), []), list_slice(o.l, o.h + 1, len(o.l))) as s from own o left join own b on b.c = o.b),
pre as (select c, d, list_slice(s, 1, d) as k, d = len(s) as here from (select c, s, unnest(range(0, len(s) + 1)) as d from reb)),
node as materialized (select k, d, min(c) as conv_id, count(*) as n_convs, list(c order by c) filter (where here) as ends from pre group by k, d),
kids as (select list_slice(k, 1, d - 1) as k, count(*) as n from node where d > 0 group by 1),
val as (select node.k, node.d, coalesce(kids.n, 0) as n_children, coalesce((n_convs - 1) * length(node.k[-1].x), 0) as saved
  from node left join kids on kids.k = node.k and node.d = len(kids.k)),
sums as (select a as k, count(*) filter (where n_children = 0) as n_leaves, cast(sum(saved) as bigint) as saved_tokens
  from (select list_slice(k, 1, unnest(range(0, d + 1))) as a, n_children, saved from val) group by a)
select node.conv_id, cast(node.d as bigint) as depth, up.conv_id as parent_conv_id, node.n_convs, val.n_children, n_leaves, saved_tokens,
  sha256(coalesce(array_to_string(node.ends, ','), '')) as ends_sha256
from node join val using (k) join sums using (k) left join node up on up.d = node.d - 1 and up.k = list_slice(node.k, 1, node.d - 1)""",
    "op2_quality_cascade": rf"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, unnest(ws) as w, generate_subscripts(ws, 1) as i from (select r, regexp_extract_all(text, '{_WORD}') as ws from t)),
win as (select r, i, w || chr(31) || lead(w, 1) over o || chr(31) || lead(w, 2) over o || chr(31) || lead(w, 3) over o || chr(31) || lead(w, 4) over o as g
  from w window o as (partition by r order by i)),
again as (select r, i from (select r, i, count(*) over (partition by r, g) as n from win where g is not null) where n > 1),
rep as (select r, count(distinct j) as n_repeat_words from (select r, i + unnest([0, 1, 2, 3, 4]) as j from again) group by r),
li as (select r, l from (select r, unnest(string_split(text, chr(10))) as l from t) where regexp_matches(l, '{_WORD}')),
lines as (select r, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines from li group by r),
f as (select doc_id, len(regexp_extract_all(text, '{_WORD}'))::bigint as n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
  coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
  coalesce(n_lines, 0) as n_lines, length(regexp_replace(text, '[\x00-@\[-`{{-\x7F]', '', 'g')) as n_letters
  from t left join rep using (r) left join lines using (r)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or word_chars > 15 * n_words or word_chars < 2 * n_words or 5 * n_symbols > n_words
       or 2 * n_dup_lines > n_lines or 10 * n_letters < 5 * word_chars) as kept from b""",
    "op4_url_cascade": r"""
with u as (select page_id, coalesce(url, '') as u, instr(coalesce(url, ''), '://') as k from pages),
p as (select page_id, case when k = 0 then '' else regexp_extract(substr(u, k + 3), '^([^/?#]*)([^?#]*)', 1) end as h0,
  case when k = 0 then '' else regexp_extract(substr(u, k + 3), '^([^/?#]*)([^?#]*)', 2) end as path from u),
h as (select page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from p),
x as (select *, '.' || host as dotted from h),
r as (select page_id, host, path, case
  when ends_with(dotted, '.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
  when ends_with(dotted, '.example.org') and starts_with(path, '/es/') then 'example.org/es/'
  when ends_with(dotted, '.com') and starts_with(path, '/fr/') then 'com/fr/'
  when ends_with(dotted, '.com') and starts_with(path, '/de/') then 'com/de/'
  when ends_with(dotted, '.org') and starts_with(path, '/') then 'org/' end as rule from x)
select page_id, host, path, rule,
  case when rule in ('example.org/en/1', 'example.org/es/', 'com/de/') then 'block' else 'allow' end as verdict from r""",
}
