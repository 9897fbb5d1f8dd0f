"""DuckDB oracle SQL for every registered query.

Each oracle restates the rule from its definition in plain SQL (list
lambdas, unnest, window functions, recursive CTEs) rather than mirroring the
Spark expression tree. Tables are the pre-registered parquet views.
"""

from __future__ import annotations

# ---------------------------------------------------------------- fixtures
F1 = """
p as (select l_orderkey, l_partkey, max(l_extendedprice) px, max(l_quantity) q
      from lineitem group by l_orderkey, l_partkey),
g as (select l_orderkey,
        string_agg(cast(l_partkey as varchar), ', ' order by px desc, l_partkey) gold,
        string_agg(cast(l_partkey as varchar), ', ' order by q desc, l_partkey)
          filter (where q >= 10) pred
      from p group by l_orderkey),
f1 as (select o_orderpriority run, l_orderkey ex_id,
  case when l_orderkey % 10 = 3 then 'no json here'
       when l_orderkey % 10 = 4 then concat('so "ranked_tables": [', gold, '] is final')
       when l_orderkey % 10 = 5 then concat('{"ranked_tables": [', gold, ', "x1"]}')
       when l_orderkey % 10 = 6 then concat('{"ranked_tables": [0]} then {"x":1} then {"ranked_tables": [', gold, ']}')
       when l_orderkey % 10 = 7 then concat('{"ranked_tables": [', coalesce(pred,''), '], "meta": {"a": 1}}')
       else concat('think... {"ranked_tables": [', coalesce(pred,''), ']}') end predict,
  case when l_orderkey % 50 = 1 then 'unlabelled'
       else concat('{"ranked_tables": [', gold, ']}') end label
  from g join orders on o_orderkey = l_orderkey)
"""

PAIRS = """
pr as (select u.conv_id, u.turn, u.conv_id*16+u.turn k, u.text prompt, a.text th
       from conversations u join conversations a on a.conv_id=u.conv_id and a.turn=u.turn+1
       where u.role='user' and a.role='assistant')
"""

F2 = PAIRS + """,
r2 as (select *, concat_ws(', ', """ + ",".join(
    f"cast(((1+turn%6)*{i}+conv_id)%7+1 as varchar)" for i in range(7)) + """) lst from pr),
f2 as (select k pos,
  concat('c', cast(conv_id as varchar), '-',
         cast(case when turn>=3 and k%3=0 then turn-2 else turn end as varchar)) qid,
  case when k%5=0 then null else concat('ds', cast(k%3 as varchar)) end dataset,
  concat('  ', prompt, chr(10)) prompt,
  case when k%17=3 then null when k%4=1 then concat(' ', chr(10)) else th end thinking,
  case when k%11=0 then 'no json' when k%13=2 then '{"ranked_tables": []}'
       when k%19=4 then '{"ranked_tables": [1,2]} and {"x": 2}'
       when k%23=5 then '{"answer": [1]}'
       when k%7=6 then concat(chr(10), '{"ranked_tables": [', lst, '], "note": "ok"}')
       else concat(chr(10), chr(10), '{"ranked_tables": [', lst, ']}') end answer
  from r2)
"""

F3 = """
b3 as (select concat('c', cast(conv_id as varchar), '-', cast(turn as varchar)) qid, k, th from pr),
f3 as (select qid, case when k%3=0 then 'train' when k%3=1 then 'dev' else 'test' end split,
         case when k%2=0 then concat(' ', th) else '' end reasoning_text,
         case when k%9=0 then null else concat(th, ' (total)') end total_thinking
       from b3 where k%6<>5
       union all select qid, 'test', '', '' from b3 where k%5=0 and k%3<>2)
"""

F4 = """
f4 as (select doc_id pos, octet_length(encode(text)) + 1 rec_bytes, lang from documents)
"""

F5 = """
f5 as (select user_id run_id,
         cast(row_number() over (partition by user_id order by ts, event_id) as integer) step,
         case when event_type='error' then null else value end loss, ts from events)
"""

# ---------------------------------------------------------------- text rules
# Python's str.isspace() set, as RE2 class and as trim characters.
_WS_CODES = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
             *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WS_RE = "[" + "".join(f"\\x{{{c:X}}}" for c in _WS_CODES) + "]"
WS_CHARS = "concat(" + ", ".join(f"chr({c})" for c in _WS_CODES) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {WS_CHARS})"


# int() skips the isspace() set except U+001C..U+001F
INT_WS_RE = "[" + "".join(f"\\x{{{c:X}}}" for c in _WS_CODES if not 0x1C <= c <= 0x1F) + "]"


def int_text(v: str) -> str:
    """Python str(int(v)) for a VARCHAR v, NULL when int() would fail."""
    pat = f"^{INT_WS_RE}*[+-]?[0-9]+(_[0-9]+)*{INT_WS_RE}*$"
    digits = f"regexp_replace(regexp_extract({v}, '[0-9][0-9_]*'), '_', '', 'g')"
    mag = f"coalesce(nullif(ltrim({digits}, '0'), ''), '0')"
    neg = f"(regexp_extract({v}, '^{INT_WS_RE}*([+-]?)', 1) = '-')"
    return (f"(case when regexp_matches({v}, '{pat}') then "
            f"(case when {neg} and {mag} <> '0' then '-' || {mag} else {mag} end) end)")


def elem_int(e: str) -> str:
    t = f"json_type({e})"
    return (f"(case when {t} in ('UBIGINT','BIGINT') then cast({e} as varchar) "
            f"when {t} = 'DOUBLE' then cast(cast(trunc(cast({e} as double)) as hugeint) as varchar) "
            f"when {t} = 'BOOLEAN' then (case when cast({e} as boolean) then '1' else '0' end) "
            f"when {t} = 'VARCHAR' then {int_text(e + chr(32) + '->>' + chr(39) + '$' + chr(39))} end)")


def elem_str(e: str) -> str:
    t = f"json_type({e})"
    return (f"(case when {t} = 'VARCHAR' then {strip(e + ' ->> ' + chr(39) + '$' + chr(39))} "
            f"when {t} in ('UBIGINT','BIGINT') then cast({e} as varchar) "
            f"when {t} = 'DOUBLE' then cast(cast({e} as double) as varchar) "
            f"when {t} = 'BOOLEAN' then (case when cast({e} as boolean) then 'True' else 'False' end) "
            f"when {t} = 'NULL' then 'None' else cast({e} as varchar) end)")


def ranking(t: str) -> str:
    """struct(ids varchar[], numeric boolean) parsed from text t, or NULL."""
    blocks = (f"list_filter(regexp_extract_all({t}, '(?s)\\{{.*?\\}}'), lambda b: case when json_valid(b) "
              f"then coalesce(json_type(b, '$.ranked_tables') = 'ARRAY' "
              f"and json_array_length(b, '$.ranked_tables') > 0, false) else false end)")
    elems = f"json_extract(({blocks})[-1], '$.ranked_tables[*]')"
    bare = (f"list_transform(list_filter(string_split(regexp_extract({t}, "
            f"'(?s)\"ranked_tables\"{WS_RE}*:{WS_RE}*\\[([^\\]]*)\\]', 1), ','), "
            f"lambda p: {strip('p')} <> ''), lambda p: trim({strip('p')}, '\"' || chr(39)))")
    blk_num = f"list_bool_and(list_transform({elems}, lambda e: {elem_int('e')} is not null))"
    bare_num = f"list_bool_and(list_transform({bare}, lambda x: {int_text('x')} is not null))"
    return (f"(case when {t} is null then null "
            f"when len({blocks}) > 0 then struct_pack(ids := case when {blk_num} "
            f"then list_transform({elems}, lambda e: {elem_int('e')}) "
            f"else list_transform({elems}, lambda e: {elem_str('e')}) end, numeric := {blk_num}) "
            f"when len({bare}) > 0 then struct_pack(ids := case when {bare_num} "
            f"then list_transform({bare}, lambda x: {int_text('x')}) "
            f"else list_transform({bare}, lambda x: {strip('x')}) end, numeric := {bare_num}) "
            f"end)")


def ids_json(r: str) -> str:
    """json.dumps text of a ranking struct."""
    return (f"(case when {r} is null then null when {r}.numeric then "
            f"'[' || array_to_string({r}.ids, ', ') || ']' else "
            f"'[' || array_to_string(list_transform({r}.ids, lambda x: cast(to_json(x) as varchar)), ', ') "
            f"|| ']' end)")


def round4(x: str) -> str:
    return f"(round_even(cast({x} as double) * 10000.0, 0) / 10000.0)"


# ---------------------------------------------------------------- scoring
SCORED_BODY = """
shared as (  -- gold ids (gold order, duplicates kept) that occur in pred
  select ex_id, gi, x from (
    select ex_id, unnest(g.ids) x, generate_subscripts(g.ids, 1) gi, p, g from parsed
    where p is not null and g is not null and p.numeric = g.numeric) s
  where list_contains(p.ids, x)),
ranked as (
  select s.ex_id, s.gi, pr2.p_rank, gr.g_rank from shared s
  join (select ex_id, x, max(i) g_rank from (select ex_id, unnest(g.ids) x,
        generate_subscripts(g.ids, 1) i from parsed where g is not null) group by ex_id, x) gr
    on gr.ex_id = s.ex_id and gr.x = s.x
  join (select ex_id, x, max(i) p_rank from (select ex_id, unnest(p.ids) x,
        generate_subscripts(p.ids, 1) i from parsed where p is not null) group by ex_id, x) pr2
    on pr2.ex_id = s.ex_id and pr2.x = s.x),
pairs as (
  select a.ex_id, count(*) filter (where sign(a.g_rank - b.g_rank) * sign(a.p_rank - b.p_rank) > 0) c,
         count(*) filter (where sign(a.g_rank - b.g_rank) * sign(a.p_rank - b.p_rank) < 0) d
  from ranked a join ranked b on a.ex_id = b.ex_id and a.gi < b.gi group by a.ex_id),
nshared as (select ex_id, count(*) n from shared group by ex_id),
scored as (
  select parsed.run, parsed.ex_id, p, g, g is null skip,
    case when g is not null then p is null end invalid,
    case when g is null then null when p is null then 0
         when p.numeric = g.numeric and p.ids = g.ids then 1 else 0 end em,
    case when g is null then null when p is null then 0
         when p.numeric = g.numeric and list_sort(list_distinct(p.ids)) = list_sort(list_distinct(g.ids))
         then 1 else 0 end relaxed_em,
    case when g is null then null when p is null then 0.0
         when len(list_distinct(p.ids)) = 0 and len(list_distinct(g.ids)) = 0 then 1.0
         when len(list_distinct(p.ids)) = 0 or len(list_distinct(g.ids)) = 0 then 0.0
         when p.numeric <> g.numeric or len(list_intersect(p.ids, g.ids)) = 0 then 0.0
         else 2.0 * (len(list_intersect(p.ids, g.ids)) / len(list_distinct(p.ids)))
                  * (len(list_intersect(p.ids, g.ids)) / len(list_distinct(g.ids)))
              / ((len(list_intersect(p.ids, g.ids)) / len(list_distinct(p.ids)))
                 + (len(list_intersect(p.ids, g.ids)) / len(list_distinct(g.ids)))) end f1,
    case when g is null then null when p is null then 0
         when len(p.ids) > 0 and len(g.ids) > 0 and p.numeric = g.numeric and p.ids[1] = g.ids[1]
         then 1 else 0 end top1,
    case when g is not null and p is not null and coalesce(nshared.n, 0) >= 2
              and pairs.c + pairs.d > 0
         then (pairs.c - pairs.d) / (pairs.c + pairs.d) end tau
  from parsed left join pairs on pairs.ex_id = parsed.ex_id
  left join nshared on nshared.ex_id = parsed.ex_id)
"""

SCORED = (f"parsed as (select run, ex_id, {ranking('predict')} p, {ranking('label')} g from f1),\n"
          + SCORED_BODY)


def metrics_select(by: str) -> str:
    """AGG5-7 over ``scored`` grouped by ``by`` (a select list prefix)."""
    n = "count(*) filter (where not skip)"

    def mean(expr, d=n):
        return f"case when {d} > 0 then {round4(f'{expr} / {d}')} end"
    return f"""
select {by}
  {n} n_total,
  count(*) filter (where not skip and invalid) n_invalid,
  count(*) filter (where not skip and em = 0) n_wrong_em,
  count(*) filter (where not skip and relaxed_em = 0) n_wrong_set,
  {mean('sum(em)')} "EM",
  {mean('sum(relaxed_em)')} "RelaxedEM",
  {mean('sum(f1)')} "F1",
  {mean('sum(top1)')} "Top1",
  {mean('sum(tau)', 'count(tau)')} "KendallTau",
  {mean('count(*) filter (where not skip and invalid)')} invalid_rate,
  count(tau) n_tau,
  case when {n} = 0 then 'no scorable rows (no parseable gold)' end note
from scored"""


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(c.strip() for c in ctes) + "\n"


# ---------------------------------------------------------------- curation
def _present(c: str) -> str:
    return f"({c} is not null and {strip(c)} <> '')"


GREEDY = "regexp_extract(answer, '(?s)\\{.*\\}')"
ANSWER_OK = (f"(case when json_valid({GREEDY}) then coalesce(json_type({GREEDY}, '$.ranked_tables') = 'ARRAY' "
             f"and json_array_length({GREEDY}, '$.ranked_tables') > 0, false) else false end)")

LATEST = f"""
latest as (select qid, split, reasoning_text, total_thinking,
    coalesce(nullif({strip('reasoning_text')}, ''), nullif({strip('total_thinking')}, '')) recovered
  from (select *, row_number() over (partition by qid order by
          case split when 'train' then 0 when 'dev' then 1 else 2 end desc) rn
        from f3 where split in ('train','dev','test')) where rn = 1)
"""

ROWS = f"""
rows as (select f2.*, (thinking is not null and {strip('thinking')} = '') needs_recovery,
    (thinking is not null and {strip('thinking')} = '') and latest.recovered is not null recovered,
    case when (thinking is not null and {strip('thinking')} = '') and latest.recovered is not null
         then latest.recovered else thinking end thinking_final
  from f2 left join latest on latest.qid = f2.qid),
judged as (select *, ({_present('qid')} and {_present('prompt')} and {_present('thinking_final')}
    and {_present('answer')} and {ANSWER_OK}) valid from rows),
ranked as (select *, case when valid then row_number() over (partition by qid, valid order by pos) end rk
  from judged),
outcomes as (select pos, qid, recovered,
    case when not valid then 'invalid' when rk = 1 then 'kept' else 'duplicate' end outcome,
    dataset, prompt, thinking_final, answer from ranked)
"""

CANON_ANSWER = (f"(case when {ANSWER_OK} then regexp_replace(regexp_replace("
                f"cast(json({GREEDY}) as varchar), ',', ', ', 'g'), '\":', '\": ', 'g') "
                f"else {strip('answer')} end)")


# ---------------------------------------------------------------- setups, split
CANON = f"""
canon as (select pos, qid, coalesce(dataset, 'unknown') dataset, {strip('prompt')} prompt,
  {strip('thinking_final')} thinking, {CANON_ANSWER} answer from outcomes where outcome = 'kept')
"""

SYSTEM = ("You are a careful retrieval assistant that ranks candidate tables by "
          "their relevance to a user's question.")
HINT = ("Think step-by-step before answering; here is an example of the kind of "
        "reasoning to learn from:")
CUE = "Based on that reasoning, give the final ranking."


def _turn(role: str, value: str) -> str:
    return f"{{'from': '{role}', 'value': {value}}}"


_RESP = "thinking || chr(10) || chr(10) || answer"
_HINTP = f"prompt || chr(10) || chr(10) || '{HINT}' || chr(10) || thinking"
SETUP_ROWS = f"""
setups as (
  select pos, qid, 'setup1_full_loss' setup, false mask_history,
    [{_turn('human', 'prompt')}, {_turn('gpt', _RESP)}] conversations from canon
  union all select pos, qid, 'setup2_answer_only', true,
    [{_turn('human', 'prompt')}, {_turn('gpt', 'thinking')}, {_turn('human', repr(CUE))},
     {_turn('gpt', 'answer')}] from canon
  union all select pos, qid, 'setup3_1_hint_answer_only', false,
    [{_turn('human', _HINTP)}, {_turn('gpt', 'answer')}] from canon
  union all select pos, qid, 'setup3_2_hint_full_loss', false,
    [{_turn('human', _HINTP)}, {_turn('gpt', _RESP)}] from canon)
"""

SPLIT = """
nval as (select case when count(*) > 20 then greatest(1, floor(count(*) * cast(0.05 as double)))
                     else 0 end k from canon),
split as (select qid, pos, case when row_number() over (order by md5('42:' || qid), qid) <= (select k from nval)
                      then 'val' else 'train' end split from canon)
"""


def greedy_sql(max_bytes: int) -> str:
    """SHARD2 as a recursive fold over each lang's records in pos order."""
    return f"""
with recursive {F4.strip()},
r as (select lang, pos, rec_bytes, row_number() over (partition by lang order by pos) rn from f4),
g as (select lang, rn, pos, rec_bytes, 2 + rec_bytes cur, cast(0 as bigint) shard_id from r where rn = 1
      union all
      select r.lang, r.rn, r.pos, r.rec_bytes,
        case when g.cur + r.rec_bytes > {max_bytes} then 2 + r.rec_bytes else g.cur + r.rec_bytes end,
        case when g.cur + r.rec_bytes > {max_bytes} then g.shard_id + 1 else g.shard_id end
      from g join r on r.lang = g.lang and r.rn = g.rn + 1)
"""


def greedy_cte(source: str, key: str, max_bytes: int) -> str:
    """SHARD2 as a recursive fold over ``source`` (key, pos, rec_bytes)."""
    return f"""
seq as (select {key} key, pos, rec_bytes, row_number() over (partition by {key} order by pos) rn from {source}),
fold as (select key, rn, pos, 2 + rec_bytes cur, cast(0 as bigint) shard from seq where rn = 1
  union all
  select seq.key, seq.rn, seq.pos, case when cur + rec_bytes > {max_bytes} then 2 + rec_bytes else cur + rec_bytes end,
    case when cur + rec_bytes > {max_bytes} then shard + 1 else shard end
  from fold join seq on seq.key = fold.key and seq.rn = fold.rn + 1)
"""


# ---------------------------------------------------------------- runs, manifest
MAX_STEPS = 64
LABELS = ("case setup when 'setup1_full_loss' then 'full_loss' when 'setup2_answer_only' then 'answer_only' "
          "when 'setup3_1_hint_answer_only' then 'hint_answer_only' "
          "when 'setup3_2_hint_full_loss' then 'hint_full_loss' end")
MODELS_VALUES = "(values ('qwen3_8b', 'Qwen/Qwen3-8B'), ('qwen3_4b', 'Qwen/Qwen3-4B')) m(model_tag, repo_id)"

DOC_PATHS = """
docpaths as (select doc_id, concat('/home/u', source, '/proj/',
    case doc_id % 4 when 0 then 'training_data' when 1 then 'lora_runs' when 2 then 'eval_runs' else 'misc' end,
    '/', lang, '/', case when doc_id % 3 = 0 then 'eval_runs/' else '' end, cast(doc_id as varchar), '.json',
    case when doc_id % 5 = 0 then concat(' "/cache/old/Qwen__Qwen3-', cast(n_chars % 9 as varchar), 'B"')
         else '' end) path from documents)
"""


# ---------------------------------------------------------------- sources, native lists
LINES = """
lines as (select run, ex_id, '{' ||
    case when ex_id % 7 = 0 and ex_id % 3 <> 0 then '"predict": null, ' else '' end ||
    '"' || (case ex_id % 3 when 0 then 'predict' when 1 then 'prediction' else 'output' end) || '": ' ||
    cast(to_json(predict) as varchar) || ', "' ||
    (case ex_id % 4 when 0 then 'label' when 1 then 'labels' when 2 then 'reference' else 'gold' end) || '": ' ||
    cast(to_json(label) as varchar) || '}' line from f1),
picked as (select run, ex_id, json_keys(line) k, line from lines)
"""


def pick_sql(keys) -> str:
    out = "null"
    for k in reversed(keys):
        out = f"case when list_contains(k, '{k}') then line ->> '$.{k}' else {out} end"
    return out


NATIVE = """
nl as (select l_orderkey, l_partkey, max(l_extendedprice) px, max(l_quantity) q
       from lineitem group by l_orderkey, l_partkey),
na as (select l_orderkey ex_id,
         list(cast(l_partkey as varchar) order by px desc, l_partkey) gold_ids,
         coalesce(list(cast(l_partkey as varchar) order by q desc, l_partkey) filter (where q >= 45), []) pred_ids
       from nl group by l_orderkey),
nparsed as (select o_orderpriority run, ex_id, struct_pack(ids := pred_ids, numeric := true) p,
              struct_pack(ids := gold_ids, numeric := true) g from na join orders on o_orderkey = ex_id)
"""
