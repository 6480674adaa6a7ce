"""SQL twins of the catalogue, for DuckDB over the same tables."""
from __future__ import annotations

from .catalog import NOW_MS, TASK, _TEST_PROFILES
from .models import _PROFILES, BUDGET_TABLES, SECTIONS, ModelProfile

EPOCH = 1704067200000
BUDGET = {p[0]: ModelProfile(*p).input_budget for p in _TEST_PROFILES}
WORDS = r"'[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+'"


def tok(text: str) -> str:
    return f"len(regexp_extract_all({text}, {WORDS}))::bigint"


def doc_block(i: str) -> str:
    return f"printf('%012x', {EPOCH} + ({i}) * 1000) || printf('%020x', {i})"


C = f"""c as (select printf('%032x', conv_id) as session_id, {EPOCH} + conv_id * 3600000 + turn * 60000 as ts,
  printf('%012x', {EPOCH} + conv_id * 3600000 + turn * 60000) || printf('%020x', conv_id * 1000 + turn) as block_id,
  case role when 'system' then 'System' when 'user' then 'UserMessage' else 'AssistantMessage' end as kind,
  case role when 'system' then 'System' else 'Recent' end as section,
  ((turn % 5) / 4.0)::float as priority, text, {tok('text')} as tokens, conv_id, turn from conversations)"""


def d(session: str = "source") -> str:
    return f"""d as (select doc_id, md5({session}) as session_id, {EPOCH} + doc_id * 1000 as ts, {doc_block('doc_id')} as block_id,
  ['Fact', 'DocumentChunk', 'Plan', 'State', 'ToolResult'][doc_id % 5 + 1] as kind,
  ['Retrieved', 'Background', 'Plan', 'State', 'Tools'][doc_id % 5 + 1] as section,
  0.0::float as priority, text, {tok('text')} as tokens, sha256(text) as content_hash from documents)"""


D = d()
E = f"""e as (select {doc_block('doc_id')} as from_id, {doc_block('doc_id // 2')} as to_id,
  ['Parent', 'DerivedFrom', 'Supports', 'Contradicts', 'ToolInvocation'][doc_id % 5 + 1] as kind, doc_id % 5 + 1 as code from documents)"""
PUT = "p as (select *, first_value(block_id) over (partition by content_hash order by doc_id) as owner from d)"


def recency(of: str) -> str:
    return f"rec as (select *, ((ts - min(ts) over (partition by session_id))::float / greatest(max(ts) over (partition by session_id) - min(ts) over (partition by session_id), 1)::float)::float as rec from {of})"


def ranked(of: str) -> str:
    return recency(of) + """, scored as (select session_id as request_id, block_id, section, tokens, (rec + 0.5::float * priority)::float as score from rec),
ranked as (select *, (score / greatest(tokens, 1)::float)::float as eff from scored)"""


def fraction(section: str, shares: dict[str, float] | None = None) -> str:
    shares = BUDGET_TABLES["default"] if shares is None else shares
    return "case " + section + "".join(f" when '{s}' then {shares.get(s, 0.0)}" for s in SECTIONS) + " end"


def fold(start: str, limit: str) -> str:
    return f"""list_reduce(list_prepend({{'used': ({start})::bigint, 'sel': []::varchar[], 'id': '', 'tok': 0::bigint}}, l),
    lambda a, x: case when a.used + x.tok <= {limit} then {{'used': a.used + x.tok, 'sel': list_append(a.sel, x.id), 'id': '', 'tok': 0::bigint}} else a end)"""


def plan(of: str, budget: int, base: int = 0, tag: str = "", shares: dict[str, float] | None = None) -> str:
    """selected<tag>(request_id, pos, block_id, score) over ranked; base counts the task."""
    order = "case section" + "".join(f" when '{s}' then {i}" for i, s in enumerate(SECTIONS)) + " end"
    return f"""lists{tag} as (select request_id, section, list({{'used': 0::bigint, 'sel': []::varchar[], 'id': block_id, 'tok': tokens}} order by eff desc, score desc, block_id desc) as l from ranked group by all),
sysf{tag} as (select request_id, section, {fold(str(base), str(budget))} as f from lists{tag} where section = 'System'),
vari{tag} as (select r.request_id, greatest({budget} - coalesce(f.used, {base}), 0) as var from (select distinct request_id from ranked) r left join sysf{tag} using (request_id)),
room{tag} as (select request_id, section, l, floor(var::double * ({fraction('section', shares)})::float::double * (1.0::float / {max(1.0, sum((shares or {}).values()))}::float)::float::double)::bigint as room from lists{tag} join vari{tag} using (request_id) where section <> 'System'),
allf{tag} as (select request_id, section, f.sel as sel from sysf{tag} union all select request_id, section, ({fold('0', 'room')}).sel from room{tag}),
flat{tag} as (select request_id, section, {order} as o, unnest(sel) as block_id, generate_subscripts(sel, 1) as i from allf{tag}),
selected{tag} as (select request_id, row_number() over (partition by request_id order by o, i) - 1 as pos, block_id, section from flat{tag})"""


CHAT = f"with {C}, {ranked('c')}, {plan('c', BUDGET['chat-300'], 2)}"
CHAT60 = f"with {C}, {ranked('c')}, {plan('c', BUDGET['chat-60'], 2)}"
DOCS = f"with {D}, {ranked('d')}, {plan('d', BUDGET['page-4k'])}"


def iso(ms: str) -> str:
    return f"strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%dT%H:%M:%SZ')"


def rendered(stamp: bool = False) -> str:
    own = f"'[' || {iso('c.ts')} || '] ' || text" if stamp else "text"
    task = f"'Current time: ' || {iso(str(NOW_MS))} || chr(10) || chr(10) || 'what next'" if stamp else "'what next'"
    two = "chr(10) || chr(10)"
    return f"""parts as (select s.request_id, s.section, string_agg({own} || {two}, '' order by s.block_id, pos) as body from selected s join c on c.block_id = s.block_id group by all
  union all select distinct request_id, 'Task', {task} || {two} from ranked),
whole as (select request_id, string_agg('## ' || section || {two} || body, '' order by case section when 'System' then 0 when 'Task' then 1 else 6 end) as rendered from parts group by request_id)"""


def term_list(text: str, least: int) -> str:
    return f"list_transform(list_filter(regexp_split_to_array({text}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: strlen(w) >= {least} and w <> ''), lambda w: lower(w))"


LEX = f"""lex as (select session_id as request_id, block_id, (len(list_intersect(list_distinct({term_list(f"'{TASK}'", 3)}), list_distinct(h)))::float / len(list_distinct(h))::float)::float as score
  from (select session_id, block_id, {term_list('text', 3)} as h from d) where len(h) > 0)"""
FAULT = f"""bad as (select *, case when doc_id % 97 = 0 then sha256('x' || doc_id) else content_hash end as stored from d where doc_id % 83 <> 0),
idx as (select stored, min(block_id) as named from bad where doc_id % 89 <> 0 group by stored),
problems as (select 'hash-mismatch' as problem, block_id from bad where stored <> content_hash
  union all select 'missing-index', block_id from bad left join idx using (stored) where named is null
  union all select 'wrong-index', block_id from bad join idx using (stored) where named <> block_id
  union all select 'orphan-membership', block_id from d where doc_id % 83 = 0)"""
TWO = f"with {D}, {ranked('d')}, {plan('d', BUDGET['page-4k'], 0, '_a')}, {plan('d', BUDGET['page-8k'], 0, '_b')}"
TRACE = "t as (select printf('%032x', event_id) as call_id, printf('%032x', user_id) as session_id, event_id, epoch_ms(ts) as ms, event_id % 1000 as estimated from events)"
LABEL = "case kind when 'System' then 'system' when 'UserMessage' then 'user' else 'assistant' end"


def bullets(chars: int) -> str:
    flat = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
    return f"'- ' || {LABEL} || ': ' || case when length({flat}) > {chars} then substr({flat}, 1, {chars}) || '…' else {flat} end || chr(10)"


ORACLE: dict[str, str] = {
    "store_dedup_put": f"with {D}, {PUT} select block_id, kind, content_hash from p where block_id = owner",
    "store_put_existing": f"with {D}, p as (select *, first_value(block_id) over (partition by content_hash order by doc_id % 2, doc_id) as owner from d) select block_id, kind, content_hash from p where block_id = owner",
    "source_table": f"select printf('%032x', conv_id) as session_id, 'UserMessage' as kind, sha256(text) as content_hash, {EPOCH} + turn as created_at_ms, printf('%012x', {EPOCH} + turn) as time, conv_id || ':' || turn as source from conversations",
    "store_membership": f"with {D}, {PUT} select distinct session_id, owner as block_id from p",
    "store_get": f"with {D} select block_id, kind, content_hash, ts as created_at_ms from d where doc_id = 42",
    "store_list_sessions": f"with {C} select distinct session_id from c",
    "store_list_session": f"with {C} select block_id from c where conv_id = 7",
    "store_lookup_hash": f"with {D}, {PUT} select distinct content_hash, owner as block_id from p",
    "store_delete_cascade": f"""with {D}, {E}, k as (select * from d where doc_id % 7 <> 0),
        ke as (select * from e where from_id in (select block_id from k) and to_id in (select block_id from k))
        select 'blocks' as table_name, count(*) as n from k union all select 'session_blocks', count(*) from k union all select 'hash_index', count(*) from k union all select 'edges', count(*) from ke""",
    "store_purge_session": f"""with {D}, {PUT}, m as (select distinct session_id, owner from p), g as (select * from m where session_id in (md5('src1'), md5('src5')))
        select session_id, count(*) as removed from g group by session_id union all
        select 'blocks left', count(distinct owner) from m where session_id not in (md5('src1'), md5('src5'))""",
    "store_verify": f"""with {D}, {FAULT} select (select count(*) from bad) as blocks_checked, count(*) filter (problem = 'hash-mismatch') as hash_mismatch, count(*) filter (problem = 'missing-index') as missing_index,
        count(*) filter (problem = 'wrong-index') as wrong_index, count(*) filter (problem = 'orphan-membership') as orphan_membership, 0::bigint as no_session, count(*) = 0 as is_clean from problems""",
    "store_verify_rows": f"with {D}, {FAULT} select problem, block_id from problems",
    "store_repair_index": f"with {D}, {FAULT} select stored as content_hash, max(block_id) as block_id from bad group by stored",
    "edges_out": f"with {E} select from_id, to_id, kind, code::int as code from e",
    "edges_in": f"with {E} select to_id, from_id, kind, code::int as code from e",
    "edge_idempotent": f"with {E} select from_id, to_id, kind from e",
    "model_input_budget": "select * from (values " + ", ".join(f"('{p[0]}', '{p[4]}', {str(p[5]).lower()}, {ModelProfile(*p).input_budget}::bigint)" for p in _PROFILES) + ") as t(name, tokenizer, supports_system_role, input_budget)",
    "token_count_wordlevel": f"select doc_id, {tok('text')} as tokens from documents",
    "token_counts_stored": f"with {D}, {PUT} select block_id, tokens from p where block_id = owner",
    "budget_allocation": "with m as (select * from (values " + ", ".join(f"('{p[0]}', {ModelProfile(*p).input_budget}::bigint)" for p in _PROFILES) + ") as t(name, b)), f as (select * from (values "
    + ", ".join(f"('{t}', '{s}', {0.0 if s in ('System', 'Task') else fr.get(s, 0.0)}::float)" for t, fr in BUDGET_TABLES.items() for s in SECTIONS)
    + ") as t(budget_table, section, f)) select name, budget_table, section, floor(b::double * f::double * 1.0::double)::bigint as tokens from m cross join f",
    "retrieve_session": f"with {C} select session_id as request_id, block_id, 0.5::double as score, 'session' as source from c qualify row_number() over (partition by session_id order by block_id) <= 3",
    "retrieve_recency_linear": f"with {C}, {recency('c')} select session_id as request_id, block_id, round(rec::double, 6) as score, 'recency' as source from rec",
    "retrieve_recency_halflife": f"with {C} select session_id as request_id, block_id, round(pow(2.0, -((max(ts) over (partition by session_id) - ts)::float / 120000.0::float)::float)::float::double, 6) as score, 'recency' as source from c",
    "retrieve_lexical": f"with {D}, {LEX} select request_id, block_id, round(score::double, 6) as score, 'lexical' as source from lex where score > 0",
    "retrieve_bm25": f"""with {D}, q as (select unnest(list_distinct({term_list(f"'{TASK}'", 2)})) as term),
        w as (select session_id, block_id, {term_list('text', 2)} as words from d), docs as (select *, len(words) as dl from w where len(words) > 0),
        st as (select session_id, count(*) as n, avg(least(dl, 65535)) as avgdl from docs group by session_id),
        tf as (select session_id, block_id, dl, term, len(list_filter(words, lambda x: x = term)) as f from docs cross join q),
        df as (select session_id, term, count(*) as df from tf where f > 0 group by all),
        raw as (select tf.session_id, block_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) as raw from tf join df using (session_id, term) join st using (session_id) where f > 0 group by all)
        select session_id as request_id, block_id, round((raw / max(raw) over (partition by session_id))::float::double, 6) as score, 'bm25' as source from raw""",
    "retrieve_empty_query": f"with {C} select session_id as request_id, block_id, 0.0::double as score, 'lexical' as source from c where false",
    "retrieve_not_utf8": f"with {D}, {LEX} select request_id, block_id, round(score::double, 6) as score, 'lexical' as source from lex where score > 0 and block_id not in (select block_id from d where doc_id % 10 = 0)",
    "retrieve_own": f"with {C} select distinct session_id as request_id, printf('%012x', {EPOCH} + conv_id * 3600000) || printf('%020x', conv_id * 1000) as block_id, case when conv_id % 2 = 1 then 1.0 else 0.25 end::double as score, 'opening' as source from c",
    "retrieve_configured": f"""with {C} select session_id as request_id, block_id, 0.75::double as score, 'session' as source from c qualify row_number() over (partition by session_id order by block_id) <= 2
        union all select session_id, block_id, round(pow(2.0, -((max(ts) over (partition by session_id) - ts)::float / 60000.0::float)::float)::float::double, 6), 'recency' from c qualify row_number() over (partition by session_id order by ts desc, block_id) <= 1""",
    "embed_missing": f"with {D}, {PUT} select 'toy' as embedder, content_hash, 2::int as dim, length(text)::double as x, (length(text) - length(replace(text, ' ', '')))::double as y, 3::bigint as version from p where block_id = owner and kind <> 'Plan'",
    "retrieve_pinned": f"with {C} select distinct session_id as request_id, unnest([printf('%032x', 1), printf('%032x', 2)]) as block_id, 1.0::double as score, 'pinned' as source from c",
    "cross_session_facts": f"with {C} select r.session_id as request_id, block_id, 0.75::double as score, 'shared' as source from (select distinct session_id from c) r cross join (select block_id from c where conv_id = 0)",
    "retrieve_ann_exact": """with v as (select printf('%032x', label) as session_id, printf('%032x', vec_id) as block_id, vec_id, embedding::double[] as e from embeddings),
        q as (select session_id, arg_min(e, vec_id) as t from v group by session_id),
        s as (select session_id, block_id, list_cosine_similarity(e, t)::float as score from v join q using (session_id))
        select session_id as request_id, block_id, round(least(score, 1.0::float)::double, 5) as score from s where score > 0 qualify row_number() over (partition by session_id order by score desc, block_id) <= 10""",
    "embedding_cache_join": "select printf('%032x', vec_id) as block_id, vec_id % 3 <> 0 as hit, case when vec_id % 3 <> 0 then round((embedding[1] * 2.0::float)::double, 5) end as first from embeddings",
    "merge_max": f"""with {D}, {recency('d')}, {LEX} select request_id, block_id, round(max(score)::double, 6) as score from (
        select session_id as request_id, block_id, rec as score from rec union all select request_id, block_id, score from lex where score > 0 union all select session_id, block_id, 0.25::float from d) group by all""",
    "rank_candidates": f"with {D}, {ranked('d')} select request_id, section, row_number() over (partition by request_id, section order by eff desc, score desc, block_id desc)::int as rank, block_id, tokens from ranked",
    "page_required": f"with {C} select session_id as request_id, case when tokens <= {BUDGET['chat-60']} then tokens end as estimated_tokens, case when tokens > {BUDGET['chat-60']} then 'RequiredOverBudget' end as error from c where turn = 0",
    "page_required_excluded": f"with {C} select session_id as request_id, block_id, case when turn = 0 then 'Pinned' else 'HighRelevance' end as reason from c",
    "page_missing_block": f"with {C} select r.session_id as request_id, block_id, 'HighRelevance' as reason from (select distinct session_id from c) r cross join (select block_id from c where conv_id = 7 and turn = 0)",
    "page_errors": f"""with {C}, s as (select distinct session_id from c) select 'missing' as which, session_id as request_id, 'RequiredBlockMissing' as error from s union all select 'tokenizer', session_id, 'TokenizerMismatch' from s
        union all select 'over', session_id, case when 9 * tokens > {BUDGET['chat-60']} then 'RequiredOverBudget' end from c where turn = 0""",
    "page_stored_counts": f"with {D.replace(tok('text') + ' as tokens', 'case when doc_id % 2 = 0 then doc_id % 50 + 1 else ' + tok('text') + ' end as tokens')}, {ranked('d')}, {plan('d', BUDGET['page-4k'])} select s.request_id, pos::int as pos, s.block_id, round(score::double, 6) as score, 'HighRelevance' as reason from selected s join ranked using (request_id, block_id)",
    "page_section_budgets": f"with {D}, {ranked('d')}, {plan('d', BUDGET['page-4k'], shares={'Plan': 0.5, 'State': 0.25, 'Tools': 0.75})} select request_id, block_id from selected",
    "page_parents_tight": f"""with recursive {D}, top as (select session_id, max(doc_id) as top from d group by session_id), size as (select doc_id, tokens from d),
        reach(request_id, id, total) as (select session_id, top, tokens from top join size on doc_id = top where tokens <= {BUDGET['page-4k']}
          union all select request_id, id // 2, total + tokens from reach join size on doc_id = id // 2 where id > 0 and total + tokens <= {BUDGET['page-4k']})
        select request_id, {doc_block('id')} as block_id, case when id = top then 'Pinned' else 'Dependency' end as reason from reach join top on session_id = request_id""",
    "page_system_fill": f"{CHAT} select request_id, block_id, pos::int as pos from selected where section = 'System'",
    "page_chat_selected": f"{CHAT} select s.request_id, pos::int as pos, s.block_id, round(score::double, 6) as score, 'HighRelevance' as reason from selected s join ranked using (request_id, block_id)",
    "page_selected": f"{DOCS} select s.request_id, pos::int as pos, s.block_id, round(score::double, 6) as score, 'HighRelevance' as reason from selected s join ranked using (request_id, block_id)",
    "page_omitted": f"{DOCS} select request_id, block_id, 'Budget' as reason from ranked anti join selected using (request_id, block_id)",
    "page_estimated_tokens": f"{DOCS} select request_id, coalesce(sum(tokens), 0)::bigint as estimated_tokens from (select distinct request_id from ranked) left join (select s.request_id, tokens from selected s join ranked using (request_id, block_id)) using (request_id) group by request_id",
    "page_redundancy": f"""with {d('lang')}, {ranked('d')}, wordy as (select r.*, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) as ws from ranked r join d using (block_id)),
        lists as (select request_id, section, list({{'used': 0::bigint, 'sets': []::varchar[][], 'out': []::varchar[], 'id': block_id, 'tok': tokens, 'ws': ws}} order by eff desc, score desc, block_id desc) as l,
          floor({BUDGET['page-8k']}::double * ({fraction('section')})::float::double * 1.0::double)::bigint as room from wordy group by request_id, section),
        folded as (select request_id, list_reduce(list_prepend({{'used': 0::bigint, 'sets': []::varchar[][], 'out': []::varchar[], 'id': '', 'tok': 0::bigint, 'ws': []::varchar[]}}, l), lambda a, x:
          case when len(list_filter(a.sets, lambda s: len(list_intersect(s, x.ws)) / len(list_distinct(list_concat(s, x.ws))) >= 0.5)) > 0
            then {{'used': a.used, 'sets': a.sets, 'out': list_append(a.out, x.id || ':Redundant'), 'id': '', 'tok': 0::bigint, 'ws': []::varchar[]}}
          when a.used + x.tok <= room
            then {{'used': a.used + x.tok, 'sets': list_append(a.sets, x.ws), 'out': list_append(a.out, x.id || ':Selected'), 'id': '', 'tok': 0::bigint, 'ws': []::varchar[]}}
          else {{'used': a.used, 'sets': a.sets, 'out': list_append(a.out, x.id || ':Budget'), 'id': '', 'tok': 0::bigint, 'ws': []::varchar[]}} end).out as o from lists)
        select request_id, split_part(x, ':', 1) as block_id, split_part(x, ':', 2) as outcome from (select request_id, unnest(o) as x from folded)""",
    "page_summary_fallback": f"""with d0 as ({D.split(' as (', 1)[1][:-1]}), d as (select doc_id, session_id, ts, block_id, section, priority, tokens, null::varchar as sid, null::bigint as stok from d0 where doc_id % 5 <> 0
          union all select doc_id, session_id, ts, block_id, section, priority, tokens, {doc_block('doc_id + 10000000')}, {tok("'summary of block ' || doc_id")} from d0 where doc_id % 5 = 0
          union all select doc_id + 10000000, session_id, {EPOCH} + (doc_id + 10000000) * 1000, {doc_block('doc_id + 10000000')}, 'Retrieved', priority, {tok("'summary of block ' || doc_id")}, null, null from d0 where doc_id % 5 = 0),
        {ranked('d')}, lists as (select r.request_id, r.section, list({{'used': 0::bigint, 'out': []::varchar[], 'id': r.block_id, 'tok': r.tokens, 'sid': sid, 'stok': stok}} order by eff desc, score desc, r.block_id desc) as l,
          floor({BUDGET['page-4k']}::double * ({fraction('r.section')})::float::double * 1.0::double)::bigint as room from ranked r join d using (block_id) group by r.request_id, r.section),
        folded as (select request_id, list_reduce(list_prepend({{'used': 0::bigint, 'out': []::varchar[], 'id': '', 'tok': 0::bigint, 'sid': null::varchar, 'stok': null::bigint}}, l), lambda a, x:
          case when a.used + x.tok <= room then {{'used': a.used + x.tok, 'out': list_append(a.out, x.id || ':Selected'), 'id': '', 'tok': 0::bigint, 'sid': null::varchar, 'stok': null::bigint}}
          when x.sid is not null and a.used + x.stok <= room then {{'used': a.used + x.stok, 'out': list_concat(a.out, [x.sid || ':Selected', x.id || ':Compressed']), 'id': '', 'tok': 0::bigint, 'sid': null::varchar, 'stok': null::bigint}}
          else {{'used': a.used, 'out': list_append(a.out, x.id || ':Budget'), 'id': '', 'tok': 0::bigint, 'sid': null::varchar, 'stok': null::bigint}} end).out as o from lists)
        select request_id, split_part(x, ':', 1) as block_id, split_part(x, ':', 2) as outcome from (select request_id, unnest(o) as x from folded)""",
    "page_include_parents": f"""with recursive {D}, reach(request_id, id) as (select session_id, max(doc_id) from d group by session_id union select request_id, id // 2 from reach)
        select request_id, {doc_block('id')} as block_id, case when id = top then 'Pinned' else 'Dependency' end as reason from reach join (select session_id, max(doc_id) as top from d group by session_id) on session_id = request_id""",
    "pack_rendered": f"{CHAT}, {rendered()} select request_id, sha256(rendered) as sha256, length(rendered)::bigint as chars, {tok('rendered')} as tokens from whole",
    "pack_manifest": f"{CHAT} select s.request_id, s.block_id, s.section, tokens, 0.0::double as score from selected s join ranked using (request_id, block_id)",
    "pack_budget_check": f"{CHAT60}, {rendered()} select request_id, {tok('rendered')} as tokens, {BUDGET['chat-60']}::bigint as input_budget, case when {tok('rendered')} > {BUDGET['chat-60']} then 'BudgetExceeded' end as error from whole",
    "pack_timestamps": f"{CHAT}, {rendered(True)} select request_id, sha256(rendered) as sha256 from whole",
    "pack_chat": f"""{CHAT}, msgs as (
          select s.request_id, 0 as a, '' as b, 'system' as role, 'System' as section, '## System' || chr(10) || chr(10) || regexp_replace(string_agg(text || chr(10) || chr(10), '' order by s.block_id), '\\s+$', '') as content from selected s join c using (block_id) where s.section = 'System' group by s.request_id
          union all select s.request_id, 10, s.block_id, case kind when 'AssistantMessage' then 'assistant' else 'user' end, 'Recent', text from selected s join c using (block_id) where s.section = 'Recent'
          union all select distinct request_id, 12, '', 'user', 'Task', 'what next' from ranked)
        select request_id, (row_number() over (partition by request_id order by a, b) - 1)::int as idx, role, section, sha256(content) as sha256 from msgs""",
    "pack_chat_tools": f"""{DOCS}, msgs as (
          select s.request_id, case s.section when 'Background' then 1 when 'State' then 2 when 'Plan' then 3 else 4 end as a, '' as b, 'system' as role, s.section, '## ' || s.section || chr(10) || chr(10) || regexp_replace(string_agg(text || chr(10) || chr(10), '' order by s.block_id), '\\s+$', '') as content
            from selected s join d using (block_id) where s.section <> 'Tools' group by s.request_id, s.section
          union all select s.request_id, 11, s.block_id, 'tool', 'Tools', text from selected s join d using (block_id) where s.section = 'Tools')
        select request_id, (row_number() over (partition by request_id order by a, b) - 1)::int as idx, role, section, sha256(content) as sha256 from msgs""",
    "pack_chat_cache_boundary": f"""{DOCS}, msgs as (
          select s.request_id, s.section, '## ' || s.section || chr(10) || chr(10) || regexp_replace(string_agg(text || chr(10) || chr(10), '' order by s.block_id), '\\s+$', '') as content from selected s join d using (block_id) where s.section <> 'Tools' group by s.request_id, s.section
          union all select s.request_id, 'Tools', text from selected s join d using (block_id) where s.section = 'Tools'),
        sums as (select request_id, sum({tok('content')}) as n, count(*) filter (section in ('System', 'Background')) as k from msgs group by request_id)
        select r.request_id, coalesce(n, 0)::bigint as input_tokens, case when k > 0 then k - 1 end as cache_boundary from (select distinct request_id from ranked) r left join sums using (request_id)""",
    "pack_multi_model": f"{CHAT}, {rendered()}, m as (select * from (values " + ", ".join(f"('{k}', {v}::bigint)" for k, v in BUDGET.items()) + f") as t(model, input_budget)) select request_id, model, {tok('rendered')} as tokens, input_budget, case when {tok('rendered')} > input_budget then 'BudgetExceeded' end as error from whole cross join m",
    "trace_update_output": f"with {TRACE} select call_id, session_id, case when event_id % 3 = 0 then event_type end as output, case when event_id % 3 = 0 then event_id % 17 end as output_tokens, case when event_id % 3 = 0 then 2 else 1 end::bigint as version from t join events using (event_id)",
    "trace_diff": f"""{TWO} select coalesce(a.request_id, b.request_id) as request_id, coalesce(a.block_id, b.block_id) as block_id, case when a.block_id is null then 'added' when b.block_id is null then 'removed' else 'kept' end as change,
        case when a.block_id is not null then 'HighRelevance' end as reason_prev, case when b.block_id is not null then 'HighRelevance' end as reason_next from selected_a a full join selected_b b on a.request_id = b.request_id and a.block_id = b.block_id""",
    "trace_diff_summary": f"""{TWO}, j as (select coalesce(a.request_id, b.request_id) as request_id, a.block_id as x, b.block_id as y from selected_a a full join selected_b b on a.request_id = b.request_id and a.block_id = b.block_id),
        n as (select request_id, count(*) filter (x is null) as plus, count(*) filter (y is null) as minus from j group by request_id),
        ta as (select s.request_id, sum(tokens) as t from selected_a s join ranked using (request_id, block_id) group by s.request_id), tb as (select s.request_id, sum(tokens) as t from selected_b s join ranked using (request_id, block_id) group by s.request_id),
        q as (select r.request_id, coalesce(plus, 0) as plus, coalesce(minus, 0) as minus, coalesce(tb.t, 0) - coalesce(ta.t, 0) as dt from (select distinct request_id from ranked) r left join n using (request_id) left join ta using (request_id) left join tb using (request_id))
        select request_id, '+' || plus || ' -' || minus || ' ~0 (' || case when dt >= 0 then '+' else '' end || dt || ' tokens)' as summary, plus + minus = 0 as is_noop from q""",
    "trace_diff_consecutive": f"with {TRACE} select session_id, call_id, lag(call_id) over w as prev_call_id, estimated - lag(estimated) over w as token_delta from t window w as (partition by session_id order by ms, call_id) qualify prev_call_id is not null",
    "reduce_append": f"""select printf('%032x', conv_id * 1000 + turn) as call_id, printf('%012x', {NOW_MS} + turn) || '0000' || substr(sha256(text), 1, 16) as block_id, 'AssistantMessage' as kind, sha256(text) as content_hash,
        case when turn % 2 = 0 then printf('%032x', conv_id) end as parent from conversations where turn <> 3 and text <> ''""",
    "reduce_json_events": f"""with o as (select doc_id, printf('%032x', doc_id) as call_id, text, 'state ' || doc_id as state, ['Fact', 'Plan', 'Summary', 'DocumentChunk', 'other'][doc_id % 5 + 1] as k from documents),
        ok as (select * from o where doc_id % 11 <> 0 and k <> 'other' and text is not null),
        bl as (select call_id, k as kind, text as body, [1, 2, 3, 4][doc_id % 5 + 1] as mask from ok where text <> '' union all select call_id, 'State', state, 254 from ok where doc_id % 3 = 0)
        select call_id, printf('%012x', {NOW_MS}) || '0000' || printf('%02x', xor(('0x' || substr(sha256(body), 1, 2))::int, mask)) || substr(sha256(body), 3, 14) as block_id, kind, body from bl
        union all select call_id, null, 'InvalidOutput', null from o where doc_id % 11 = 0 or k = 'other' or text is null""",
    "summarize_truncating": f"with {C}, s as (select session_id, string_agg({bullets(80)}, '' order by block_id) as s from c group by session_id) select session_id, sha256(s) as sha256, length(s)::bigint as chars from s",
    "summarize_last_n": f"with {C}, l as (select * from c qualify row_number() over (partition by session_id order by block_id desc) <= 2) select session_id, string_agg({bullets(20)}, '' order by block_id) as summary from l group by session_id",
    "summarize_noop": f"with {C} select session_id, '[summary of ' || count(*) || ' block(s) elided]' as summary from c group by session_id",
    "reduce_identity": "select '' as call_id, '' as block_id, '' as kind where false",
    "summarize_external": f"with {C} select session_id, sha256(string_agg('--- block ' || n || ' (' || kind || ') ---' || chr(10) || text || chr(10) || chr(10), '' order by n)) as summary from (select *, row_number() over (partition by session_id order by block_id) as n from c) group by session_id",
    "summarize_stored": f"""with {C}, s as (select session_id, string_agg({bullets(40)}, '' order by block_id) as s, count(*)::int as parents, min(block_id) as first from c group by session_id)
        select printf('%012x', {NOW_MS}) || '0000' || substr(sha256(s), 1, 16) as block_id, sha256(s) as content_hash, parents, first, 'summarize:truncating' as source from s qualify row_number() over (partition by s order by block_id) = 1""",
    "section_of_blocks": f"with {D} select section, count(*) as n from d group by section",
    "stream_running_state": "select event_type, count(*)::varchar as state from events group by event_type",
    "stream_windowed_counts": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from events group by all",
}
