"""Registered queries: access control, serving, rendering."""

from pyspark.sql import functions as F

from factbase.operators import access, render, usage
from factbase.operators.freshness import owner_freshness
from factbase.plans.catalog_core import OF, PF, VT, fresh_cte
from factbase.plans.catalog_docs import scrub_sql
from factbase.plans.catalog_merge import SIZES
from factbase.plans.fixtures import AS_OF, with_views

KEYS = ["identity.name", "role", "languages.primary", "frameworks", "editor", "tone", "company", "style.code", "current_focus"]
_klist = ",".join(f"'{k}'" for k in KEYS)


def profile_facts(v):
    """Facts under the keys that cards, profiles and phrases look at."""
    return v.F.withColumn("key", F.expr(f"element_at(array({_klist}), cast(pos % 9 as int) + 1)"))


def _scored(v):
    return usage.priority_scores(profile_facts(v), usage.usage_by_fact(v.U))


PFX = f"""PX as (select * replace ((([{_klist}])[(pos % 9) + 1]) as key) from F),
PS as (select *, {VT} as v, round(40e0 + case confidence when 'medium' then 66e0 when 'low' then 33e0 else 100e0 end * 0.2e0, 2) as score from PX)"""

ALIAS = " ".join(f"when contains({{c}}, '{k}') then '{n}'" for k, n in access.ALIASES.items())
_strip = r"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
RA = f"""R0 as (select *, case when agent_id <> '' then lower({_strip.format(x='agent_id')}) end as ca,
 case when user_agent <> '' then {_strip.format(x="split_part(split_part(lower(user_agent), '/', 1), ' ', 1)")} end as cb from RQ),
RA as (select * exclude (ca, cb), coalesce(case {ALIAS.format(c='ca')} end, case {ALIAS.format(c='cb')} end, ca, cb, 'unknown') as agent from R0)"""
AP = """AG as (select distinct owner_id, agent from RA),
AP as (select a.owner_id, a.agent, case when o.owner_id is not null then o.allow_all when d.owner_id is not null then d.allow_all else true end as allow_all,
 case when o.owner_id is not null then o.packs when d.owner_id is not null then d.packs else [] end as packs
 from AG a left join (select * from PM where allow_all or len(packs) > 0) o on a.owner_id = o.owner_id and a.agent = o.agent
 left join (select * from PM where agent = 'default') d on a.owner_id = d.owner_id)"""
VP = "VP as (select a.owner_id, a.agent, p.pack from AP a join P p on a.owner_id = p.owner_id and (a.allow_all or list_contains(a.packs, p.pack)){extra})"

def _changes(v):
    return v.W.select(
        "owner_id", "seq", F.expr("case when seq % 97 = 0 then 'reset' when seq % 7 = 0 then 'set_all' else 'set' end").alias("action"),
        F.concat(F.lit("agent"), F.col("key")).alias("agent"), F.split("value", ",").alias("packs"))


CH = """CH as (select owner_id, seq, case when seq % 97 = 0 then 'reset' when seq % 7 = 0 then 'set_all' else 'set' end as action, 'agent' || key as agent, string_split(value, ',') as packs from W),
RS as (select owner_id, max(seq) as r from CH where action = 'reset' group by 1),
LV as (select CH.* from CH left join RS using (owner_id) where action <> 'reset' and (r is null or seq > r)),
ST as (select owner_id, agent, action = 'set_all' as allow_all, case when action = 'set' then packs else [] end as packs from LV qualify row_number() over (partition by owner_id, agent order by seq desc) = 1),
BS as (select * from PM where owner_id not in (select owner_id from RS)),
NP as (select * from BS anti join ST using (owner_id, agent) union all select * from ST
 union all select distinct owner_id, 'default', true, cast([] as varchar[]) from ST where owner_id not in (select owner_id from BS) and owner_id not in (select owner_id from ST where agent = 'default'))"""
RULE = "case when allow_all then 'all' else array_to_string(packs, ', ') end as rule"

PP = f"""{SIZES}, PP as (select owner_id, pack, 0 as block, '' as ord, 0 as ord_n, 0 as pos, '## Context: ' || pack || ' (' || scope || ')' as line from P
 union all select owner_id, pack, 1, '', 0, 0, chr(10) || description || chr(10) from P where description <> ''
 union all select owner_id, pack, 2, '', 0, 0, chr(10) || '### Known facts' from SZ where n_facts > 0
 union all select owner_id, pack, 3, key, 0, pos, '- **' || key || '**: ' || {VT} from {{f}} semi join P using (owner_id, pack)
 union all select owner_id, pack, 4, '', 0, 0, chr(10) || '### Rules & preferences' from SZ where n_rules > 0
 union all select owner_id, pack, 5, '', -priority, pos, '- ' || case when priority > 0 then '[P' || priority || '] ' else '' end || instruction from RU semi join P using (owner_id, pack))"""
INTRO = ("'# User Context' || chr(10) || 'The following describes the user''s preferences, skills, and instructions.' || chr(10) || "
         "'Respect these unless the user explicitly overrides them in conversation.'")
ENTRY = f"'- ' || key || ': ' || {VT}"
ST = f"""ST as (select owner_id, pack, 0 as block, pos, case
 when contains(lower(key), 'language') and contains(lower(key), 'primary') then 'User''s primary programming languages are: ' || {VT}
 when contains(lower(key), 'language') and contains(lower(key), 'learning') then 'User is currently learning: ' || {VT}
 when contains(lower(key), 'framework') then 'User works with these frameworks: ' || {VT} when contains(lower(key), 'editor') then 'User''s preferred editor is ' || {VT}
 when contains(lower(key), 'tone') then 'User''s preferred tone is: ' || {VT} when contains(lower(key), 'role') then 'User''s role is: ' || {VT}
 when contains(lower(key), 'company') then 'User works at ' || {VT} when contains(lower(key), 'team') then 'User is on the ' || {VT}
 when contains(lower(key), 'style') then 'User''s ' || scope || ' style preference: ' || {VT} when contains(lower(key), 'audience') then 'User''s target audience: ' || {VT}
 else 'User ' || scope || ' context — ' || key || ': ' || {VT} end as line from PX join P using (owner_id, pack)
 union all select owner_id, pack, 1, pos, 'User preference (' || scope || '): ' || instruction from RU join P using (owner_id, pack))"""
SECT = "case type when 'identity' then 0 when 'skill' then 1 when 'preference' then 2 when 'style' then 3 else 4 end"
RULE_LINE = "'- ' || case when priority > 0 then '[P' || priority || '] ' else '' end || instruction"
HEADS = "case {s} when 1 then '**Stack:**' when 2 then '**Preferences:**' when 3 then '**Style:**' end"

CARD = f"""{PFX}, RW as (select * from PS), SK0 as (select *, row_number() over (partition by owner_id order by pack, score desc, pos) as n from RW where key in ('languages.primary','frameworks','editor')),
SK as (select * from SK0 where n <= 3), SKT as (select owner_id, string_agg(list_last(string_split(key, '.')) || ': ' || {scrub_sql('v')}, ' | ' order by n) as stack from SK group by 1),
FULL3 as (select owner_id, pack as fp, score as fs, pos as fi from SK where n = 3),
NM as (select owner_id, v as name from RW where key = 'identity.name' and v <> '' qualify row_number() over (partition by owner_id order by pack, score desc, pos) = 1),
RL as (select owner_id, v as role from RW left join FULL3 using (owner_id) where v <> '' and (key in ('role','role.employment','role.founder') or (type = 'identity' and key <> 'identity.name'
  and (key not in ('languages.primary','frameworks','editor') or (fp is not null and (pack, -score, pos) > (fp, -fs, fi))))) qualify row_number() over (partition by owner_id order by pack, score desc, pos) = 1),
R2 as (select owner_id, pack, pos, instruction from RU semi join P using (owner_id, pack) qualify row_number() over (partition by owner_id, pack order by pos) <= 2),
R3 as (select * from R2 qualify row_number() over (partition by owner_id order by pack, pos) <= 2),
RT as (select owner_id, string_agg(instruction, ' | ' order by pack, pos) as rules from R3 group by 1),
CA as (select owner_id, coalesce(nullif(concat_ws(' — ', {scrub_sql('name')}, {scrub_sql('role')}), ''), 'User') as head, stack, rules
 from (select distinct owner_id from P) left join NM using (owner_id) left join RL using (owner_id) left join SKT using (owner_id) left join RT using (owner_id))
select owner_id, case when head = 'User' and stack is null and rules is null then 'No user identity configured.' else concat_ws(chr(10), head, 'Stack: ' || stack, 'Key rules: ' || rules) end as card from CA"""


def profile_sql(cap: str) -> str:
    return f"""{fresh_cte()}, {PF}, {OF}, {PFX}, CF as (select *, {'case confidence when ' + chr(39) + 'high' + chr(39) + ' then 0 when ' + chr(39) + 'medium' + chr(39) + ' then 1 else 2 end' if cap else '0'} as c from PS),
C2 as (select *, case when starts_with(key, 'identity') or key in ('role','role.founder','role.student','role.employment') then 0 when type = 'skill' or key in ('languages.primary','frameworks','editor','ai_tools') then 1 else 2 end as section
 from CF {cap}),
CX as (select * from C2 where section < 2 union all select * from (select * from C2 where section = 2 qualify row_number() over (partition by owner_id order by pack, c, score desc, pos) <= 10)),
BO as (select owner_id, section, pack, pos, key || ': ' || {scrub_sql('v')} as entry from CX
 union all select owner_id, 3, pack, pos, instruction from (select * from RU semi join P using (owner_id, pack) qualify row_number() over (partition by owner_id order by pack, pos) <= 5))
select * from BO union all select owner_id, 4, '', 0, 'Context freshness: ' || freshness || '/100' from OFR semi join BO using (owner_id)
union all select distinct owner_id, 4, '', 0, 'No user context available.' from P anti join BO using (owner_id)"""


def _agents(v):
    return access.resolve_agents(v.RQ)


def _visible_to(v, agent):
    who = v.P.select("owner_id", F.lit(agent).alias("agent")).distinct()
    seen = access.visible_packs(who, v.P, v.PM).select("owner_id", "pack")
    return v.P.join(seen, ["owner_id", "pack"], "left_semi")


def _full(v):
    return render.full_context(_visible_to(v, "cursor"), _scored(v), v.RU, ["development", "work"], 5)


def _text(v):
    return render.assemble(render.pack_prompt(v.P, v.F, v.RU), ["owner_id", "pack"], ["block", "ord", "ord_n", "pos"], 25)


def _profile(v, cap=None):
    fresh = owner_freshness(v.F, v.P, AS_OF)
    return render.compact_profiles(v.P, _scored(v), v.RU, fresh, cap).drop("rank")


_PS = profile_sql("")
PROFILE_LINES = f"""{_PS[: _PS.index('BO as (select owner_id, section')]} BO as (select owner_id, section, pack, c * 1000e0 - score as rank, pos, key || ': ' || {scrub_sql('v')} as entry from CX
 union all select owner_id, 3, pack, 0e0, pos, instruction from (select * from RU semi join P using (owner_id, pack) qualify row_number() over (partition by owner_id order by pack, pos) <= 5)),
 BX as (select * from BO union all select owner_id, 4, '', 0e0, 0, 'Context freshness: ' || freshness || '/100' from OFR semi join BO using (owner_id)
 union all select distinct owner_id, 4, '', 0e0, 0, 'No user context available.' from P anti join BO using (owner_id)),
 BL as (select owner_id, section, entry, row_number() over (partition by owner_id, section order by pack, rank, pos) - 1 as n from BX)
 select owner_id, section, n // 1000 as part, case when n // 1000 > 0 then '' when section < 4 then (['Identity: ', 'Stack: ', 'Context: ', 'Rules: '])[section + 1] else '' end || string_agg(entry, ' | ' order by n) as line from BL group by owner_id, section, n // 1000"""

QUERIES = {
    "resolve_agents": (
        lambda v: _agents(v).select("event_id", "owner_id", "agent"),
        with_views("RQ", f"with {RA} select event_id, owner_id, agent from RA")),
    "allowed_packs": (
        lambda v: access.allowed_packs(_agents(v), v.PM).select("owner_id", "agent", "allow_all", F.array_join("packs", ",").alias("packs")),
        with_views("RQ PM", f"with {RA}, {AP} select owner_id, agent, allow_all, array_to_string(packs, ',') as packs from AP")),
    "visible_packs": (
        lambda v: access.visible_packs(_agents(v), v.P, v.PM, ["src0", "src1", "src2", "src5", "src8", "src13"]),
        with_views("RQ PM P", f"with {RA}, {AP}, {VP.format(extra=' where p.pack in (' + chr(39) + (chr(39) + ',' + chr(39)).join(['src0', 'src1', 'src2', 'src5', 'src8', 'src13']) + chr(39) + ')')} select * from VP")),
    "apply_permission_changes": (
        lambda v: access.list_permissions(access.apply_permission_changes(v.PM, _changes(v))),
        with_views("PM W", f"with {CH} select owner_id, agent, {RULE} from NP")),
    "list_permissions": (
        lambda v: access.list_permissions(v.PM), with_views("PM", f"select owner_id, agent, {RULE} from PM")),
    "serve_log": (
        lambda v: usage.serve_log(_agents(v), access.visible_packs(_agents(v), v.P, v.PM), v.F, v.P),
        with_views("RQ PM P F", f"""with {RA}, {AP}, {VP.format(extra='')},
 LG as (select r.owner_id, r.agent, v.pack, null as key, ts from RA r join VP v using (owner_id, agent) join P using (owner_id, pack) where tool in ('card','profile') or tool = 'all' and (scope_arg is null or list_contains(string_split(scope_arg, ','), scope))
  union all select r.owner_id, r.agent, v.pack, null, ts from RA r join VP v on r.owner_id = v.owner_id and r.agent = v.agent and r.pack_arg = v.pack where tool = 'pack'
  union all select r.owner_id, r.agent, v.pack, f.key, ts from RA r join VP v on r.owner_id = v.owner_id and r.agent = v.agent and r.pack_arg = v.pack join F f on f.owner_id = v.owner_id and f.pack = v.pack where tool = 'pack')
 select owner_id, agent, pack, key, count(*) as calls, max(ts) as last_called from LG group by all""")),
    "pack_prompt": (
        lambda v: render.pack_prompt(v.P, v.F, v.RU), with_views("F RU P", f"with {PP.format(f='F')} select * from PP")),
    "pack_prompt_text": (
        _text, with_views("F RU P", f"with {PP.format(f='F')}, PN as (select *, row_number() over (partition by owner_id, pack order by block, ord, ord_n, pos) as n from PP) select owner_id, pack, (n - 1) // 25 as part, string_agg(line, chr(10) order by n) as text from PN group by all")),
    "export_system_prompt": (
        lambda v: render.export_system_prompt(v.P, v.F, v.RU),
        with_views("F RU P", f"with {PP.format(f='F')} select * from PP union all select owner_id, pack, -1, '', 0, 0, '' from P union all select distinct owner_id, '', 0, '', 0, 0, {INTRO} from P")),
    "export_rules_file": (
        lambda v: render.export_rules_file(v.P, v.F, v.RU),
        with_views("F RU P", f"""with {SIZES} select owner_id, pack, 0 as block, '' as ord, 0 as ord_n, 0 as pos, '# Context: ' || pack || chr(10) || '# Scope: ' || scope || chr(10) as line from P
 union all select owner_id, pack, 1, '', 0, 0, '## User Context' from SZ where n_facts > 0 union all select owner_id, pack, 2, '', 0, pos, {ENTRY} from F semi join P using (owner_id, pack)
 union all select owner_id, pack, 3, '', 0, 0, '' from SZ where n_facts > 0 union all select owner_id, pack, 4, '', 0, 0, '## Rules' from SZ where n_rules > 0
 union all select owner_id, pack, 5, '', -priority, pos, '- ' || instruction from RU semi join P using (owner_id, pack) union all select owner_id, pack, 6, '', 0, 0, '' from SZ where n_rules > 0""")),
    "memory_statements": (
        lambda v: render.memory_statements(v.P, profile_facts(v), v.RU),
        with_views("F RU P", f"with {PFX}, {ST} select * from ST")),
    "export_memory_text": (
        lambda v: render.export_memory_text(v.P, profile_facts(v), v.RU),
        with_views("F RU P", f"""with {PFX}, {ST}, SN as (select owner_id, row_number() over (partition by owner_id order by pack, block, pos) as number, line from ST)
 select owner_id, number, number || '. ' || line as line from SN union all select owner_id, 0, '# Total statements: ' || count(*) from ST group by 1""")),
    "export_custom_instructions": (
        lambda v: render.export_custom_instructions(v.P, v.F, v.RU),
        with_views("F RU P", f"""with {SIZES} select owner_id, pack, 0 as block, '' as ord, 0 as ord_n, 0 as pos, '[' || upper(scope) || ']' as line, 'about_you' as field from SZ where n_facts > 0
 union all select owner_id, pack, 1, '', 0, pos, {ENTRY}, 'about_you' from F semi join P using (owner_id, pack) union all select owner_id, pack, 2, '', 0, 0, '', 'about_you' from SZ where n_facts > 0
 union all select owner_id, pack, 0, '', 0, 0, '[' || upper(scope) || ']', 'response_style' from SZ where n_rules > 0
 union all select owner_id, pack, 1, '', -priority, pos, '- ' || instruction, 'response_style' from RU semi join P using (owner_id, pack) union all select owner_id, pack, 2, '', 0, 0, '', 'response_style' from SZ where n_rules > 0""")),
    "export_identity_md": (
        lambda v: render.export_identity_md(v.P, v.F, v.RU),
        with_views("F RU P", f"""with MF as (select *, {SECT} as s from F semi join P using (owner_id, pack)), US as (select distinct owner_id, pack, s from MF), MR as (select * from RU semi join P using (owner_id, pack))
 select owner_id, pack, 0 as block, '' as ord, 0 as ord_n, 0 as pos, '### ' || pack || ' (' || scope || ')' || case when coalesce(description, '') <> '' then chr(10) || '_' || description || '_' else '' end || chr(10) as line from P
 union all select owner_id, pack, 10 * (s + 1), '', 0, 0, {HEADS.format(s='s')} from US where s in (1, 2, 3)
 union all select owner_id, pack, 10 * (s + 1) + 1, '', 0, pos, case when s = 0 then '- **' || key || '**: ' || {VT} else {ENTRY} end from MF
 union all select owner_id, pack, 10 * (s + 1) + 2, '', 0, 0, '' from US
 union all select distinct owner_id, pack, 90, '', 0, 0, '**Rules** (sorted by priority):' from MR union all select owner_id, pack, 91, '', -priority, pos, {RULE_LINE} from MR
 union all select distinct owner_id, pack, 92, '', 0, 0, '' from MR""")),
    "export_agents_md": (
        lambda v: render.export_agents_md(v.P, v.F, v.RU),
        with_views("F RU P", f"""with LN as (select owner_id, pack, case type when 'identity' then 10 when 'skill' then 20 else 30 end as block, '' as ord, 0 as ord_n, pos, {ENTRY} as line from F semi join P using (owner_id, pack)
  union all select owner_id, pack, 40, '', -priority, pos, {RULE_LINE} from RU semi join P using (owner_id, pack)), UB as (select distinct owner_id, block from LN)
 select * from LN union all select owner_id, '', block - 1, '', 0, 0, case block when 10 then '**Identity:**' when 20 then '**Stack:**' when 30 then '**Preferences:**' else '**Rules:**' end from UB
 union all select owner_id, '', block + 1, '', 0, 0, '' from UB""")),
    "identity_cards": (
        lambda v: render.identity_cards(v.P, _scored(v), v.RU), with_views("F RU P", "with " + CARD)),
    "compact_profiles": (lambda v: _profile(v), with_views("F RU P", "with " + profile_sql(""))),
    "compact_profiles_capped": (
        lambda v: _profile(v, 4),
        with_views("F RU P", "with " + profile_sql("qualify row_number() over (partition by owner_id, pack order by c, score desc, pos) <= 4"))),
    "profile_text": (
        lambda v: render.profile_text(render.compact_profiles(v.P, _scored(v), v.RU, owner_freshness(v.F, v.P, AS_OF))),
        with_views("F RU P", "with " + PROFILE_LINES)),
    "custom_instructions_text": (
        lambda v: render.custom_instructions_text(v.P, v.F, v.RU),
        with_views("F RU P", f"""with {SIZES}, CI as (select owner_id, pack, 0 as block, 0 as ord_n, 0 as pos, '[' || upper(scope) || ']' as line, 'about_you' as field from SZ where n_facts > 0
 union all select owner_id, pack, 1, 0, pos, {ENTRY}, 'about_you' from F semi join P using (owner_id, pack) union all select owner_id, pack, 2, 0, 0, '', 'about_you' from SZ where n_facts > 0
 union all select owner_id, pack, 0, 0, 0, '[' || upper(scope) || ']', 'response_style' from SZ where n_rules > 0
 union all select owner_id, pack, 1, -priority, pos, '- ' || instruction, 'response_style' from RU semi join P using (owner_id, pack) union all select owner_id, pack, 2, 0, 0, '', 'response_style' from SZ where n_rules > 0),
 CN as (select *, row_number() over w - 1 as n, count(*) over (partition by owner_id, field) as all_n from CI window w as (partition by owner_id, field order by pack, block, ord_n, pos)),
 CT as (select owner_id, field, n // 1000 as part, string_agg(line, chr(10) order by n) as text from CN where n < all_n - 1 group by all),
 OW as (select distinct owner_id, field, head from P, (values ('about_you', 'FIELD 1: what the assistant should know about you'), ('response_style', 'FIELD 2: how the assistant should answer')) t(field, head))
 select owner_id, field, coalesce(part, 0) as part, case when coalesce(part, 0) = 0 then repeat('=', 60) || chr(10) || head || chr(10) || repeat('=', 60) || chr(10) || chr(10) else '' end || coalesce(text, '') as text from OW left join CT using (owner_id, field)""")),
    "full_context": (
        _full,
        with_views("F RU P PM", f"""with AG as (select distinct owner_id, 'cursor' as agent from P), {AP.split('),', 1)[1].strip()}, VX as (select p.* from P p join AP a on a.owner_id = p.owner_id and (a.allow_all or list_contains(a.packs, p.pack)) where scope in ('development', 'work')),
 {PFX}, TOP as (select * from PS qualify row_number() over (partition by owner_id, pack order by score desc, pos) <= 5)
 select owner_id, pack, 0 as block, '' as ord, 0 as ord_n, 0 as pos, '## Context: ' || pack || ' (' || scope || ')' as line from VX
 union all select owner_id, pack, 1, '', 0, 0, chr(10) || description || chr(10) from VX where description <> ''
 union all select owner_id, pack, 3, key, 0, pos, '- **' || key || '**: ' || v from TOP semi join VX using (owner_id, pack)
 union all select owner_id, pack, -1, '', 0, 0, '' from VX
 union all select distinct owner_id, pack, 2, '', 0, 0, chr(10) || '### Known facts' from TOP semi join VX using (owner_id, pack)
 union all select distinct owner_id, pack, 4, '', 0, 0, chr(10) || '### Rules & preferences' from RU semi join VX using (owner_id, pack)
 union all select owner_id, pack, 5, '', -priority, pos, {RULE_LINE} from RU semi join VX using (owner_id, pack)""")),
}
