"""Registered queries: search, consolidation, similarity, diff, writes, health."""

from pyspark.sql import functions as F

from factbase.operators import consolidate as C
from factbase.operators import audit, diff, health, multi_search, mutate, search, similar
from factbase.operators.usage import priority_scores, usage_by_fact
from factbase.plans.catalog_core import PF, SC, TS, UF, VT, fresh_cte
from factbase.plans.catalog_docs import PT, hits_cte
from factbase.plans.fixtures import AS_OF, with_views

STRIP = r"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def dstrip(x: str) -> str:
    return STRIP.format(x=x)


NORM = (f"case when value_is_list then array_to_string(list_sort(list_transform(value_items, lambda x: lower({dstrip('x')}))), ', ') "
        f"else lower({dstrip('value_items[1]')}) end")
FN = f"FN as (select *, {NORM} as norm, case confidence when 'high' then 0 when 'medium' then 1 else 2 end as cr from F)"
DUPS = f"""{FN}, DR as (select *, count(*) over w as copies,
 row_number() over (partition by owner_id, key, norm order by cr, coalesce(updated_at, timestamp '0001-01-01 00:00:00') desc, pack desc, pos desc) as rn from FN window w as (partition by owner_id, key, norm)),
 KEEP as (select owner_id, key, norm, pack as kept_in, pos as kept_pos from DR where rn = 1),
 LOSE as (select d.owner_id, d.key, d.pos, {VT} as value, d.pack as removed_from, kept_in, kept_pos from DR d join KEEP using (owner_id, key, norm) where rn > 1)"""
CONFLICT = "CK as (select owner_id, key, count(*) as entries from FN group by all having count(distinct norm) > 1)"
# ---- similar values, by the plain rule: texts with their character counts, ratios by taking the longest common block first ----
CHARS = "[" + ", ".join(f"'{chr(c)}'" for c in range(ord("a"), ord("z") + 1)) + ", ' ']"
PROFILED = f"""TX as (select owner_id, pack, md5(norm) as text_id, norm, length(norm) as n, min(pos) as first_pos, max(pos) as last_pos, count(*) as copies, min(key) as key_lo, max(key) as key_hi
 from FS where norm <> '' group by owner_id, pack, norm),
TC as (select *, list_transform({CHARS}, lambda c: n - length(replace(norm, c, ''))) as cs, n - length(regexp_replace(norm, '[0-9]', '', 'g')) as digits from TX),
TP as (select *, list_append(list_append(cs, digits), n - digits - list_sum(cs)) as profile from TC),
CA as (select a.owner_id, a.pack, a.text_id as text_a, b.text_id as text_b, a.norm as na, b.norm as nb, cast(a.n + b.n as bigint) as total,
  cast(list_sum(list_transform(range(1, len(a.profile) + 1), lambda i: abs(a.profile[i] - b.profile[i]))) as bigint) as distance
 from TP a join TP b on a.owner_id = b.owner_id and a.pack = b.pack and (a.first_pos, a.text_id) < (b.first_pos, b.text_id) and 2.0 * least(a.n, b.n) >= 0.75 * (a.n + b.n) - 1e-9),
CP as (select * from CA where distance <= 0.25 * total + 1e-9)"""
RATIOS = """PQ as (select distinct na, nb from CP union select nb, na from CP),
REG as (select na, nb, na as sa, nb as sb, 0 as got from PQ union all
 select na, nb, part.sa, part.sb, part.got from (
  select na, nb, unnest([struct_pack(sa := left(sa, i - 1), sb := left(sb, j - 1), got := k), struct_pack(sa := substr(sa, i + k), sb := substr(sb, j + k), got := 0)]) as part from (
   select *, instr(sb, substr(sa, i, k)) as j from (
    select *, list_position(ks, k) as i from (
     select *, list_max(ks) as k from (
      select na, nb, sa, sb, list_transform(range(1, length(sa) + 1), lambda i: coalesce(list_max(list_filter(range(1, length(sa) - i + 2), lambda k: instr(sb, substr(sa, i, k)) > 0)), 0)) as ks
      from REG where sa <> '' and sb <> '')) where k > 0)))),
RT as (select na, nb, 2.0e0 * sum(got) / (length(na) + length(nb)) as ratio from REG group by na, nb)"""
WALK = """FR1 as (select *, row_number() over (partition by owner_id, pack order by pos) as rn from FS),
LK as (select a.owner_id, a.pack, a.rn as i, b.rn as j, a.cr < b.cr or (a.cr = b.cr and coalesce(a.updated_at, timestamp '0001-01-01 00:00:00') >= coalesce(b.updated_at, timestamp '0001-01-01 00:00:00')) as better
 from FR1 a join FR1 b on a.owner_id = b.owner_id and a.pack = b.pack and a.rn < b.rn and a.key <> b.key left join RT on RT.na = a.norm and RT.nb = b.norm where a.norm = b.norm or ratio >= 0.75),
LL as (select owner_id, pack, i, coalesce(list(j) filter (better), []) as kills, coalesce(list(j) filter (not better), []) as beats from LK group by all),
STEP as (select FR1.owner_id, FR1.pack, rn, coalesce(kills, []) as kills, coalesce(beats, []) as beats from FR1 left join LL on LL.owner_id = FR1.owner_id and LL.pack = FR1.pack and LL.i = FR1.rn),
WK as (select distinct owner_id, pack, 0::bigint as n, cast([] as bigint[]) as gone from STEP union all
 select w.owner_id, w.pack, s.rn, case when list_contains(gone, s.rn) then gone else list_distinct(list_concat(list_concat(gone, kills),
  case when len(list_filter(beats, lambda x: not list_contains(gone, x))) > 0 then [s.rn] else [] end)) end
 from WK w join STEP s on s.owner_id = w.owner_id and s.pack = w.pack and s.rn = w.n + 1),
LOST as (select owner_id, pack, unnest(gone) as rn from WK qualify n = max(n) over (partition by owner_id, pack)),
SL as (select owner_id, pack, pos, key from FR1 semi join LOST using (owner_id, pack, rn)),
SK as (select owner_id, pack, pos, key from FR1 anti join LOST using (owner_id, pack, rn))"""
ALL_FACTS = "FS as (select * from FN)"
FIRST_COPIES = "FS as (select * exclude (copies, rn) from DR where rn = 1)"
F_PARTS = "F as (select * from PN)"


def parts_recursively(body: str) -> str:
    return with_views("PN", body).replace("with PN", "with recursive PN", 1)


SIZES = """SZ as (select p.owner_id, p.pack, p.scope, coalesce(nf, 0) as n_facts, coalesce(nr, 0) as n_rules, description from P p
 left join (select owner_id, pack, count(*) as nf from F group by all) using (owner_id, pack) left join (select owner_id, pack, count(*) as nr from RU group by all) using (owner_id, pack))"""
LISTV = "array_to_string(case when value_is_list then list_sort(value_items) else value_items end, ', ')"
DG = f"""DV as (select *, md5(key || '=' || {LISTV}) as value_id from F),
DG as (select owner_id, value_id, min(key) as key, min(pack) as pack, count(*) as n from DV group by all having count(*) > 1)"""


def iss(select: str, sev: str, code: str, pack: str = "pack", detail: str = "null", number: str = "null") -> str:
    return (f"select owner_id, {sev} as severity, {pack} as pack, '{code}' as code, {detail} as detail, "
            f"cast({number} as bigint) as number from {select}")


J = {
    "check_pack_sizes": iss("SZ where n_facts > 40", "'warning'", "too_many_facts", number="n_facts")
    + " union all " + iss("SZ where n_rules > 15", "'info'", "too_many_rules", number="n_rules"),
    "check_empty_packs": iss("SZ where n_facts = 0 and n_rules = 0", "'warning'", "empty_pack"),
    "check_duplicate_facts": iss("DG", "'info'", "duplicate_fact", detail="key", number="n"),
    "check_missing_development": iss("(select owner_id from P group by 1 having not bool_or(scope = 'development'))", "'info'",
                                     "no_development_pack", pack="'(missing)'"),
    "check_missing_description": iss("P where coalesce(description, '') = ''", "'info'", "no_description"),
    "check_stale_packs": iss(f"P where updated_at < {TS} - interval 90 day", "'info'", "stale_pack",
                             number=f"floor((epoch_us({TS}) - epoch_us(updated_at)) / 86400000000.0)"),
    "check_no_rules": iss("SZ where n_facts > 0 and n_rules = 0", "'info'", "no_rules"),
    "check_secrets": iss("HITS where severity in ('critical', 'warning')",
                         "case severity when 'critical' then 'warning' else 'info' end", "secret", detail="pattern || ' in ' || key"),
}
NO_PACKS = iss("(select distinct owner_id from RQ where owner_id not in (select owner_id from P))", "'warning'", "no_packs", pack="'(none)'")
ISSUES = f"{SIZES}, {DG}, {PT}, {hits_cte('PT', 'owner_id, pack, key')}, ISS as ({' union all '.join(J.values())} union all {NO_PACKS})"

# pack n of an owner is compared with pack n + 1
SHIFT = "'src' || cast((cast(substr(pack, 4) as int) + 19) % 20 as {t})"


def shifted(v):
    return v.F.withColumn("pack", F.expr(SHIFT.format(t="string")))


DIFF = f"""S as (select owner_id, pack, key, max_by(row(value_items, value_is_list, pos), pos) as s from F group by all),
T as (select owner_id, {SHIFT.format(t='varchar')} as pack, key, max_by(row(value_items, value_is_list, pos), pos) as t from F group by all),
D0 as (select owner_id, pack, key, s is not null as has_s, t is not null as has_t, s[1] as si, s[2] as sl, s[3] as sp, t[1] as ti, t[2] as tl, t[3] as tp from S full join T using (owner_id, pack, key)),
D as (select owner_id, pack, key, case when not has_t then 'only_in_source' when not has_s then 'only_in_target'
  when case when sl and tl then list_sort(list_distinct(si)) = list_sort(list_distinct(ti)) else
   lower({dstrip("case when sl then array_to_string(list_sort(si), ', ') else si[1] end")}) = lower({dstrip("case when tl then array_to_string(list_sort(ti), ', ') else ti[1] end")}) end
  then 'matching' else 'conflict' end as status, sp as source_pos, tp as target_pos, array_to_string(si, ', ') as source_value, array_to_string(ti, ', ') as target_value from D0)"""

ITEMS = f"case when contains(value, ',') then list_filter(list_transform(string_split(value, ','), lambda x: {dstrip('x')}), lambda x: x <> '') else [value] end"
WP = "WP as (select W.* from W semi join P using (owner_id, pack))"
ENDS = "EN as (select owner_id, pack, coalesce(max(pos), -1) as last from P left join {t} using (owner_id, pack) group by all)"
UPSERT = f"""{WP}, {ENDS.format(t='F')},
WL as (select owner_id, pack, key, max_by(value, seq) as value, min_by(type, seq) as wtype, min(seq) as s1 from WP group by all),
F1 as (select owner_id, pack, key, min(pos) as pos from F group by all),
H as (select F1.*, WL.value from F1 join WL using (owner_id, pack, key))
select owner_id, pack, key, pos, case when h.value is not null then array_to_string({ITEMS.replace('value', 'h.value')}, '|') else array_to_string(value_items, '|') end as value,
 type, confidence, case when h.value is not null then 'mcp' else source end as source, case when h.value is not null then {TS} else updated_at end as updated_at
 from F left join H h using (owner_id, pack, key, pos)
union all select owner_id, pack, key, last + s1 + 1, array_to_string({ITEMS}, '|'), wtype, 'high', 'mcp', {TS} from WL join EN using (owner_id, pack) where (owner_id, pack, key) not in (select (owner_id, pack, key) from F1)"""
REPLACE = f"""{WP}, {ENDS.format(t='F')},
WL as (select owner_id, pack, key, max_by(value, seq) as value, max_by(type, seq) as wtype, max(seq) as s1 from WP group by all)
select owner_id, pack, key, pos, array_to_string(value_items, '|') as value, type, confidence, source, updated_at from F anti join WL using (owner_id, pack, key)
union all select owner_id, pack, key, last + s1 + 1, array_to_string({ITEMS}, '|'), wtype, 'high', 'manual', {TS} from WL join EN using (owner_id, pack)"""


def _writes(v):
    items, listed = mutate.parse_value("value")
    return v.W.withColumns({"value_items": items, "value_is_list": listed})


def _flat(df):
    return df.withColumn("value", F.array_join("value_items", "|")).select(
        "owner_id", "pack", "key", "pos", "value", "type", "confidence", "source", "updated_at")


def _scored(v):
    return priority_scores(v.F, usage_by_fact(v.U))


def _names(v):
    return v.RU.groupBy("owner_id", "pack").agg(F.max("priority").alias("p")).where(F.col("p") >= 10)


def _with_new(packs):
    """Each pack once more under a new name, without facts and rules."""
    return packs.unionByName(packs.withColumn("pack", F.concat("pack", F.lit("-new"))))


ASKED = "substr(text, cast(20 + doc_id % 30 as int), cast(6 + doc_id % 7 as int))"  # a query from each document

QUERIES = {
    "search_context": (
        lambda v: search.search_context(v.P, v.F, v.RU, "EN R"),
        with_views("F RU P", f"""select owner_id, pack, block, pos, '[' || pack || '/' || scope || '] ' || line as line from (
 select owner_id, pack, 0 as block, pos, key || ': ' || {VT} as line from F where contains(lower(key), 'en r') or contains(lower({VT}), 'en r')
 union all select owner_id, pack, 1, pos, 'Rule: ' || instruction from RU where contains(lower(instruction), 'en r')) join P using (owner_id, pack)""")),
    "search_many": (
        lambda v: multi_search.search_many(v.P, v.F, v.RU, v.table("documents").selectExpr("doc_id as query_id", f"{ASKED} as query"),
                                         show=lambda line: F.length(line).cast("bigint")).withColumnRenamed("line", "n_chars"),
        with_views("F RU P", f"""with Q as materialized (select doc_id as query_id, lower({ASKED}) as query from documents),
 L as materialized (select owner_id, pack, 0 as block, pos, lower(key) as head, lower({VT}) as body, key || ': ' || {VT} as line from F
 union all select owner_id, pack, 1, pos, null, lower(instruction), 'Rule: ' || instruction from RU)
 select query_id, owner_id, pack, block, pos, length('[' || pack || '/' || scope || '] ' || line) as n_chars
 from L join Q on contains(head, query) or contains(body, query) join P using (owner_id, pack)""")),
    "filter_scopes": (
        lambda v: search.filter_scopes(v.P, ["development", "writing"]),
        with_views("P", "select * from P where scope in ('development', 'writing')")),
    "select_scope_or_name": (
        lambda v: search.select_scope_or_name(v.P, "writing").unionByName(search.select_scope_or_name(v.P, "src3")),
        with_views("P", "select * from P where scope = 'writing' union all select * from P where pack = 'src3'")),
    "cap_facts": (
        lambda v: search.cap_facts(_scored(v), 3).select("owner_id", "pack", "pos", "score", F.col("rank").cast("bigint").alias("rank")),
        with_views("F U", f"with {UF}, {SC} select owner_id, pack, pos, score, row_number() over (partition by owner_id, pack order by score desc, pos) as rank from SC qualify rank <= 3")),
    "cap_facts_by_confidence": (
        lambda v: search.cap_facts_by_confidence(v.F, 4).select("owner_id", "pack", "pos", "confidence", F.col("rank").cast("bigint").alias("rank")),
        with_views("F", f"with {FN} select owner_id, pack, pos, confidence, row_number() over (partition by owner_id, pack order by cr, pos) as rank from FN qualify rank <= 4")),
    "list_packs": (lambda v: search.list_packs(v.P, v.F, v.RU), with_views("F RU P", f"with {SIZES} select * from SZ")),
    "show_pack": (
        lambda v: search.show_pack(v.P, v.F, v.RU, "src3", AS_OF),
        with_views("F RU P", f"""with {fresh_cte()}, {PF} select owner_id, pack, 0 as block, 0 as ord, 0 as pos, coalesce(description, '') as line, score from P join PF using (owner_id, pack) where pack = 'src3'
 union all select owner_id, pack, 1, 0, pos, key || ': ' || {VT}, freshness from FR where pack = 'src3'
 union all select owner_id, pack, 2, -priority, pos, instruction, priority from RU where pack = 'src3'""")),
    "normalized_values": (
        lambda v: C.normalized_values(v.F).select("owner_id", "pack", "pos", "norm"),
        with_views("F", f"with {FN} select owner_id, pack, pos, norm from FN")),
    "exact_duplicates": (lambda v: C.exact_duplicates(v.F), with_views("F", f"with {DUPS} select * from LOSE")),
    "drop_exact_duplicates": (
        lambda v: C.drop_exact_duplicates(v.F).select("owner_id", "pack", "pos", "key"),
        with_views("F", f"with {DUPS} select owner_id, pack, pos, key from DR where rn = 1")),
    "contradictions": (
        lambda v: C.contradictions(v.F),
        with_views("F", f"with {FN}, {CONFLICT} select owner_id, key, pack, pos, norm, entries from FN join CK using (owner_id, key)")),
    "consolidation_summary": (
        lambda v: C.consolidation_summary(v.F),
        with_views("F", f"""with {DUPS}, {CONFLICT} select owner_id, coalesce(merged, 0) as merged, coalesce(modified_packs, 0) as modified_packs, coalesce(contradictions, 0) as contradictions
 from (select owner_id, count(*) as merged, count(distinct removed_from) as modified_packs from LOSE group by 1) full join (select owner_id, count(*) as contradictions from CK group by 1) using (owner_id)""")),
    "consolidation_totals": (lambda v: similar.consolidation_totals(similar.consolidation_report(v.F)), None),
    "similar_facts": (lambda v: similar.similar_facts(v.F), None),
    "drop_similar_facts": (lambda v: similar.drop_similar_facts(v.F).select("owner_id", "pack", "pos", "key"), None),
    "consolidate": (lambda v: similar.consolidate(v.F).select("owner_id", "pack", "pos", "key"), None),
    "candidate_pairs": (
        lambda v: similar.candidate_pairs(v.PN),
        with_views("PN", f"with {F_PARTS}, {FN}, {ALL_FACTS}, {PROFILED} select owner_id, pack, text_a, text_b, distance, total from CP")),
    "similar_part_facts": (
        lambda v: similar.similar_facts(v.PN).withColumn("similarity", F.round("similarity", 9)),
        parts_recursively(f"""with {F_PARTS}, {FN}, {ALL_FACTS}, {PROFILED}, {RATIOS}
 select CP.owner_id, CP.pack, a.first_pos as pos_a, b.first_pos as pos_b, a.copies as copies_a, b.copies as copies_b, round(ratio, 9) as similarity
 from CP join RT on RT.na = CP.na and RT.nb = CP.nb join TX a on a.owner_id = CP.owner_id and a.pack = CP.pack and a.text_id = text_a
 join TX b on b.owner_id = CP.owner_id and b.pack = CP.pack and b.text_id = text_b
 where ratio >= 0.75 and not (a.key_lo = a.key_hi and b.key_lo = b.key_hi and a.key_lo = b.key_lo)
 union all select owner_id, pack, first_pos, last_pos, copies, copies, 1.0e0 from TX where key_lo <> key_hi""")),
    "drop_similar_part_facts": (
        lambda v: similar.drop_similar_facts(v.PN).select("owner_id", "pack", "pos", "key"),
        parts_recursively(f"with {F_PARTS}, {FN}, {ALL_FACTS}, {PROFILED}, {RATIOS}, {WALK} select * from SK")),
    "consolidate_part_facts": (
        lambda v: similar.consolidate(v.PN).select("owner_id", "pack", "pos", "key"),
        parts_recursively(f"with {F_PARTS}, {DUPS}, {FIRST_COPIES}, {PROFILED}, {RATIOS}, {WALK} select * from SK")),
    "consolidation_part_totals": (
        lambda v: similar.consolidation_totals(similar.consolidation_report(v.PN)),
        parts_recursively(f"""with {F_PARTS}, {DUPS}, {FIRST_COPIES}, {PROFILED}, {RATIOS}, {WALK},
 CX as (select owner_id, key from FS group by all having count(distinct norm) > 1),
 RP1 as (select owner_id, 'exact' as step, removed_from as pack, key from LOSE union all select owner_id, 'similar', pack, key from SL union all select owner_id, 'contradiction', null, key from CX)
 select owner_id, count(*) filter (step = 'exact') as exact, count(*) filter (step = 'similar') as similar, count(*) filter (step <> 'contradiction') as removed,
  count(*) filter (step = 'contradiction') as contradictions, count(distinct pack) as modified_packs from RP1 group by owner_id""")),
    "diff_packs": (lambda v: diff.diff_packs(v.F, shifted(v)), with_views("F", f"with {DIFF} select * from D")),
    "diff_summary": (
        lambda v: diff.diff_summary(v.F, shifted(v)),
        with_views("F", f"""with {DIFF} select owner_id, pack, count(*) filter (status = 'matching') as matching, count(*) filter (status = 'conflict') as conflict,
 count(*) filter (status = 'only_in_source') as only_in_source, count(*) filter (status = 'only_in_target') as only_in_target, bool_or(status <> 'matching') as has_differences from D group by all""")),
    "upsert_facts": (
        lambda v: _flat(mutate.upsert_facts(v.F, v.P, _writes(v), AS_OF)), with_views("F P W", "with " + UPSERT)),
    "replace_facts": (
        lambda v: _flat(mutate.replace_facts(v.F, v.P, v.W, AS_OF)), with_views("F P W", "with " + REPLACE)),
    "append_rules": (
        lambda v: mutate.append_rules(v.RU, v.P, v.W.withColumn("instruction", F.col("value"))),
        with_views("RU P W", f"""with {WP}, {ENDS.format(t='RU')} select owner_id, pack, pos, instruction, priority from RU
 union all select owner_id, pack, last + seq + 1, value, coalesce(priority, 5) from WP join EN using (owner_id, pack)""")),
    "delete_packs": (
        lambda v: search.list_packs(*mutate.delete_packs(v.P, v.F, v.RU, _names(v))),
        with_views("F RU P", f"""with {SIZES}, DN as (select owner_id, pack from RU group by all having max(priority) >= 10) select * from SZ anti join DN using (owner_id, pack)""")),
    "check_pack_sizes": (lambda v: health.check_pack_sizes(search.list_packs(v.P, v.F, v.RU)), with_views("F RU P", f"with {SIZES} {J['check_pack_sizes']}")),
    "check_empty_packs": (
        lambda v: health.check_empty_packs(search.list_packs(_with_new(v.P), v.F, v.RU)),
        with_views("F RU P", f"with PN as (select * from P union all select * replace (pack || '-new' as pack) from P), {SIZES.replace('from P p', 'from PN p')} {J['check_empty_packs']}")),
    "check_duplicate_facts": (lambda v: health.check_duplicate_facts(v.F), with_views("F", f"with {DG} {J['check_duplicate_facts']}")),
    "duplicate_fact_locations": (
        lambda v: health.duplicate_locations(v.F),
        with_views("F", f"with {DG} select owner_id, value_id, key, pack, pos from DV semi join DG using (owner_id, value_id)")),
    "check_missing_development": (lambda v: health.check_missing_development(v.P), with_views("P", J["check_missing_development"])),
    "check_missing_description": (lambda v: health.check_missing_description(v.P), with_views("P", J["check_missing_description"])),
    "check_stale_packs": (lambda v: health.check_stale_packs(v.P, AS_OF), with_views("P", J["check_stale_packs"])),
    "check_no_rules": (lambda v: health.check_no_rules(search.list_packs(v.P, v.F, v.RU)), with_views("F RU P", f"with {SIZES} {J['check_no_rules']}")),
    "check_secrets": (
        lambda v: health.check_secrets(audit.audit_findings(
            v.DX.select("owner_id", "pack", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), "text"))),
        with_views("DX", f"with {hits_cte('DX', chr(39) + 'd' + chr(39) + ' || doc_id as key, owner_id, pack')} {J['check_secrets']}")),
    "diagnose": (
        lambda v: health.diagnose(v.F, v.RU, v.P, AS_OF, v.RQ), with_views("F RU P RQ", f"with {ISSUES} select * from ISS")),
    "health_score": (
        lambda v: health.health_score(health.diagnose(v.F, v.RU, v.P, AS_OF, v.RQ), v.RQ),
        with_views("F RU P RQ", f"""with {ISSUES}, SCO as (select owner_id, count(*) filter (severity = 'warning') as warnings, count(*) filter (severity = 'info') as infos,
  bool_or(code = 'no_packs') as bare from ISS group by 1), S2 as (select distinct owner_id, coalesce(warnings, 0) as warnings, coalesce(infos, 0) as infos,
  case when bare then 0 else greatest(0, 100 - 10 * coalesce(warnings, 0) - 3 * coalesce(infos, 0)) end as score from RQ left join SCO using (owner_id))
 select *, score >= 80 as is_healthy, case when score >= 90 then 'excellent' when score >= 70 then 'good' when score >= 50 then 'needs attention' else 'needs work' end as band from S2""")),
}
