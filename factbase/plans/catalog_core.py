"""Registered queries: usage, freshness, decay."""

from pyspark.sql import functions as F

from factbase.operators import decay, freshness, usage
from factbase.plans.fixtures import AS_OF, Views, with_views

TS = f"timestamp '{AS_OF}'"
VT = "array_to_string(value_items, ', ')"
UF = "UF as (select owner_id, pack, key, count(*) as calls, max(ts) as last_called from U where key is not null group by all)"
SCORE = """round(least(100e0, greatest(0e0,
 (case when coalesce(u.calls,0) > 0 then least(100e0, log10(u.calls + 1) / log10(1001e0) * 100e0) else 0e0 end) * 0.4e0
 + {fresh} * 0.4e0 + (case f.confidence when 'medium' then 0.66e0 when 'low' then 0.33e0 else 1e0 end) * 100e0 * 0.2e0)), 2)"""
SC = ("SC as (select f.*, coalesce(u.calls, 0) as calls, " + SCORE.format(fresh="100e0")
      + " as score from F f left join UF u using (owner_id, pack, key))")
RK = "RK as (select *, row_number() over (partition by owner_id, pack order by score desc, pos) as rank from SC)"


def duck_age(ts: str, as_of: str = TS) -> str:
    return f"cast(floor((epoch_us({as_of}) - epoch_us({ts})) / 86400000000.0) as bigint)"


def fresh_cte(ref: str = "coalesce(f.updated_at, p.updated_at)") -> str:
    ttl = ("(case f.type when 'skill' then 365 when 'preference' then 180 when 'style' then 180 "
           "when 'constraint' then 120 else 90 end) * (case f.confidence when 'medium' then 0.66e0 when 'low' then 0.33e0 else 1e0 end)")
    return f"""FR as (select *, case when freshness >= 90 then 'fresh' when freshness >= 60 then 'current' when freshness >= 30 then 'aging'
   when freshness > 0 then 'stale' else 'expired' end as label from (
 select f.*, case when f.type = 'identity' then 100 when {ref} is null then 50 else
  greatest(0, least(100, cast(trunc(100e0 * (1e0 - greatest(0, {duck_age(ref)}) / ({ttl}))) as bigint))) end as freshness
 from F f left join P p using (owner_id, pack)))"""


PF = """PF as (select p.owner_id, p.pack, count(f.pos) as total,
 case when count(f.pos) = 0 then 100 else cast(floor(sum(f.freshness) / count(f.pos)) as bigint) end as score,
 count(*) filter (f.freshness >= 90) as fresh, count(*) filter (f.freshness >= 60 and f.freshness < 90) as current,
 count(*) filter (f.freshness >= 30 and f.freshness < 60) as aging, count(*) filter (f.freshness > 0 and f.freshness < 30) as stale
 from P p left join FR f using (owner_id, pack) group by all)"""
OF = "OFR as (select owner_id, cast(floor(sum(score) / count(*)) as bigint) as freshness from PF group by all)"

TTL = """case when type = 'identity' then null else cast(floor(
 (case type when 'skill' then 180 when 'preference' then 120 when 'style' then 150 else 90 end)
 * (case when source like '%-import' then 0.66e0 else 1e0 end)
 * (case confidence when 'low' then 0.5e0 when 'medium' then 0.75e0 else 1e0 end)) as bigint) end"""
DS = f"""DS0 as (select f.*, {TTL.replace("source", "f.source")} as ttl_days, {duck_age(f"coalesce(f.updated_at, p.created_at, {TS})")} as age_days
 from F f left join P p using (owner_id, pack)),
DS as (select *, ttl_days - age_days as remaining_days, case when ttl_days - age_days <= 0 then 'expired'
 when ttl_days - age_days <= 14 then 'warning' else 'preserved' end as status from DS0)"""


def _scored(v: Views):
    return usage.priority_scores(v.F, usage.usage_by_fact(v.U))


def _settings(v: Views):
    return v.P.select("owner_id", (F.col("owner_id") != "de").alias("track_usage")).distinct()


QUERIES = {
    "usage_by_fact": (
        lambda v: usage.usage_by_fact(v.U),
        with_views("U", """select owner_id, pack, key, cast(sum(calls) as bigint) as calls, max(last_called) as last_called, count(*) as n_agents,
 max_by(agent, row(calls, agent)) as top_agent from (select owner_id, pack, key, agent, count(*) as calls, max(ts) as last_called from U where key is not null group by all) group by owner_id, pack, key""")),
    "usage_by_fact_agents": (
        lambda v: usage.usage_by_agent(v.U, usage.FACT),
        with_views("U", "select owner_id, pack, key, agent, count(*) as calls, max(ts) as last_called from U where key is not null group by all")),
    "usage_by_pack": (
        lambda v: usage.usage_by_pack(v.U),
        with_views("U", """select owner_id, pack, cast(sum(calls) as bigint) as calls, max(last_called) as last_called, count(*) as n_agents,
 max_by(agent, row(calls, agent)) as top_agent from (select owner_id, pack, agent, count(*) as calls, max(ts) as last_called from U where key is null group by all) group by owner_id, pack""")),
    "usage_by_pack_agents": (
        lambda v: usage.usage_by_agent(v.U, usage.PACK),
        with_views("U", "select owner_id, pack, agent, count(*) as calls, max(ts) as last_called from U where key is null group by all")),
    "usage_stats": (
        lambda v: usage.usage_stats(v.U),
        with_views("U", f"""with {UF} select owner_id, 'fact' as kind, pack, key, calls, last_called from UF
 qualify row_number() over (partition by owner_id order by calls desc, pack, key) <= 20
 union all select owner_id, 'pack', pack, null, count(*), max(ts) from U where key is null group by owner_id, pack""")),
    "reset_usage": (
        lambda v: usage.reset_usage(v.U, "src3")[1].join(
            usage.reset_usage(v.U, "src3")[0].groupBy("owner_id").agg(F.count(F.lit(1)).alias("kept_rows")), "owner_id", "full"),
        with_views("U", """select owner_id, cleared, kept_rows from (select owner_id, count(distinct key) + max(cast(key is null as int)) as cleared from U where pack = 'src3' group by 1) a
 full join (select owner_id, count(*) as kept_rows from U where pack <> 'src3' group by 1) b using (owner_id)""")),
    "drop_opted_out": (
        lambda v: usage.drop_opted_out(v.U, _settings(v)),
        with_views("U", "select * from U where owner_id <> 'de'")),
    "priority_scores": (
        lambda v: _scored(v).select("owner_id", "pack", "pos", "key", "calls", "score"),
        with_views("F U", f"with {UF}, {SC} select owner_id, pack, pos, key, calls, score from SC")),
    "priority_scores_fresh": (
        lambda v: usage.priority_scores(freshness.fact_freshness(v.F, v.P, AS_OF), usage.usage_by_fact(v.U),
                                        F.col("freshness")).select("owner_id", "pack", "pos", "calls", "freshness", "score"),
        with_views("F U P", f"with {UF}, {fresh_cte()} select owner_id, pack, pos, coalesce(u.calls, 0) as calls, f.freshness, "
                   + SCORE.format(fresh="f.freshness") + " as score from FR f left join UF u using (owner_id, pack, key)")),
    "rank_facts": (
        lambda v: usage.rank_facts(_scored(v)).select("owner_id", "pack", "pos", "key", "score", "rank"),
        with_views("F U", f"with {UF}, {SC}, {RK} select owner_id, pack, pos, key, score, rank from RK")),
    "high_priority_facts": (
        lambda v: usage.high_priority_facts(_scored(v)).select("owner_id", "pack", "pos", "key", "score"),
        with_views("F U", f"with {UF}, {SC} select owner_id, pack, pos, key, score from SC where score >= 70")),
    "fact_freshness": (
        lambda v: freshness.fact_freshness(v.F, v.P, AS_OF).select("owner_id", "pack", "pos", "type", "freshness", "label"),
        with_views("F P", f"with {fresh_cte()} select owner_id, pack, pos, type, freshness, label from FR")),
    "fact_freshness_by_pack_date": (
        lambda v: freshness.fact_freshness(v.F, v.P, AS_OF, basis="pack").select("owner_id", "pack", "pos", "type", "freshness", "label"),
        with_views("F P", f"with {fresh_cte('p.updated_at')} select owner_id, pack, pos, type, freshness, label from FR")),
    "pack_freshness": (
        lambda v: freshness.pack_freshness(v.F, v.P, AS_OF),
        with_views("F P", f"with {fresh_cte()}, {PF} select owner_id, pack, score from PF")),
    "pack_freshness_summary": (
        lambda v: freshness.pack_freshness_summary(v.F, v.P, AS_OF),
        with_views("F P", f"with {fresh_cte()}, {PF} select * from PF")),
    "owner_freshness": (
        lambda v: freshness.owner_freshness(v.F, v.P, AS_OF, v.RQ),
        with_views("F P RQ", f"""with {fresh_cte()}, {PF}, {OF} select distinct owner_id, coalesce(freshness, 100) as freshness
 from RQ left join OFR using (owner_id)""")),
    "fact_ttl": (
        lambda v: decay.fact_ttl(v.F).select("owner_id", "pack", "pos", "type", "ttl_days"),
        with_views("F", f"select owner_id, pack, pos, type, {TTL} as ttl_days from F")),
    "decay_status": (
        lambda v: decay.decay_report(v.F, v.P, AS_OF).select(
            "owner_id", "pack", "pos", "key", "value", "ttl_days", "age_days", "remaining_days", "status"),
        with_views("F P", f"with {DS} select owner_id, pack, pos, key, {VT} as value, ttl_days, age_days, remaining_days, status from DS where status <> 'preserved'")),
    "decay_summary": (
        lambda v: decay.decay_summary(v.F, v.P, AS_OF),
        with_views("F P", f"""with {DS} select owner_id, count(*) as checked, count(*) filter (status = 'expired') as expired,
 count(*) filter (status = 'warning') as warning, count(*) filter (status <> 'expired') as preserved from DS group by 1""")),
    "apply_decay": (
        lambda v: decay.apply_decay(v.F, v.P, AS_OF).select("owner_id", "pack", "pos", "key", "type"),
        with_views("F P", f"with {DS} select owner_id, pack, pos, key, type from DS where status <> 'expired'")),
    "refresh_facts": (
        lambda v: decay.refresh_facts(v.F, v.U, AS_OF).select("owner_id", "pack", "pos", "key", "updated_at", "refreshed"),
        with_views("F U", f"""with W as (select distinct owner_id, pack, key from U),
 FI1 as (select owner_id, pack, key, min(pos) as pos, true as hit from F semi join W using (owner_id, pack, key) group by all)
 select owner_id, pack, pos, key, case when hit then {TS} else updated_at end as updated_at, coalesce(hit, false) as refreshed
 from F left join FI1 using (owner_id, pack, key, pos)""")),
}
