"""Registered queries: provisioning, repository inventory, incremental work, streaming."""

from pyspark.sql import functions as F

from factbase.functions.templates import TEMPLATES, TONES
from factbase.operators import incremental, provision, repo
from factbase.plans.catalog_chat import q, trim
from factbase.plans.catalog_docs import VIOLATIONS, scrub_sql
from factbase.plans.fixtures import AS_OF, with_views
from factbase.streaming import jobs, live

TS = f"timestamp '{AS_OF}'"
NAMES = [*TEMPLATES, "nope"]


def sql_list(values):
    return "[" + ", ".join("null" if x is None else q(x) for x in values) + "]"


def values(rows):
    return "(values " + ", ".join("(" + ", ".join(
        sql_list(x) if isinstance(x, list) else "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else q(x)
        for x in r) + ")" for r in rows) + ")"


# ---- inputs derived from the tables, in both dialects ----
def template_requests(v):
    names = F.array(*[F.lit(n) for n in NAMES], F.lit(None).cast("string"))
    e = F.col("event_id")
    return v.table("events").select(
        F.concat(F.lit("u"), "user_id").alias("owner_id"), e.alias("seq"), F.get(names, (e % 16).cast("int")).alias("template"),
        F.when((e % 16 == 15) | (e % 3 == 0), F.concat(F.lit("n"), (e % 9).cast("string"))).alias("pack_name"),
        F.when(e % 2 == 0, "work").alias("scope"))


def existing_packs(v):
    return v.table("events").select(F.concat(F.lit("u"), "user_id").alias("owner_id"),
                                    F.concat(F.lit("n"), (F.col("user_id") % 9).cast("string")).alias("pack")).distinct()


TR = f"""TQ as (select 'u' || user_id as owner_id, event_id as seq, ({sql_list([*NAMES, None])})[(event_id % 16) + 1] as template,
 case when event_id % 16 = 15 or event_id % 3 = 0 then 'n' || (event_id % 9) end as pack_name, case when event_id % 2 = 0 then 'work' end as scope from events),
EX as (select distinct 'u' || user_id as owner_id, 'n' || (user_id % 9) as pack, true as old from events),
TH as (select * from {values([(t, s, d) for t, (s, d, _, _) in TEMPLATES.items()])} t(template, t_scope, t_text)),
TK as (select TQ.*, coalesce(pack_name, TQ.template) as pack, t_scope, t_text from TQ left join TH using (template)),
TL as (select TK.*, case when old then 'exists' when template is not null and t_scope is null then 'unknown template' end as reason0 from TK left join EX using (owner_id, pack)),
TM as (select owner_id, pack, min(seq) as first from TL where reason0 is null group by all),
TZ as (select TL.*, coalesce(reason0, case when seq > first then 'exists' end) as reason from TL left join TM using (owner_id, pack)),
MADE as (select * from TZ where reason is null)"""
TFACTS = values([(t, i, k, [x] if isinstance(x, str) else x, not isinstance(x, str), kind)
                 for t, (_, _, fs, _) in TEMPLATES.items() for i, (k, kind, x) in enumerate(fs)])
TRULES = values([(t, i, text, p) for t, (_, _, _, rs) in TEMPLATES.items() for i, (p, text) in enumerate(rs)])


def answers(v):
    e = F.col("event_id")
    kinds = F.array(*[F.lit(k) for k in provision.QUESTIONS])
    texts = F.array(*[F.lit(x) for x in ANSWERS], F.lit(None).cast("string"))
    return v.table("events").select(
        F.concat(F.lit("u"), "user_id").alias("owner_id"), e.alias("seq"), F.get(kinds, (e % 5).cast("int")).alias("kind"),
        F.coalesce(F.get(texts, (e % 7).cast("int")), F.col("event_type")).alias("value"))


ANSWERS = ["skip", "2", "  1 ", "a, ,b c,", "", "3"]
AN = f"""AN0 as (select 'u' || user_id as owner_id, event_id as seq, ({sql_list(list(provision.QUESTIONS))})[(event_id % 5) + 1] as kind, coalesce(({sql_list([*ANSWERS, None])})[(event_id % 7) + 1], event_type) as value from events),
AN as (select owner_id, kind, {trim('min_by(value, seq)')} as value from AN0 group by owner_id, kind),
GI as (select * from AN where value <> '' and lower(value) <> 'skip'),
TO1 as (select * from {values([(n, t) for n, (t, _) in TONES.items()])} t(value, tone)),
AF as (select owner_id, d.pack, d.pos, d.key, case when kind = 'tone' then coalesce(tone, value) else value end as value, d.type from GI join {values([(k, *x) for k, x in provision.QUESTIONS.items() if x[2]])} d(kind, pos, pack, key, type) using (kind) left join TO1 using (value)),
AR as (select owner_id, 'writer' as pack, r.pos, r.instruction, r.priority from GI join {values([(n, i, text, p) for n, (_, rs) in TONES.items() for i, (p, text) in enumerate(rs)])} r(value, pos, instruction, priority) using (value) where kind = 'tone'
 union all select owner_id, 'writer', i + 10, l[i + 1], 7 from (select owner_id, l, unnest(range(len(l))) as i from (select owner_id, list_filter(list_transform(string_split(value, ','), lambda x: {trim('x')}), lambda x: x <> '') as l from GI where kind = 'rules')))"""


def observations(v):
    e = F.col("event_id")
    kinds = [*repo.INVENTORY, *repo.SINGLES]
    slot = F.floor(e / 8)
    name = F.lit(None).cast("string")
    for k, names in repo.INVENTORY.items():
        name = F.when(F.col("kind") == k, F.get(F.array(*[F.lit(n) for n in names]), (slot % len(names)).cast("int"))).otherwise(name)
    name = F.when(F.col("kind") == "shell", F.concat(F.lit("/bin/"), "event_type")).when(
        F.col("kind").isin("git_name", "git_email", "os"), F.col("event_type")).otherwise(name)
    return (v.table("events").withColumn("kind", F.get(F.array(*[F.lit(k) for k in kinds]), (e % 8).cast("int")))
            .select(F.concat(F.lit("u"), "user_id").alias("owner_id"), "kind", name.alias("name")))


def _pick_sql():
    return " ".join(f"when '{k}' then ({sql_list(n)})[((event_id // 8) % {len(n)}) + 1]" for k, n in repo.INVENTORY.items())


OB = f"""OB as (select 'u' || user_id as owner_id, kind, case kind {_pick_sql()} when 'shell' then '/bin/' || event_type else event_type end as name
  from (select *, ({sql_list([*repo.INVENTORY, *repo.SINGLES])})[(event_id % 8) + 1] as kind from events)),
SE as (select distinct owner_id, kind, name, rank from OB join {values([(k, n, i) for k, ns in repo.INVENTORY.items() for i, n in enumerate(ns)])} w(kind, name, rank) using (kind, name))"""
_single = " union all ".join(
    f"select owner_id, {pos}, {q(key)}, {'list_last(string_split(min(name), chr(47)))' if k == 'shell' else 'min(name)'}, false, {q(ty)}, 'high', {q(src)} from OB where kind = '{k}' and name <> '' group by 1"
    for k, (pos, key, ty, src) in repo.SINGLES.items())
_lists = " union all ".join(
    f"select owner_id, {pos}, {q(key)}, string_agg(name, '|' order by rank), true, {q(ty)}, 'high', {q(src)} from SE where kind = '{k}' group by 1{' having count(*) > 1' if k == 'editor' else ''}"
    for k, (pos, key, ty, src) in repo.LISTS.items())
INV = f"{OB}, INV as (select owner_id, 2 as pos, 'editor' as key, min_by(name, rank) as value, false as value_is_list, 'preference' as type, 'medium' as confidence, 'tool-scan' as source from SE where kind = 'editor' group by 1 union all {_lists} union all {_single})"

ROOT = "/home/u"


def roots(v):
    return v.FI.select("owner_id", F.lit(ROOT).alias("root")).distinct()


def pack_roots(v):
    return v.FI.select("owner_id", F.regexp_extract("path", r"^(/home/u/[^/]+)/", 1).alias("root")).distinct()


def has_any(x, parts):
    return "(" + " or ".join(f"contains({x}, '{p}')" for p in parts) + ")"


RE = f"""RE as (select owner_id, rp as repo, list_last(string_split(rp, '/')) as name, mtime, row_number() over (partition by owner_id order by mtime desc, depth, rp) as rank
 from (select owner_id, mtime, regexp_replace(path, '/\\.git$', '') as rp, case when regexp_matches(path, '^{ROOT}/[^/]+/\\.git$') then 0 else 1 end as depth from FI where regexp_matches(path, '^{ROOT}/[^/]+(/[^/]+)?/\\.git$'))
 where not {has_any('rp', repo.REPO_SKIP)} )"""
_ext = values(list(repo.EXTENSIONS.items()))
LG = f"""LG as (select f.owner_id, repo, language, count(*) as files from FI f join RE r on f.owner_id = r.owner_id and starts_with(f.path, r.repo || '/')
 join {_ext} x(ext, language) on regexp_extract(list_last(string_split(f.path, '/')), '^.+(\\.[^.]+)$', 1) = ext where not {has_any('f.path', repo.FILE_SKIP)} group by all)"""
_js = values(list(repo.JS_PACKAGES.items()) + [("typescript", "TypeScript")])
_py = values(list(repo.PY_PACKAGES.items()))
FW = f"""TP0 as (select f.owner_id, regexp_extract(path, '^(.*)/[^/]+$', 1) as repo, list_last(string_split(path, '/')) as manifest, content from FI f),
TP1 as (select TP0.* from TP0 semi join RE using (owner_id, repo)),
FW as (select distinct owner_id, repo, manifest, fw as framework from (select *, list_concat(json_keys(content, '$.dependencies'), json_keys(content, '$.devDependencies')) as ks from TP1 where manifest = 'package.json' and json_valid(content)) join {_js} j(dep, fw) on list_contains(ks, dep)
 union all select owner_id, repo, manifest, fw from TP1 join {_py} p(dep, fw) on contains(lower(content), dep) where manifest in ('requirements.txt','Pipfile','pyproject.toml')
 union all select owner_id, repo, manifest, 'Rails' from TP1 where manifest = 'Gemfile' and contains(lower(content), 'rails') union all select owner_id, repo, manifest, 'Sinatra' from TP1 where manifest = 'Gemfile' and contains(lower(content), 'sinatra')
 union all select owner_id, repo, manifest, 'Rust' from TP1 where manifest = 'Cargo.toml' union all select owner_id, repo, manifest, 'Go' from TP1 where manifest = 'go.mod')"""
OS = f"""{RE}, {LG}, {FW},
OL as (select owner_id, language as x, row_number() over (partition by owner_id order by sum(files) desc, min(rank), language) as r from LG join RE using (owner_id, repo) group by owner_id, language qualify r <= 5),
OW as (select owner_id, framework as x, row_number() over (partition by owner_id order by count(*) desc, framework) as r from FW group by owner_id, framework qualify r <= 10),
OSK as (select owner_id, 7 as pos, 'languages.primary' as key, string_agg(x, '|' order by r) as value, true as value_is_list, 'skill' as type, 'high' as confidence, 'repo-scan' as source from OL group by 1
 union all select owner_id, 8, 'frameworks', string_agg(x, '|' order by r), true, 'skill', 'high', 'repo-scan' from OW group by 1
 union all select owner_id, 9, 'projects.recent', string_agg(name, '|' order by rank), true, 'context', 'medium', 'repo-scan' from RE where rank <= 8 group by 1)"""
RF = """RF as (select owner_id, o + 10 as pos, 'existing_rules.' || l as key, 'Found in ' || list_last(string_split(dir, '/')) || ': ' || content as value, false as value_is_list, 'context' as type, 'high' as confidence, 'file-scan-' || l as source
 from (select f.*, regexp_extract(path, '^(.*)/[^/]+$', 1) as dir, o, l from FI f join (values ('.cursorrules', 0, 'cursorrules'), ('AGENTS.md', 1, 'agents-md'), ('.editorconfig', 2, 'editorconfig')) t(n, o, l) on list_last(string_split(path, '/')) = n)
 where regexp_matches(dir, '^/home/u/[^/]+/[^/]+$') qualify row_number() over (partition by owner_id, dir order by o) = 1)"""


def flat(df):
    return df.withColumn("value", F.array_join("value_items", "|")).drop("value_items")


def _scan(v):
    return repo.scan_to_packs([repo.owner_stack(v.FI, roots(v)), repo.existing_rule_files(v.FI, pack_roots(v)),
                               repo.inventory_to_facts(observations(v))])


def sources(v):
    return v.table("documents").select(F.col("lang").alias("owner_id"), F.col("doc_id").cast("string").alias("source_key"), F.col("text").alias("content"))


def cache(v):
    """A cache from an earlier run that knew the labelled documents only; every fifth hash is out of date."""
    old = v.table("documents").join(v.table("labels").select("doc_id"), "doc_id", "left_semi")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return old.select(F.col("lang").alias("owner_id"), F.col("doc_id").cast("string").alias("source_key"), F.sha2(text, 256).alias("hash"),
                      F.expr("timestamp_ntz '2024-01-01 00:00:00'").alias("scanned_at"),
                      F.expr("timestamp_ntz '2024-01-03 00:00:00'").alias("last_full_scan"))


HC = """CU as (select lang as owner_id, cast(doc_id as varchar) as source_key, sha256(text) as hash from documents),
CC as (select lang as owner_id, cast(doc_id as varchar) as source_key, sha256(case when doc_id % 5 = 0 then text || '!' else text end) as hash, timestamp '2024-01-01 00:00:00' as scanned_at, timestamp '2024-01-03 00:00:00' as last_full_scan from documents semi join labels using (doc_id)),
CG as (select owner_id, source_key, CU.hash, CU.hash is null or CC.hash is null or CU.hash <> CC.hash as changed from CU left join CC using (owner_id, source_key)),
UC as (select owner_id, source_key, coalesce(CU.hash, CC.hash) as hash, case when CU.hash is not null then {ts} else scanned_at end as scanned_at, {ts} as last_full_scan from CC full join CU using (owner_id, source_key))""".format(ts=TS)


def snapshot(v, shift):
    d = F.col("doc_id")
    return v.table("documents").select(
        F.lit("o").alias("owner_id"), F.concat(F.lit("d"), (d + shift).cast("string"), F.when(d % 4 == shift % 4, ".txt").otherwise(".yaml")).alias("path"),
        (F.col("n_chars") % 3).alias("mtime"))


def _snap_sql(shift):
    return f"select 'o' as owner_id, 'd' || (doc_id + {shift}) || case when doc_id % 4 = {shift % 4} then '.txt' else '.yaml' end as path, n_chars % 3 as mtime from documents"


SN = f"""B as (select * from ({_snap_sql(0)}) where path like '%.yaml'), A as (select * from ({_snap_sql(40)}) where path like '%.yaml')
select owner_id, path, case when b.mtime is null then 'created' when a.mtime is null then 'deleted' else 'modified' end as change from B b full join A a using (owner_id, path) where a.mtime is distinct from b.mtime"""


def _events_stream(v):
    """The access log replayed as a stream: same columns as the batch view U."""
    return _from_events(jobs.stream_table(v.spark, v.dir, "events.parquet"))


def _from_events(stream):
    e = F.col("event_id")
    arr = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), (e % n).cast("int"))
    return stream.select(
        "event_id", arr(["en", "fr", "de", "es"], 4).alias("owner_id"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("pack"),
        F.when(e % 7 != 3, F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("int") % 25).cast("string"))).alias("key"),
        F.col("ts").cast("timestamp").alias("ts"), arr(["claude", "cursor", "chatgpt", "gemini", "myapp"], 5).alias("agent"))


def _usage_stream(v):
    out = jobs.new_output(v.spark, "usage")
    jobs.usage_counters(_events_stream(v), out).awaitTermination()
    return jobs.read_usage_counters(v.spark, out).withColumn("last_called", F.col("last_called").cast("timestamp_ntz"))


def _debounce_stream(v):
    out = jobs.new_output(v.spark, "bursts")
    jobs.debounced_stream(_events_stream(v).select("owner_id", "ts"), out).awaitTermination()
    return jobs.read_debounced(v.spark, out)


def _live_events(v, out):
    """The access log in four files of its own, streamed one file at a time; their order is not that of the events."""
    path = f"{out}/log"
    table = v.table("events")
    table.repartition(4, "event_id").write.parquet(path)
    return _from_events(v.spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path))


def _live_usage(v):
    out = jobs.new_output(v.spark, "live-usage")
    live.live_usage(_live_events(v, out), f"{out}/counters", every=3).awaitTermination()
    return live.read_live_usage(v.spark, f"{out}/counters").withColumn("last_called", F.col("last_called").cast("timestamp_ntz"))


def _live_bursts(v):
    out = jobs.new_output(v.spark, "live-bursts")
    live.live_bursts(_live_events(v, out), f"{out}/bursts", every=3).awaitTermination()
    return live.read_live_bursts(v.spark, f"{out}/bursts")


def _by_file(v):
    """Each document is a file of its own, so the work is in the files and not in the bytes: by number of tasks, since
    small tasks that are merged would write all files one after another."""
    return v.RP.repartition(int(v.spark.conf.get("spark.sql.shuffle.partitions")), "file")


def _watch(v):
    """Packs written by Spark, one folder each, in three thirds that are watched by one query, restarted for each look:
    all are new; then one third is gone and one rewritten with text after the document; then nothing changes; then the third
    that was gone is back."""
    base = jobs.new_output(v.spark, "watched")
    number = F.regexp_extract("file", "([0-9]+)", 1).cast("int")
    docs = _by_file(v).select("file", "doc", (number % 3).alias("third"))

    def write(third, value):
        (docs.where(F.col("third") == third).select("file", value.alias("value")).write.mode("overwrite").option("lineSep", " ")
         .partitionBy("file").text(f"{base}/in/third={third}"))

    def watch():
        live.watch_packs(v.spark, f"{base}/in", f"{base}/out", "part-*", "folder", availableNow=True).awaitTermination()

    for third in range(3):
        write(third, F.col("doc"))
    watch()
    live.delete_folder(v.spark, f"{base}/in/third=0")
    write(1, F.concat("doc", F.lit(" {}")))
    watch()
    watch()
    write(0, F.col("doc"))
    watch()
    rows = v.spark.read.parquet(f"{base}/out/rows").groupBy("run", "change").agg(F.count(F.lit(1)).alias("n"), F.sum("errors").alias("errors"))
    kept = jobs.latest_packs(v.spark, f"{base}/out").agg(F.count(F.lit(1)).alias("n"), F.sum("errors").alias("errors"))
    return rows.select(F.col("run").cast("int").alias("look"), "change", "n", "errors").union(kept.select(F.lit(5), F.lit("kept"), "n", "errors"))


def _scrub_stream(v):
    out = jobs.new_output(v.spark, "scrubbed")
    docs = jobs.stream_table(v.spark, v.dir, "documents.parquet").select("doc_id", "text")
    jobs.run_to_end(jobs.scrub_stream(docs), out)
    return v.spark.read.parquet(f"{out}/rows").select("doc_id", "text")


def _pack_stream(v):
    """Pack documents written by Spark as one file each, then watched: all created, then a third deleted and the
    others rewritten, half of them with text after the document."""
    base = jobs.new_output(v.spark, "packs")
    number = F.regexp_extract("file", "([0-9]+)", 1).cast("int")
    docs = _by_file(v).select("file", "doc", number.alias("n"))

    def write(rows, value):
        (rows.select("file", value.alias("value")).write.mode("overwrite").option("lineSep", " ")
         .partitionBy("file").text(f"{base}/in"))

    write(docs, F.col("doc"))
    packs = _watched(v.spark, base, 1)
    first = packs.groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.sum("errors").alias("errors"))
    write(docs.where("n % 3 != 0"), F.when(F.col("n") % 2 == 0, F.concat("doc", F.lit(" {}"))).otherwise(F.col("doc")))
    packs = _watched(v.spark, base, 2)
    second = packs.groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.sum("errors").alias("errors"))
    now = jobs.latest_packs(v.spark, f"{base}/out").agg(F.count(F.lit(1)).alias("n"), F.sum("errors").alias("errors"))
    return (first.select(F.lit(1).alias("look"), "change", "n", "errors").union(second.select(F.lit(2), "change", "n", "errors"))
            .union(now.select(F.lit(3), F.lit("kept"), "n", "errors")))


def _watched(spark, base, run):
    """The parts that Spark writes have other names than *.json, and new ones each time; they are looked at by folder."""
    files = spark.read.option("wholetext", "true").text(f"{base}/in").select(
        F.lit("me").alias("owner_id"), F.concat("file", F.lit("")).alias("path"), F.col("value").alias("doc"),
        F.lit(run).cast("string").alias("mtime"))
    return jobs.record_changes(files, f"{base}/out", run)


DBI = """DB as (select owner_id, ts, case when ts - lag(ts) over w > interval 500 millisecond or lag(ts) over w is null then 1 else 0 end as s from U window w as (partition by owner_id order by ts)),
DI as (select owner_id, ts, sum(s) over (partition by owner_id order by ts rows unbounded preceding) as g from DB)"""
BURSTS = "select owner_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as changes from DI group by owner_id, g"
DB = f"{DBI} {BURSTS}"

tags = lambda df: df.withColumn("tags", F.array_join("tags", ","))

QUERIES = {
    "instantiate_templates": (
        lambda v: tags(provision.instantiate_templates(template_requests(v), existing_packs(v))["packs"]),
        f"with {TR} select owner_id, pack, case when template is null then coalesce(scope, 'general') else t_scope end as scope, case when template is null then 'Context pack: ' || pack else t_text end as description, case when template is null then '' else template || ',template' end as tags from MADE"),
    "template_facts": (
        lambda v: flat(provision.instantiate_templates(template_requests(v), existing_packs(v))["facts"]),
        f"with {TR} select owner_id, pack, f.pos, key, array_to_string(v, '|') as value, l as value_is_list, type, 'high' as confidence, 'template' as source from MADE join {TFACTS} f(template, pos, key, v, l, type) using (template)"),
    "template_rules": (
        lambda v: provision.instantiate_templates(template_requests(v), existing_packs(v))["rules"],
        f"with {TR} select owner_id, pack, r.pos, instruction, priority from MADE join {TRULES} r(template, pos, instruction, priority) using (template)"),
    "rejected_templates": (
        lambda v: provision.instantiate_templates(template_requests(v), existing_packs(v))["rejected"],
        f"with {TR} select owner_id, seq, template, pack, reason from TZ where reason is not null"),
    "answers_to_packs": (
        lambda v: tags(provision.answers_to_packs(answers(v))["packs"]),
        f"with {AN} select distinct owner_id, pack, scope, description, 'onboard,personal' as tags from (select owner_id, pack from AF union all select owner_id, pack from AR) join {values([(n, *x) for n, x in provision.PACKS.items()])} h(pack, scope, description) using (pack)"),
    "answers_to_facts": (
        lambda v: flat(provision.answers_to_packs(answers(v))["facts"]),
        f"with {AN} select owner_id, pack, pos, key, value, false as value_is_list, type, 'high' as confidence, 'onboard' as source from AF"),
    "answers_to_rules": (lambda v: provision.answers_to_packs(answers(v))["rules"], f"with {AN} select * from AR"),
    "discover_repos": (
        lambda v: repo.discover_repos(v.FI, roots(v)).withColumn("rank", F.col("rank").cast("bigint")),
        with_views("FI", f"with {RE} select * from RE")),
    "repo_languages": (
        lambda v: repo.repo_languages(v.FI, repo.discover_repos(v.FI, roots(v))), with_views("FI", f"with {RE}, {LG} select * from LG")),
    "repo_frameworks": (
        lambda v: repo.repo_frameworks(v.FI, repo.discover_repos(v.FI, roots(v))), with_views("FI", f"with {RE}, {FW} select * from FW")),
    "owner_stack": (lambda v: flat(repo.owner_stack(v.FI, roots(v))), with_views("FI", f"with {OS} select * from OSK")),
    "existing_rule_files": (lambda v: flat(repo.existing_rule_files(v.FI, pack_roots(v))), with_views("FI", f"with {RF} select * from RF")),
    "inventory_to_facts": (lambda v: flat(repo.inventory_to_facts(observations(v))), f"with {INV} select * from INV"),
    "scan_to_packs": (
        lambda v: flat(_scan(v)),
        with_views("FI", f"with {OS}, {RF}, {INV} select *, 'scanned' as pack from OSK union all select *, 'scanned' from RF union all select *, 'scanned' from INV")),
    "scan_carry_forward": (
        lambda v: flat(repo.scan_to_packs([repo.owner_stack(v.FI, roots(v)), repo.inventory_to_facts(observations(v))], previous=_scan(v))),
        with_views("FI", f"with {OS}, {RF}, {INV} select *, 'scanned' as pack from OSK union all select *, 'scanned' from RF union all select *, 'scanned' from INV")),
    "scanned_packs": (
        lambda v: tags(repo.scanned_packs(_scan(v), AS_OF)),
        with_views("FI", f"with {OS}, {RF}, {INV}, SC as (select owner_id, key, value from OSK union all select owner_id, key, value from RF union all select owner_id, key, value from INV) select owner_id, 'scanned' as pack, 'development' as scope, 'Auto-scanned on 2024-02-01' as description, concat_ws(',', 'scanned', 'auto', max(lower(value)) filter (key = 'system.os')) as tags from SC group by 1")),
    "content_hashes": (lambda v: incremental.content_hashes(sources(v)), f"with {HC} select * from CU"),
    "changed_sources": (
        lambda v: incremental.changed_sources(incremental.content_hashes(sources(v)), cache(v)), f"with {HC} select * from CG"),
    "change_summary": (
        lambda v: incremental.change_summary(incremental.changed_sources(incremental.content_hashes(sources(v)), cache(v))),
        f"with {HC} select owner_id, count(*) filter (changed) as changed, count(*) filter (not changed) as skipped from CG group by 1"),
    "update_hash_cache": (
        lambda v: incremental.update_hash_cache(cache(v), incremental.content_hashes(sources(v)), AS_OF), f"with {HC} select * from UC"),
    "hash_cache_stats": (
        lambda v: incremental.hash_cache_stats(cache(v)), f"with {HC} select owner_id, count(*) as entries, max(last_full_scan) as last_scan from CC group by 1"),
    "snapshot_changes": (lambda v: incremental.snapshot_changes(snapshot(v, 0), snapshot(v, 40)), f"with {SN}"),
    "stream_usage_counters": (
        _usage_stream, with_views("U", "select owner_id, pack, key, agent, count(*) as calls, max(ts) as last_called from U where key is not null group by all")),
    "stream_pack_changes": (
        _pack_stream, with_views("RP", f"""with {VIOLATIONS}, PE as (select file, cast(regexp_extract(file, '([0-9]+)', 1) as int) as n, count(code) as errors from RP left join VI using (file) group by all),
 NE as (select file, n, case when n % 2 = 0 then 1 else errors end as errors from PE where n % 3 <> 0)
 select 1 as look, 'created' as change, count(*) as n, cast(sum(errors) as bigint) as errors from PE union all select 2, 'modified', count(*), cast(sum(errors) as bigint) from NE
 union all select 2, 'deleted', count(*), null from PE where n % 3 = 0 union all select 3, 'kept', count(*), cast(sum(errors) as bigint) from NE""")),
    "debounced_reloads": (lambda v: jobs.debounced_reloads(v.U), with_views("U", "with " + DB)),
    "debounced_by_minute": (lambda v: jobs.debounced_reloads(v.U, "minute"), with_views("U", "with " + DB)),
    "stream_debounced": (_debounce_stream, with_views("U", "with " + DB)),
    "live_usage_counters": (
        _live_usage, with_views("U", "select owner_id, pack, key, agent, count(*) as calls, max(ts) as last_called from U where key is not null group by all")),
    "live_bursts": (_live_bursts, with_views("U", f"""with {DBI}, DG as ({BURSTS})
 select *, (select max(ts) from U) - last_ts > interval 500 millisecond as closed from DG""")),
    "watched_packs": (
        _watch, with_views("RP", f"""with {VIOLATIONS}, PE as (select file, cast(regexp_extract(file, '([0-9]+)', 1) as int) % 3 as third, count(code) as errors from RP left join VI using (file) group by all)
 select 1 as look, 'created' as change, count(*) as n, cast(sum(errors) as bigint) as errors from PE union all select 2, 'deleted', count(*), null from PE where third = 0
 union all select 2, 'modified', count(*), count(*) from PE where third = 1 union all select 4, 'created', count(*), cast(sum(errors) as bigint) from PE where third = 0
 union all select 5, 'kept', count(*), cast(sum(case when third = 1 then 1 else errors end) as bigint) from PE""")),
    "stream_scrub": (_scrub_stream, f"select doc_id, {scrub_sql('text')} as text from documents"),
}
