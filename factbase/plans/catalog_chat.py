"""Registered queries: chat imports and extraction."""

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from factbase.operators import chat, extract
from factbase.plans.fixtures import with_views
from factbase.sources import chats, split_exports
from factbase.streaming.jobs import new_output

W = r"[\p{L}\p{N}_]"
B = r"(?:^|[^\p{L}\p{N}_])"
TRIM = r"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def trim(x):
    return TRIM.format(x=x)


def q(text):
    return "'" + text.replace("'", "''") + "'"


def regex_hits(patterns, cond):
    arms = [f"select owner_id, conv_id, pos, {n} as n, regexp_extract_all(text, {q(p)}, 1) as l from M" for n, p in enumerate(patterns)]
    return (f"HI as (select owner_id, hit, row(conv_id, pos, n, i) as spot from (select *, {trim('l[i + 1]')} as hit from (select *, unnest(range(len(l))) as i from ({' union all '.join(arms)}))) where {cond})")


def word_hits(words):
    vals = ", ".join(f"({i}, {q(name)}, {q(w.lower())})" for i, (name, ws) in enumerate(words.items()) for w in ws)
    return (f"WD as (select * from (values {vals}) t(n, name, w)), HI as (select distinct owner_id, name as hit, row(conv_id, pos, n, 0) as spot from M join WD on contains(lower(text), w))")


def top(k, least=1):
    return (f"TP as (select * from (select owner_id, hit, count(*) as n, row_number() over (partition by owner_id order by count(*) desc, min(spot)) as rank from HI group by owner_id, hit) where rank <= {k} and n >= {least})")


def listed(pos, key, type_, conf, src, frm="TP"):
    return (f"select owner_id, {pos} as pos, {q(key)} as key, string_agg(hit, '|' order by rank) as value, true as value_is_list, {q(type_)} as type, {q(conf)} as confidence, {q(src)} as source from {frm} group by owner_id")


TREE, FLAT = chat.TREE_SOURCE, chat.FLAT_SOURCE
L1 = r"(?i)" + B + r"(?:I (?:use|code in|write|program in|work with))\s+(" + W + "+)"
L2 = r"(?i)" + B + r"(?:in|using|with)\s+(Python|TypeScript|JavaScript|Rust|Go|Java|C\+\+|Ruby|PHP|Swift|Kotlin)\b"
LANGS = ", ".join(q(x) for x in chat.LANGUAGES)
D_LANG = f"{regex_hits([L1, L2], f'lower(hit) in ({LANGS})')}, {top(5)} {listed(0, 'languages.detected', 'skill', 'medium', TREE)}"
D_FRAME = f"{word_hits({w: [w] for w in chat.FRAMEWORKS})}, {top(8, 2)} {listed(1, 'frameworks.detected', 'skill', 'medium', TREE)}"
PREF = r"(?i)I (?:prefer|like|want|always use) ([\p{L}\p{N}_\s]+?)(?:\.|,|$|because|over)"
D_PREF = (f"{regex_hits([PREF], 'length(hit) between 4 and 79')}, {top(5, 2)} select owner_id, rank + 4 as pos, 'preferences.detected' as key, hit as value, false as value_is_list, "
          f"'preference' as type, 'low' as confidence, '{TREE}' as source from TP")
D_TOPIC = f"{word_hits(chat.TOPICS)}, {top(5, 3)} {listed(10, 'topics.frequent', 'context', 'medium', TREE)}"
_self = [("role", "identity", r"(?i)I(?:'m| am) (?:a|an) (" + W + r"+(?:\s+" + W + r"+){0,3}(?:developer|engineer|designer|manager|founder|student|researcher|writer|analyst))"),
         ("company", "identity", r"(?i)I work (?:at|for) ([\p{L}\p{N}_\s&.]+?)(?:\.|,|$)"),
         ("learning", "skill", r"(?i)I(?:'m| am) (?:learning|studying) ([\p{L}\p{N}_\s]+?)(?:\.|,|$)")]
_arms = " union all ".join(f"select owner_id, {q(k)} as key, {q(t)} as type, {trim(f'regexp_extract(text, {q(p)}, 1)')} as v, row(conv_id, pos, {i}, 0) as spot from M" for i, (k, t, p) in enumerate(_self))
D_SELF = (f"SF as (select owner_id, key, type, min_by(v, spot) as v, min(spot) as spot from ({_arms}) where length(v) between 3 and 59 group by all) "
          f"select owner_id, row_number() over (partition by owner_id order by spot) + 1 as pos, key, v as value, false as value_is_list, type, 'low' as confidence, '{TREE}' as source from SF")

# non-ASCII letters become plain ones, so that ASCII word boundaries agree
LOW = r"LW as (select owner_id, text, regexp_replace(lower(text), '[^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}]', 'z', 'g') as t from M)"


def ascii_pattern(p):
    return p.replace("(?!script)", "").replace(r"(?![\s-]*native)", "")


def mentions(table, pos, key):
    arms = " union all ".join(
        f"select owner_id, {i} as rank, {q(n)} as hit from LW where regexp_matches("
        + (r"regexp_replace(t, 'react[\s-]*native', ' ', 'g')" if n == "React" else "t") + f", {q(ascii_pattern(p))})" for i, (n, p) in enumerate(table.items()))
    return f"{LOW}, TP as (select distinct * from ({arms})) {listed(pos, key, 'skill', 'medium', FLAT)}"


D_ML = mentions(chat.MENTIONED_LANGUAGES, 0, "languages.mentioned")
D_MF = mentions(chat.MENTIONED_FRAMEWORKS, 1, "frameworks.mentioned")
_counts = " union all ".join(f"select owner_id, {i} as n, {q(t)} as topic, cast(sum(len(regexp_extract_all(t, {q(p)}))) as bigint) as hits from LW group by 1" for i, (t, p) in enumerate(chat.TOPIC_PATTERNS.items()))
D_TC = f"{LOW}, TC as ({_counts})"
D_TF = f"{D_TC}, TP as (select owner_id, topic as hit, row_number() over (partition by owner_id order by hits desc, n) as rank from TC where hits >= 2 qualify rank <= 8) {listed(2, 'topics.frequent', 'context', 'medium', FLAT)}"
D_ST = rf"""{LOW}, SY as (select owner_id, avg(length(text)) as a, count(*) as n, count(*) filter (regexp_matches(t, '\b(je|tu|nous|vous|est|les|des|une|que|pour|dans|avec)\b')) as fr,
 count(*) filter (contains(text, '```') or contains(text, 'def ') or contains(text, 'function ') or contains(text, 'import ')) as co from LW group by 1)
select owner_id, pos, key, value, false as value_is_list, 'style' as type, 'low' as confidence, '{FLAT}' as source from (
 select owner_id, 3 as pos, 'style.brevity' as key, case when a < 50 then 'Very concise — short messages' when a < 150 then 'Concise — moderate length messages' when a > 500 then 'Detailed — long, thorough messages' end as value from SY
 union all select owner_id, 4, 'style.language', case when fr > n * 0.2e0 then 'Uses French frequently' end from SY
 union all select owner_id, 5, 'style.code_heavy', case when co > n * 0.3e0 then 'Frequently shares code in conversations' end from SY) where value is not null"""
D_MC = f"select owner_id, 6 as pos, 'import.message_count' as key, cast(count(*) as varchar) as value, false as value_is_list, 'context' as type, 'high' as confidence, '{FLAT}' as source from M group by 1"


def many(parts):
    """Union of queries that each bring their own CTEs."""
    return " union all ".join(f"select * from ({'' if p.startswith('select') else 'with '}{p})" for p in parts)


def one(body):
    return with_views("M", body if body.startswith("select") else "with " + body)


def flat(df):
    return df.withColumn("value", F.array_join("value_items", "|")).drop("value_items")


def _stats(v):
    return chats.import_stats(v.table("conversations").select(
        (F.col("conv_id") % 7).cast("string").alias("owner_id"), "conv_id"), v.M)


IS = """IC as (select cast(conv_id % 7 as varchar) as owner_id, count(distinct conv_id) as conversations from conversations group by 1),
IM as (select owner_id, count(*) as messages from M group by 1), IT as (select owner_id, coalesce(conversations, 0) as conversations, coalesce(messages, 0) as messages from IC full join IM using (owner_id))"""
SAN = r"""regexp_replace(text, '["\\[:cntrl:]]', ' ', 'g')"""
TREE_SQL = f"""with A as (select conv_id, conv_id // 3 as f, role, {trim(SAN)} as text, row_number() over (partition by conv_id order by turn) as n,
 dense_rank() over (partition by conv_id // 3 order by conv_id) - 1 as conv_no from conversations)
select cast(f % 7 as varchar) as owner_id, 'f' || f as file, conv_no, n * 1048576 as pos, text from A where role = 'user' and length(text) > 5"""
FLAT_SQL = f"""with A as (select conv_id, role, {SAN} as text, row_number() over (partition by conv_id order by turn) - 1 as n from conversations)
select cast(conv_id % 7 as varchar) as owner_id, 'c' || conv_id as file, case when conv_id % 5 = 4 then n else 0 end as conv_no, case when conv_id % 5 = 4 then 0 else n * 1048576 end as pos, text
from A where role = 'user' and (text <> '' or conv_id % 5 > 1)"""


def _zipped(v):
    """Archives made from the export texts, with an unrelated first entry."""
    @F.pandas_udf("binary")
    def pack(doc: pd.Series) -> pd.Series:
        def one_zip(text):
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
                zf.writestr("user.json", "{}")
                zf.writestr("data/conversations.json", text)
            return buf.getvalue()
        return doc.map(one_zip)
    return v.CT.select(F.col("file").alias("path"), pack("doc").alias("content"))


def stub_model(prompt: str) -> str:
    if len(prompt) % 7 == 0:
        raise RuntimeError("no answer")
    return f'{{"facts": [], "summary": "{len(prompt)} chars"}}'


EB = r"""EB0 as (select *, row_number() over (partition by owner_id order by length(text) desc, conv_id, pos) as rn from M),
EB1 as (select owner_id, (rn - 1) // 50 as batch_no, rn, '[' || ((rn - 1) % 50 + 1) || ']: ' || text as line from EB0),
EB as (select owner_id, batch_no, count(*) as n, 'Here are ' || count(*) || ' messages a user wrote to assistants.' || chr(10) || 'Scope of interest: general' || chr(10) || chr(10)
 || string_agg(line, chr(10) || '---' || chr(10) order by rn) || chr(10) || chr(10) || 'Return the facts and rules they state as strict JSON.' as prompt from EB1 group by all)"""
XP = r"""XC as (select owner_id, batch_no, regexp_replace(regexp_replace(trim(raw), '^```(?:json)?\s*', ''), '\s*```$', '') as c from XR),
XJ as (select owner_id, batch_no, case when json_valid(c) then cast(c as json) when json_valid(regexp_extract(c, '(?s)\{.*\}')) then cast(regexp_extract(c, '(?s)\{.*\}') as json) end as v from XC),
XV as (select * from XJ where json_type(v) = 'OBJECT')"""
XM = """XK as (select *, case coalesce(confidence, 'low') when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end as r from X where coalesce(key, '') <> ''),
XW as (select owner_id, key, arg_min(pos, row(-r, pos)) as w_pos, min(pos) as first_pos from XK group by all),
XL as (select owner_id, key, pos as w_pos, value_is_list as w_list, confidence, first_pos from X join XW using (owner_id, key) where pos = w_pos)"""
XI = f"""{XM}, NE as (select x.owner_id, x.key, x.pos, w_pos, x.value_items, unnest(range(len(x.value_items))) as item_no from X x join XL using (owner_id, key) where x.pos = w_pos or (x.pos > w_pos and w_list and x.value_is_list)),
NI as (select *, value_items[item_no + 1] as item from NE),
XIT as (select owner_id, key, pos as from_pos, item_no, item from NI where pos = w_pos
 union all select owner_id, key, spot[1], spot[2], item from (select owner_id, key, item, min(row(pos, item_no)) as spot, bool_or(pos = w_pos) as own from NI group by all) where not own)"""


def _parsed(v):
    return extract.parse_extractions(v.XR)


def _rules_as_x(v):
    return v.RU.select("owner_id", "pos", "instruction", "priority")


def _stats_x(v):
    rules = extract.merge_extracted_rules(_rules_as_x(v))
    msgs = v.X.select("owner_id", "pos")
    return extract.extraction_stats(msgs, extract.merge_extracted_facts(v.X), rules)


XS = f"""{XM}, RN as (select distinct owner_id, regexp_replace(lower({trim('instruction')}), '[^a-z0-9\\s]', '', 'g') as norm from RU),
XST as (select owner_id, total, total as processed, cast(ceil(total / 50) as bigint) as batches, coalesce(facts, 0) as facts, coalesce(rules, 0) as rules
 from (select owner_id, count(*) as total from X group by 1) left join (select owner_id, count(*) as facts from XL group by 1) using (owner_id) left join (select owner_id, count(*) as rules from RN group by 1) using (owner_id))"""


def _packs_x(v):
    said = _parsed(v).select("owner_id", "batch_no", F.try_variant_get("v", "$.summary", "string").alias("summary"))
    return extract.assemble_extracted_packs(_stats_x(v), said).withColumn("tags", F.array_join("tags", ","))


def _zipped_flat(v):
    """One archive per flat export."""
    def packed(file, doc):
        import io
        import zipfile
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as zf:
            zf.writestr(f"conversations-{file}.json", doc)
            zf.writestr("notes.txt", "x")
        return buffer.getvalue()
    return v.CF.select(F.concat("file", F.lit(".zip")).alias("path"), F.udf(packed, "binary", useArrow=False)("file", "doc").alias("content"))


def _broken(v):
    """Flat exports, some cut off, some followed by more text, some of another type."""
    n = F.substring("file", 2, 9).cast("int")
    doc = (F.when(n % 7 == 0, F.expr("substring(doc, 1, length(doc) - 1)")).when(n % 7 == 1, F.concat("doc", F.lit(" [1]")))
           .when(n % 7 == 2, F.lit('"text"')).otherwise(F.col("doc")))
    return v.CF.withColumn("doc", doc)


BROKEN = """BR as (select owner_id, file, case cast(substr(file, 2) as int) % 7 when 0 then substr(doc, 1, length(doc) - 1) when 1 then doc || ' [1]' when 2 then '"text"' else doc end as doc from CF)"""
# exports of all layouts; of the damaged ones, those that are still a list or an object
DAMAGED_LAYOUTS_SQL = with_views("CF", f"""with {BROKEN}, FL as ({FLAT_SQL}), OKF as (select owner_id, file from BR where case when json_valid(doc) then json_type(doc) in ('ARRAY', 'OBJECT') else false end)
 select * from FL semi join OKF using (owner_id, file)""")

def _by_splits(v):
    """Exports of a thousand files' conversations in one list each, written by Spark and read by splits."""
    path = new_output(v.spark, "big-exports")
    n = F.substring("file", 2, 9).cast("long")
    inner = F.when(F.startswith("doc", F.lit("[")), F.expr("substring(doc, 2, length(doc) - 2)")).otherwise(F.col("doc"))
    parts = v.CF.select("owner_id", F.floor(n / 1000).alias("export"), n.alias("n"), inner.alias("value"))
    keys = ["owner_id", "export"]
    edges = parts.groupBy(*keys).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    lines = parts.join(edges, keys).select(*keys, "n", F.concat(
        F.when(F.col("n") == F.col("lo"), "[").otherwise(","), "value", F.when(F.col("n") == F.col("hi"), "]").otherwise("")).alias("value"))
    (lines.repartition(*keys).sortWithinPartitions(*keys, "n").select(*keys, "value")
     .write.partitionBy(*keys).text(path))
    found = split_exports.split_chat_flat(split_exports.split_conversations(v.spark, path))
    return found.select("owner_id", F.regexp_extract("file", "/export=([0-9]+)/", 1).cast("long").alias("export"), "conv_no", "pos", "text")


BY_SPLITS_SQL = with_views("CF", f"""with FL as ({FLAT_SQL}), N as (select conv_id, case when conv_id % 5 = 4 then count(*) else 1 end as n from conversations group by conv_id),
 B as (select conv_id, coalesce(sum(n) over (partition by conv_id % 7, conv_id // 1000 order by conv_id rows between unbounded preceding and 1 preceding), 0) as base from N)
select owner_id, cast(conv_id // 1000 as bigint) as export, cast(conv_no + base as bigint) as conv_no, pos, text from FL join B on file = 'c' || conv_id""")

QUERIES = {
    "read_split_exports": (_by_splits, BY_SPLITS_SQL),
    "read_chat_tree": (lambda v: chats.read_chat_tree(v.CT), TREE_SQL),
    "read_chat_flat": (lambda v: chats.read_chat_flat(v.CF), FLAT_SQL),
    "read_export_archives": (
        lambda v: chats.unpack_archives(_zipped(v), "tree"),
        with_views("CT", "select file, doc, cast(null as varchar) as error from CT")),
    "read_flat_archives": (
        lambda v: chats.unpack_archives(_zipped_flat(v), "flat"),
        with_views("CF", "select file || '.zip!conversations-' || file || '.json' as file, doc, cast(null as varchar) as error from CF")),
    "unreadable_exports": (
        lambda v: chats.unreadable_exports(_broken(v), "flat"),
        with_views("CF", f"with {BROKEN} select owner_id, file, case when not json_valid(doc) then 'unreadable' when json_type(doc) = 'VARCHAR' then 'unexpected str' end as error from BR where not json_valid(doc) or json_type(doc) = 'VARCHAR'")),
    "read_chat_damaged_layouts": (lambda v: chats.read_chat_flat(_broken(v)), DAMAGED_LAYOUTS_SQL),
    "limit_conversations": (
        lambda v: chats.limit_conversations(v.M, 5),
        with_views("M", "with FP as (select owner_id, conv_id, min(pos) as p from M group by all), KC as (select owner_id, conv_id from FP qualify row_number() over (partition by owner_id order by p, conv_id) <= 5) select * from M semi join KC using (owner_id, conv_id)")),
    "import_stats": (lambda v: _stats(v), with_views("M", f"with {IS} select * from IT")),
    "detect_languages": (lambda v: flat(chat.detect_languages(v.M)), one(D_LANG)),
    "detect_frameworks": (lambda v: flat(chat.detect_frameworks(v.M)), one(D_FRAME)),
    "self_identification": (lambda v: flat(chat.self_identification(v.M)), one(D_SELF)),
    "detect_preferences": (lambda v: flat(chat.detect_preferences(v.M)), one(D_PREF)),
    "detect_topics": (lambda v: flat(chat.detect_topics(v.M)), one(D_TOPIC)),
    "import_chat_tree": (lambda v: flat(chat.import_chat_tree(v.M)), with_views("M", many([D_LANG, D_FRAME, D_SELF, D_PREF, D_TOPIC]))),
    "import_chat_packs": (
        lambda v: chat.import_pack(_stats(v), ["chatgpt", "import", "auto-extracted"], "chatgpt-import").withColumn("tags", F.array_join("tags", ",")),
        with_views("M", f"""with {IS} select owner_id, 'chatgpt-import' as pack, 'general' as scope, case when messages > 0 then 'Imported from chat export (' || conversations || ' conversations, ' || messages || ' messages)'
 else 'Imported from chat export (no messages found)' end as description, 'chatgpt,import,auto-extracted' as tags from IT""")),
    "mentioned_languages": (lambda v: flat(chat.mentioned_languages(v.M)), one(D_ML)),
    "mentioned_frameworks": (lambda v: flat(chat.mentioned_frameworks(v.M)), one(D_MF)),
    "topic_counts": (lambda v: chat.topic_counts(v.M), with_views("M", f"with {D_TC} select * from TC")),
    "topic_frequency": (lambda v: flat(chat.topic_frequency(v.M)), one(D_TF)),
    "message_style": (lambda v: flat(chat.message_style(v.M)), one(D_ST)),
    "import_chat_flat": (lambda v: flat(chat.import_chat_flat(v.M)), with_views("M", many([D_ML, D_MF, D_TF, D_ST, D_MC]))),
    "extraction_batches": (lambda v: extract.extraction_batches(v.M), with_views("M", f"with {EB} select * from EB")),
    "extract_with_model": (
        lambda v: extract.extract_with_model(extract.extraction_batches(v.M), stub_model),
        with_views("M", f"""with {EB} select owner_id, batch_no, '{{"facts": [], "summary": "' || length(prompt) || ' chars"}}' as raw from EB where length(prompt) % 7 <> 0""")),
    "parse_extractions": (
        lambda v: extract.extracted_facts(_parsed(v)).select("owner_id", "batch_no", "key", F.array_join("value_items", "|").alias("value"), "value_is_list", "confidence"),
        with_views("XR", f"""with {XP}, XE as (select owner_id, batch_no, json_extract(v, '$.facts[0]') as e from XV) select owner_id, batch_no, e->>'$.key' as key,
 case when json_type(e, '$.value') = 'ARRAY' then array_to_string(cast(e->'$.value' as varchar[]), '|') else e->>'$.value' end as value, json_type(e, '$.value') = 'ARRAY' as value_is_list, e->>'$.confidence' as confidence from XE""")),
    "parse_extracted_rules": (
        lambda v: extract.extracted_rules(_parsed(v)).drop("i"),
        with_views("XR", f"with {XP} select owner_id, batch_no, v->>'$.rules[0].instruction' as instruction, cast(v->>'$.rules[0].priority' as int) as priority from XV")),
    "merge_extracted_facts": (
        lambda v: extract.extracted_defaults(extract.merge_extracted_facts(v.X)).select("owner_id", "key", "pos", "first_pos", "value_is_list", "type", "confidence", "source"),
        with_views("X", f"with {XM} select owner_id, key, w_pos as pos, first_pos, w_list as value_is_list, 'context' as type, coalesce(confidence, 'medium') as confidence, 'llm-extraction' as source from XL")),
    "merged_extracted_items": (lambda v: extract.merged_items(v.X), with_views("X", f"with {XI} select * from XIT")),
    "merge_extracted_rules": (
        lambda v: extract.merge_extracted_rules(_rules_as_x(v)),
        with_views("RU", f"""with RN as (select *, regexp_replace(lower({trim('instruction')}), '[^a-z0-9\\s]', '', 'g') as norm from RU)
 select owner_id, pos, instruction, priority from RN qualify row_number() over (partition by owner_id, norm order by pos) = 1""")),
    "extracted_pack_rules": (
        lambda v: extract.extracted_pack_rules(_rules_as_x(v).withColumn("priority", F.nullif("priority", F.lit(3)))),
        with_views("RU", f"""with RN as (select *, regexp_replace(lower({trim('instruction')}), '[^a-z0-9\\s]', '', 'g') as norm from RU)
 select owner_id, 'extracted' as pack, pos, instruction, coalesce(nullif(priority, 3), 5) as priority from RN qualify row_number() over (partition by owner_id, norm order by pos) = 1""")),
    "extracted_pack_facts": (
        lambda v: extract.extracted_pack_facts(v.X),
        with_views("X", f"with {XM} select owner_id, 'extracted' as pack, first_pos as pos, key, w_list as value_is_list, 'context' as type, coalesce(confidence, 'medium') as confidence, 'llm-extraction' as source from XL")),
    "extraction_stats": (lambda v: _stats_x(v), with_views("X RU", f"with {XS} select * from XST")),
    "assemble_extracted_packs": (
        _packs_x, with_views("X RU XR", f"""with {XS}, {XP}, SU as (select owner_id, min_by(v->>'$.summary', batch_no) as s from XV where v->>'$.summary' <> '' group by 1)
 select owner_id, 'extracted' as pack, 'general' as scope, concat_ws(chr(10), 'Extracted from ' || total || ' messages (' || facts || ' facts, ' || rules || ' rules)', s) as description, 'extracted,llm,general' as tags from XST left join SU using (owner_id)""")),
}
