"""Prompt documents for all owners.

A document is kept as ordered lines, never as one string per owner: an owner may hold any share
of all facts. Lines carry their place (pack, block, ord, ord_n, pos). `assemble` joins the lines
of documents whose measured size is small; `write_documents` range-partitions and sorts the
lines, which needs no group in one task.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factbase.functions import secrets as S
from factbase.functions.values import bucketed_rank, conf_rank, value_text
from factbase.operators.search import list_packs

PACK = ["owner_id", "pack"]
PLACE = ["pack", "block", "ord", "ord_n", "pos"]
PART_LINES = 1000

# Key groups of cards and profiles, and their caps.
ROLE_KEYS = ["role", "role.employment", "role.founder"]
PROFILE_ROLE_KEYS = ["role", "role.founder", "role.student", "role.employment"]
CARD_STACK_KEYS = ["languages.primary", "frameworks", "editor"]
PROFILE_STACK_KEYS = ["languages.primary", "frameworks", "editor", "ai_tools"]
CARD_STACK, CARD_RULES, PROFILE_CONTEXT, PROFILE_RULES = 3, 2, 10, 5
NO_CARD = "No user identity configured."
NO_PROFILE = "No user context available."


def _lines(df: DataFrame, block: int | Column, line: Column, ord: str | None = None, ord_n: Column | None = None,
           has_pos: bool = True) -> DataFrame:
    return df.select(
        "owner_id", "pack", (block if isinstance(block, Column) else F.lit(block)).alias("block"),
        (F.col(ord) if ord else F.lit("")).alias("ord"),
        (F.lit(0) if ord_n is None else ord_n).cast("bigint").alias("ord_n"),
        (F.col("pos") if has_pos else F.lit(0).cast("bigint")).alias("pos"), line.alias("line"))


def _head(df: DataFrame, block: int | Column, line: Column) -> DataFrame:
    return _lines(df, block, line, has_pos=False)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _entry(prefix: str = "- ") -> Column:
    return F.concat(F.lit(prefix), "key", F.lit(": "), value_text())


def _by_priority(rules: DataFrame, block: int, tagged: bool, prefix: str = "- ") -> DataFrame:
    tag = F.when(F.col("priority") > 0, F.concat(F.lit("[P"), F.col("priority").cast("string"), F.lit("] "))).otherwise("")
    line = F.concat(F.lit(prefix), tag, F.col("instruction")) if tagged else F.concat(F.lit(prefix), F.col("instruction"))
    return _lines(rules, block, line, ord_n=-F.col("priority"))


def _of(df: DataFrame, packs: DataFrame) -> DataFrame:
    return df.join(packs.select(*PACK), PACK, "left_semi")


def pack_prompt(packs: DataFrame, facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Head, description, facts by key, rules by priority."""
    sizes = list_packs(packs, facts, rules)
    title = F.concat(F.lit("## Context: "), "pack", F.lit(" ("), "scope", F.lit(")"))
    fact = F.concat(F.lit("- **"), "key", F.lit("**: "), value_text())
    return _union([
        _head(packs, 0, title),
        _head(packs.where(F.col("description") != ""), 1, F.concat(F.lit("\n"), "description", F.lit("\n"))),
        _head(sizes.where(F.col("n_facts") > 0), 2, F.lit("\n### Known facts")),
        _lines(_of(facts, packs), 3, fact, ord="key"),
        _head(sizes.where(F.col("n_rules") > 0), 4, F.lit("\n### Rules & preferences")),
        _by_priority(_of(rules, packs), 5, tagged=True)])


def export_system_prompt(packs: DataFrame, facts: DataFrame, rules: DataFrame, header: bool = True) -> DataFrame:
    """Lines of one document per owner: an optional head, then every pack after an empty line."""
    body = pack_prompt(packs, facts, rules).unionByName(_head(packs, -1, F.lit("")))
    if not header:
        return body
    intro = ["# User Context",
             "The following describes the user's preferences, skills, and instructions.",
             "Respect these unless the user explicitly overrides them in conversation."]
    owners = packs.select("owner_id").distinct().withColumn("pack", F.lit(""))
    return body.unionByName(_head(owners, 0, F.lit("\n".join(intro))))


def export_rules_file(packs: DataFrame, facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Facts in stored order and rules by priority, without marks."""
    sizes = list_packs(packs, facts, rules)
    with_facts, with_rules = sizes.where(F.col("n_facts") > 0), sizes.where(F.col("n_rules") > 0)
    return _union([
        _head(packs, 0, F.concat(F.lit("# Context: "), "pack", F.lit("\n# Scope: "), "scope", F.lit("\n"))),
        _head(with_facts, 1, F.lit("## User Context")), _lines(_of(facts, packs), 2, _entry()),
        _head(with_facts, 3, F.lit("")),
        _head(with_rules, 4, F.lit("## Rules")), _by_priority(_of(rules, packs), 5, tagged=False),
        _head(with_rules, 6, F.lit(""))])


# Fixed values: (key parts that must all occur, phrase); first match wins, {v} value, {s} scope.
PHRASES = [
    (["language", "primary"], "User's primary programming languages are: {v}"),
    (["language", "learning"], "User is currently learning: {v}"),
    (["framework"], "User works with these frameworks: {v}"),
    (["editor"], "User's preferred editor is {v}"),
    (["tone"], "User's preferred tone is: {v}"),
    (["role"], "User's role is: {v}"),
    (["company"], "User works at {v}"),
    (["team"], "User is on the {v}"),
    (["style"], "User's {s} style preference: {v}"),
    (["audience"], "User's target audience: {v}"),
]


def _phrase(template: str) -> Column:
    head, tail = template.split("{v}")
    parts = [F.lit(head)] if "{s}" not in head else [
        F.lit(head.split("{s}")[0]), F.col("scope"), F.lit(head.split("{s}")[1])]
    return F.concat(*parts, F.col("_value"), F.lit(tail))


def memory_statements(packs: DataFrame, facts: DataFrame, rules: DataFrame) -> DataFrame:
    """One sentence per fact (block 0) and per rule (block 1)."""
    scopes = packs.select(*PACK, "scope")
    key = F.lower("key")
    text = F.concat(F.lit("User "), "scope", F.lit(" context — "), "key", F.lit(": "), "_value")
    for parts, template in reversed(PHRASES):
        test = reduce(lambda a, b: a & b, [F.contains(key, F.lit(p)) for p in parts])
        text = F.when(test, _phrase(template)).otherwise(text)
    said = facts.join(scopes, PACK).withColumn("_value", value_text()).select(
        *PACK, F.lit(0).alias("block"), "pos", text.alias("line"))
    told = rules.join(scopes, PACK).select(*PACK, F.lit(1).alias("block"), "pos", F.concat(
        F.lit("User preference ("), "scope", F.lit("): "), "instruction").alias("line"))
    return said.unionByName(told)


def export_memory_text(packs: DataFrame, facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Numbered statements per owner, and the total as number 0."""
    statements = memory_statements(packs, facts, rules)
    numbered = bucketed_rank(
        statements, ["owner_id"],
        {"_b1": F.col("pack"), "_b2": F.col("block"), "_b3": F.shiftright("pos", 20)}, [F.col("pos")], "number")
    total = statements.groupBy("owner_id").agg(F.count(F.lit(1)).alias("n")).select(
        "owner_id", F.lit(0).cast("bigint").alias("number"),
        F.concat(F.lit("# Total statements: "), F.col("n").cast("string")).alias("line"))
    return numbered.select("owner_id", "number", F.concat(
        F.col("number").cast("string"), F.lit(". "), F.col("line")).alias("line")).unionByName(total)


def export_custom_instructions(packs: DataFrame, facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Lines of two fields: about_you from facts, response_style from rules."""
    sizes = list_packs(packs, facts, rules)
    tag = F.concat(F.lit("["), F.upper("scope"), F.lit("]"))
    field = lambda parts, name: _union(parts).withColumn("field", F.lit(name))
    with_facts, with_rules = sizes.where(F.col("n_facts") > 0), sizes.where(F.col("n_rules") > 0)
    about = field([_head(with_facts, 0, tag), _lines(_of(facts, packs), 1, _entry()),
                   _head(with_facts, 2, F.lit(""))], "about_you")
    style = field([_head(with_rules, 0, tag), _by_priority(_of(rules, packs), 1, tagged=False),
                   _head(with_rules, 2, F.lit(""))], "response_style")
    return about.unionByName(style)


FIELDS = [("about_you", "FIELD 1: what the assistant should know about you"), ("response_style", "FIELD 2: how the assistant should answer")]


def custom_instructions_text(packs: DataFrame, facts: DataFrame, rules: DataFrame) -> DataFrame:
    """(owner_id, field, part, text): the two fields for copying, each under its heading and without outer blank lines.
    An owner without facts or rules has an empty field."""
    lines = export_custom_instructions(packs, facts, rules)
    last = lines.where("line = ''").groupBy("owner_id", "field").agg(F.max(F.struct("pack", "block")).alias("last"))
    kept = (lines.join(last, ["owner_id", "field"], "left")
            .where(~((F.col("line") == "") & (F.struct("pack", "block") == F.col("last")))).drop("last"))
    parts = assemble(kept, ["owner_id", "field"], ["pack", "block", "ord_n", "pos"])
    heads = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(h).alias("head")) for f, h in FIELDS])
    every = packs.select("owner_id").distinct().select("owner_id", F.inline(heads))
    ruler = F.lit("=" * 60)
    head = F.concat(ruler, F.lit("\n"), "head", F.lit("\n"), ruler, F.lit("\n\n"))
    none = every.join(lines.select("owner_id", "field").distinct(), ["owner_id", "field"], "left_anti")
    # the head follows from the field alone: a join would hold all parts of an owner at once
    heading = F.lit(FIELDS[0][1])
    for name, text in FIELDS[1:]:
        heading = F.when(F.col("field") == name, text).otherwise(heading)
    shown = parts.withColumn("head", heading).select(
        "owner_id", "field", "part", F.concat(F.when(F.col("part") == 0, head).otherwise(""), "text").alias("text"))
    return shown.unionByName(none.select("owner_id", "field", F.lit(0).cast("bigint").alias("part"), head.alias("text")))


# Sections of the identity document: (type or None for all others, heading, line start).
SECTIONS = [("identity", None), ("skill", "**Stack:**"), ("preference", "**Preferences:**"), ("style", "**Style:**")]


def export_identity_md(packs: DataFrame, facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Per pack: identity, stack, preferences, style, other facts, rules; each section ends empty."""
    title = F.concat(F.lit("### "), "pack", F.lit(" ("), "scope", F.lit(")"))
    under = F.when(F.col("description") != "", F.concat(F.lit("\n_"), "description", F.lit("_"))).otherwise("")
    names = [t for t, _ in SECTIONS]
    section = F.lit(len(names))
    for i, name in enumerate(names):
        section = F.when(F.col("type") == name, i).otherwise(section)
    mine = _of(facts, packs).withColumn("_s", section)
    ruled = _of(rules, packs)
    bold = F.concat(F.lit("- **"), "key", F.lit("**: "), value_text())
    entries = _lines(mine, F.col("_s") * 10 + 11, F.when(F.col("_s") == 0, bold).otherwise(_entry()))
    headings = F.lit(None).cast("string")
    for i, (_, heading) in enumerate(SECTIONS):
        headings = F.when(F.col("_s") == i, F.lit(heading)).otherwise(headings)
    frames = F.array(F.struct((F.col("_s") * 10 + 10).alias("_b"), headings.alias("_l")),
                     F.struct((F.col("_s") * 10 + 12).alias("_b"), F.lit("").alias("_l")))
    used = mine.select(*PACK, "_s").distinct().select(*PACK, F.inline(frames)).where(F.col("_l").isNotNull())
    rule_frames = F.array(F.struct(F.lit(90).alias("_b"), F.lit("**Rules** (sorted by priority):").alias("_l")),
                          F.struct(F.lit(92).alias("_b"), F.lit("").alias("_l")))
    framed = used.unionByName(ruled.select(*PACK).distinct().select(*PACK, F.inline(rule_frames)))
    return _union([_head(packs, 0, F.concat(title, under, F.lit("\n"))), entries, _head(framed, F.col("_b"), F.col("_l")),
                   _by_priority(ruled, 91, tagged=True)])


def export_agents_md(packs: DataFrame, facts: DataFrame, rules: DataFrame) -> DataFrame:
    """One flattened profile per owner: Identity, Stack, Preferences (all the rest), Rules."""
    block = F.when(F.col("type") == "identity", 10).when(F.col("type") == "skill", 20).otherwise(30)
    lines = _of(facts, packs).select(
        "owner_id", "pack", block.alias("block"), F.lit("").alias("ord"),
        F.lit(0).cast("bigint").alias("ord_n"), "pos", _entry().alias("line"))
    lines = lines.unionByName(_by_priority(_of(rules, packs), 40, tagged=True))
    names = F.create_map(*[F.lit(x) for kv in {10: "**Identity:**", 20: "**Stack:**", 30: "**Preferences:**",
                                               40: "**Rules:**"}.items() for x in kv])
    used = lines.select("owner_id", "block").distinct().withColumn("pack", F.lit(""))
    place = lambda shift, line: used.select(
        "owner_id", "pack", (F.col("block") + shift).alias("block"), F.lit("").alias("ord"),
        F.lit(0).cast("bigint").alias("ord_n"), F.lit(0).cast("bigint").alias("pos"), line.alias("line"))
    return lines.unionByName(place(-1, names[F.col("block")])).unionByName(place(1, F.lit("")))


def _order() -> Column:
    return F.struct(F.col("pack").alias("p"), (-F.col("score")).alias("s"), F.col("pos").alias("i"))


def identity_cards(packs: DataFrame, scored: DataFrame, rules: DataFrame) -> DataFrame:
    """Name, role, up to three stack entries and two rules per owner; facts in priority order."""
    owners = packs.select("owner_id").distinct()
    f = _of(scored, packs).withColumn("_v", value_text()).withColumn("_o", _order())
    w = Window.partitionBy("owner_id").orderBy("_o")
    stack = (f.where(F.col("key").isin(CARD_STACK_KEYS)).withColumn("_n", F.row_number().over(w))
             .where(F.col("_n") <= CARD_STACK)
             .select("owner_id", "_n", "_o", F.element_at(F.split("key", r"\."), -1).alias("_label"), "_v"))
    stack = stack.withColumn("_e", F.concat("_label", F.lit(": "), S.scrub(F.col("_v"))))
    stacks = stack.groupBy("owner_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_e"))), lambda x: x["_e"]), " | ").alias("stack"),
        F.max(F.when(F.col("_n") == CARD_STACK, F.col("_o"))).alias("_full"))
    # stack keys count as stack until three are taken; afterwards an identity-typed one may give the role
    spare = ~F.col("key").isin(CARD_STACK_KEYS) | F.coalesce(F.col("_o") > F.col("_full"), F.lit(False))
    is_role = F.col("key").isin(ROLE_KEYS) | (
        (F.col("type") == "identity") & (F.col("key") != "identity.name") & spare)
    picked = (f.where(((F.col("key") == "identity.name") | F.col("key").isin(ROLE_KEYS) | (F.col("type") == "identity"))
                      & (F.col("_v") != ""))
              .join(stacks.select("owner_id", "_full"), "owner_id", "left").groupBy("owner_id").agg(
        F.min_by(F.when(F.col("key") == "identity.name", F.col("_v")),
                 F.when(F.col("key") == "identity.name", F.col("_o"))).alias("name"),
        F.min_by(F.when(is_role, F.col("_v")), F.when(is_role, F.col("_o"))).alias("role")))
    in_pack = Window.partitionBy(*PACK).orderBy("pos")
    in_owner = Window.partitionBy("owner_id").orderBy("pack", "pos")
    top = (_of(rules, packs).withColumn("_n", F.row_number().over(in_pack)).where(F.col("_n") <= CARD_RULES)
           .withColumn("_n", F.row_number().over(in_owner)).where(F.col("_n") <= CARD_RULES)
           .groupBy("owner_id").agg(F.array_join(F.transform(
               F.array_sort(F.collect_list(F.struct("_n", "instruction"))), lambda x: x["instruction"]), " | ").alias("rules")))
    card = owners.join(picked, "owner_id", "left").join(stacks.drop("_full"), "owner_id", "left").join(top, "owner_id", "left")
    named = F.concat_ws(" — ", S.scrub(F.col("name")), S.scrub(F.col("role")))
    head = F.when(named == "", "User").otherwise(named)
    text = F.concat_ws("\n", F.col("head"), F.concat(F.lit("Stack: "), "stack"), F.concat(F.lit("Key rules: "), "rules"))
    return card.withColumn("head", head).select(
        "owner_id", F.when((F.col("head") == "User") & F.col("stack").isNull() & F.col("rules").isNull(), NO_CARD)
        .otherwise(text).alias("card"))


def compact_profiles(packs: DataFrame, scored: DataFrame, rules: DataFrame, freshness: DataFrame,
                     max_facts: int | None = None) -> DataFrame:
    """Entries of a short profile: section 0 Identity, 1 Stack, 2 Context (first 10), 3 Rules
    (first 5), 4 freshness. Values are scrubbed. Order within a section: pack, rank, pos."""
    f = _of(scored, packs).withColumn("_c", F.lit(0))
    if max_facts:
        w = Window.partitionBy(*PACK).orderBy(conf_rank(), F.desc("score"), "pos")
        f = f.withColumn("_c", conf_rank()).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_facts)
    section = (F.when(F.startswith("key", F.lit("identity")) | F.col("key").isin(PROFILE_ROLE_KEYS), 0)
               .when((F.col("type") == "skill") | F.col("key").isin(PROFILE_STACK_KEYS), 1).otherwise(2))
    place = ["owner_id", "section", "pack", "rank", "pos"]
    f = f.withColumns({"section": section, "rank": F.col("_c") * 1000.0 - F.col("score")}).withColumn("_v", value_text())
    f = f.select(*place, "key", "_v")
    wide = Window.partitionBy("owner_id").orderBy("pack", "rank", "pos")
    context = (f.where(F.col("section") == 2).withColumn("_n", F.row_number().over(wide))
               .where(F.col("_n") <= PROFILE_CONTEXT).drop("_n"))
    shown = f.where(F.col("section") < 2).unionByName(context)
    shown = shown.select(*place, F.concat("key", F.lit(": "), S.scrub(F.col("_v"))).alias("entry"))
    told = (_of(rules, packs).withColumn("_n", F.row_number().over(Window.partitionBy("owner_id").orderBy("pack", "pos")))
            .where(F.col("_n") <= PROFILE_RULES)
            .select("owner_id", F.lit(3).alias("section"), "pack", F.lit(0.0).alias("rank"), "pos",
                    F.col("instruction").alias("entry")))
    body = shown.unionByName(told)
    owners = packs.select("owner_id").distinct()
    # who has any entry at all is read from the slim owner columns, not from the rendered body
    filled = scored.select(*PACK).unionByName(rules.select(*PACK)).distinct()
    filled = _of(filled, packs).select("owner_id").distinct()
    some = owners.join(filled, "owner_id", "left_semi")
    single = lambda df, line: df.select(
        "owner_id", F.lit(4).alias("section"), F.lit("").alias("pack"), F.lit(0.0).alias("rank"),
        F.lit(0).cast("bigint").alias("pos"), line.alias("entry"))
    age = F.concat(F.lit("Context freshness: "), F.col("freshness").cast("string"), F.lit("/100"))
    bare = owners.join(filled, "owner_id", "left_anti")
    return (body.unionByName(single(some.join(freshness, "owner_id"), age))
            .unionByName(single(bare, F.lit(NO_PROFILE))))


# Labels of the sections of a profile.
PROFILE_LABELS = ["Identity: ", "Stack: ", "Context: ", "Rules: "]


def profile_text(entries: DataFrame) -> DataFrame:
    """(owner_id, section, part, line) from compact_profiles: one line per section, entries joined by bars. A section of
    very many entries is several parts, of which the first has the label."""
    label = F.lit("")
    for i, name in enumerate(PROFILE_LABELS):
        label = F.when(F.col("section") == i, F.lit(name)).otherwise(label)
    parts = assemble(entries.withColumnRenamed("entry", "line"), ["owner_id", "section"], ["pack", "rank", "pos"], sep=" | ")
    return parts.select("owner_id", "section", "part", F.concat(F.when(F.col("part") == 0, label).otherwise(""), "text").alias("line"))


def full_context(packs: DataFrame, scored: DataFrame, rules: DataFrame, scopes: list[str] | None = None,
                 max_facts: int | None = None) -> DataFrame:
    """Prompt lines without head over visible packs, optionally by scope and capped per pack."""
    from factbase.operators.search import cap_facts, filter_scopes
    shown = filter_scopes(packs, scopes)
    facts = cap_facts(scored, max_facts).drop("rank") if max_facts else scored
    return export_system_prompt(shown, facts, rules, header=False)


def assemble(lines: DataFrame, keys: list[str], order: list[str] = PLACE, part_lines: int = PART_LINES,
             sep: str = "\n") -> DataFrame:
    """(keys, part, text): documents as numbered parts of `part_lines` lines; all parts of a document, joined by `sep`
    in their order, are the whole text. Lines are numbered inside (keys, leading order column, block of positions)."""
    rest = [c for c in order if c not in keys]
    lead = {f"_b{i}": F.col(c) for i, c in enumerate(rest[:-1])}
    ranked = bucketed_rank(lines, keys, {**lead, "_blk": F.shiftright(rest[-1], 16)}, [F.col(rest[-1])], "_n")
    numbered = ranked.select(*keys, F.floor((F.col("_n") - 1) / part_lines).cast("bigint").alias("part"), "_n", "line")

    def join(part: pa.Table) -> pa.Table:
        text = sep.join(part.sort_by("_n")["line"].drop_null().to_pylist())
        return part.slice(0, 1).select([*keys, "part"]).append_column("text", pa.array([text], part["line"].type))

    # one part at a time from a sort that can spill; an aggregate holds all parts that a task meets
    schema = numbered.select(*keys, "part", F.col("line").alias("text")).schema
    return numbered.groupBy(*keys, "part").applyInArrow(join, schema)


def write_documents(lines: DataFrame, path: str, order: list[str] = PLACE) -> None:
    """Lines as sorted text files per owner; range partitioning spreads one owner over many tasks."""
    by = ["owner_id", *order]
    (lines.repartitionByRange(*by).sortWithinPartitions(*by)
     .select("owner_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("owner_id").text(path))
