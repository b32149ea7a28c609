"""Facts from chat messages by fixed rules.

Every rule is: find hits per message, count per (owner, hit) with map-side combine, keep the
top few per owner. Order of equal counts is first occurrence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factbase.functions.values import contains_any, strip

# ---- fixed values: word lists, patterns and limits of the tree import ----
LANGUAGES = ["python", "typescript", "javascript", "rust", "go", "golang", "java", "c++", "cpp", "ruby", "php",
             "swift", "kotlin", "scala", "r", "julia", "dart", "lua", "perl", "haskell", "elixir", "clojure",
             "zig", "nim", "ocaml", "c#", "csharp", "sql", "html", "css"]
LANGUAGE_PATTERNS = [
    r"\b(?:I (?:use|code in|write|program in|work with))\s+(\w+)",
    r"\b(?:in|using|with)\s+(Python|TypeScript|JavaScript|Rust|Go|Java|C\+\+|Ruby|PHP|Swift|Kotlin)\b",
]
FRAMEWORKS = ["React", "Next.js", "Vue", "Nuxt", "Angular", "Svelte", "SvelteKit", "Django", "Flask", "FastAPI",
              "Express", "Nest.js", "Rails", "Spring", "Laravel", "Tailwind", "Bootstrap", "TensorFlow", "PyTorch",
              "LangChain", "LlamaIndex", "Prisma", "Drizzle", "SQLAlchemy", "Supabase", "Firebase", "Docker",
              "Kubernetes", "Terraform"]
SELF = [
    ("role", "identity", r"I(?:'m| am) (?:a|an) (\w+(?:\s+\w+){0,3}"
                         r"(?:developer|engineer|designer|manager|founder|student|researcher|writer|analyst))"),
    ("company", "identity", r"I work (?:at|for) ([\w\s&.]+?)(?:\.|,|$)"),
    ("learning", "skill", r"I(?:'m| am) (?:learning|studying) ([\w\s]+?)(?:\.|,|$)"),
]
# The role pattern asks for text glued to the title; this variant also takes a plain title.
ROLE_FIXED = (r"I(?:'m| am) (?:a|an) ((?:\w+\s+){0,4}\w*"
              r"(?:developer|engineer|designer|manager|founder|student|researcher|writer|analyst))")
PREFERENCE = r"I (?:prefer|like|want|always use) ([\w\s]+?)(?:\.|,|$|because|over)"
TOPICS = {
    "web-development": ["react", "html", "css", "frontend", "backend", "api", "rest"],
    "machine-learning": ["model", "training", "dataset", "neural", "llm", "gpt", "embedding"],
    "devops": ["docker", "kubernetes", "ci/cd", "deploy", "aws", "gcp", "azure"],
    "mobile": ["ios", "android", "react native", "flutter", "swift", "kotlin"],
    "data": ["pandas", "sql", "database", "query", "csv", "analytics"],
    "design": ["figma", "ui", "ux", "layout", "wireframe", "mockup"],
    "writing": ["blog", "article", "essay", "copy", "content", "draft"],
    "business": ["startup", "revenue", "strategy", "market", "pitch", "investor"],
}
TOP_LANGUAGES, TOP_FRAMEWORKS, TOP_PREFERENCES, TOP_TOPICS = 5, 8, 5, 5
MIN_FRAMEWORK, MIN_PREFERENCE, MIN_TOPIC = 2, 2, 3
TREE_SOURCE = "chatgpt-import"

# ---- fixed values of the flat import ----
MENTIONED_LANGUAGES = {
    "Python": r"\bpython\b", "TypeScript": r"\btypescript\b|\b\.tsx?\b",
    "JavaScript": r"\bjavascript\b|\bjs\b|\bnode\.?js\b", "Rust": r"\brust\b|\bcargo\b",
    "Go": r"\bgolang\b|\bgo\s+(?:func|package|mod)\b", "Java": r"\bjava\b(?!script)",
    "C++": r"\bc\+\+\b|\bcpp\b", "Ruby": r"\bruby\b|\brails\b", "PHP": r"\bphp\b|\blaravel\b",
    "Swift": r"\bswift\b|\bswiftui\b", "Kotlin": r"\bkotlin\b",
    "SQL": r"\bsql\b|\bpostgres\b|\bmysql\b|\bsqlite\b",
}
MENTIONED_FRAMEWORKS = {
    "React": r"\breact\b(?![\s-]*native)", "Next.js": r"\bnext\.?js\b|\bnext\s*js\b",
    "Vue": r"\bvue\.?js\b|\bvue\b", "FastAPI": r"\bfastapi\b", "Django": r"\bdjango\b", "Flask": r"\bflask\b",
    "Express": r"\bexpress\.?js\b|\bexpress\b", "Tailwind": r"\btailwind\b", "Supabase": r"\bsupabase\b",
    "Prisma": r"\bprisma\b", "Docker": r"\bdocker\b", "Kubernetes": r"\bk8s\b|\bkubernetes\b",
}
TOPIC_PATTERNS = {
    "web development": r"\bweb\s*(?:app|dev|site|page)\b|\bfrontend\b|\bbackend\b",
    "machine learning": r"\bml\b|\bmachine\s*learning\b|\bneural\b|\btraining\b",
    "data analysis": r"\bdata\s*(?:analysis|science|viz)\b|\bpandas\b|\bdataframe\b",
    "devops": r"\bdevops\b|\bci/?cd\b|\bdeploy\b|\binfra\b",
    "mobile": r"\bmobile\b|\bios\b|\bandroid\b|\breact\s*native\b|\bflutter\b",
    "api design": r"\bapi\b|\brest\b|\bgraphql\b|\bendpoint\b",
    "databases": r"\bdatabase\b|\bpostgres\b|\bmongo\b|\bredis\b|\bsupabase\b",
    "ai agents": r"\bagent\b|\bmcp\b|\btool\s*use\b|\bfunction\s*call\b",
    "security": r"\bauth\b|\boauth\b|\bjwt\b|\bencrypt\b|\bsecurity\b",
    "testing": r"\btest\b|\bpytest\b|\bjest\b|\bunit\s*test\b",
}
MIN_TOPIC_HITS, TOP_TOPIC_HITS = 2, 8
FRENCH = r"(?U)\b(je|tu|nous|vous|est|les|des|une|que|pour|dans|avec)\b"
FRENCH_SHARE, CODE_SHARE = 0.2, 0.3
CODE_MARKS = ["```", "def ", "function ", "import "]
BREVITY = [(50, "Very concise — short messages"), (150, "Concise — moderate length messages")]
LONG, LONG_TEXT = 500, "Detailed — long, thorough messages"
FRENCH_TEXT, CODE_TEXT = "Uses French frequently", "Frequently shares code in conversations"
FLAT_SOURCE = "claude-import"

FACT = ["owner_id", "pos", "key", "value_items", "value_is_list", "type", "confidence", "source"]


def _fact(df: DataFrame, pos, key, value: Column, is_list: bool, type_, confidence: str, source: str) -> DataFrame:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select("owner_id", as_col(pos).cast("bigint").alias("pos"), as_col(key).alias("key"),
                     value.alias("value_items"), F.lit(is_list).alias("value_is_list"),
                     as_col(type_).alias("type"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))


def _top(hits: DataFrame, k: int, at_least: int = 1) -> DataFrame:
    """hits(owner_id, hit, at) -> the k most frequent per owner, then the minimum count."""
    w = Window.partitionBy("owner_id").orderBy(F.desc("n"), "first")
    return (hits.groupBy("owner_id", "hit").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
            .withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col("n") >= at_least)))


def _ranked_list(top: DataFrame) -> DataFrame:
    """One bounded list per owner (the top k)."""
    return top.groupBy("owner_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "hit"))), lambda x: x["hit"]).alias("items"))


def _at(pattern: Column, match: Column) -> Column:
    return F.struct(F.col("conv_id").alias("c"), F.col("pos").alias("p"), pattern.alias("n"), match.alias("m"))


def _regex_hits(messages: DataFrame, patterns: list[str]) -> DataFrame:
    def numbered(n: int, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit("(?iU)" + pattern), F.lit(1)),
                           lambda m, i: F.struct(F.lit(n).alias("n"), i.alias("i"), m.alias("m")))

    found = [numbered(n, p) for n, p in enumerate(patterns)]
    return (messages.select("owner_id", "conv_id", "pos", F.explode(F.concat(*found)).alias("h"))
            .select("owner_id", strip(F.col("h.m")).alias("hit"), _at(F.col("h.n"), F.col("h.i")).alias("at")))


def _word_hits(messages: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """One hit per message and name of which any word occurs, ignoring case."""
    low = messages.select("owner_id", "conv_id", "pos", F.lower("text").alias("_low"))
    marks = F.array(*[F.when(contains_any(F.col("_low"), [w.lower() for w in ws]),
                             F.struct(F.lit(i).alias("n"), F.lit(name).alias("m")))
                      for i, (name, ws) in enumerate(words.items())])
    return (low.select("owner_id", "conv_id", "pos", F.explode(F.filter(marks, lambda x: x.isNotNull())).alias("h"))
            .select("owner_id", F.col("h.m").alias("hit"), _at(F.col("h.n"), F.lit(0)).alias("at")))


def detect_languages(messages: DataFrame) -> DataFrame:
    """Counted by spelling; a message may count under both patterns."""
    hits = _regex_hits(messages, LANGUAGE_PATTERNS).where(F.lower("hit").isin(LANGUAGES))
    return _fact(_ranked_list(_top(hits, TOP_LANGUAGES)), 0, "languages.detected", F.col("items"), True,
                 "skill", "medium", TREE_SOURCE)


def detect_frameworks(messages: DataFrame) -> DataFrame:
    hits = _word_hits(messages, {w: [w] for w in FRAMEWORKS})
    return _fact(_ranked_list(_top(hits, TOP_FRAMEWORKS, MIN_FRAMEWORK)), 1, "frameworks.detected", F.col("items"),
                 True, "skill", "medium", TREE_SOURCE)


def self_identification(messages: DataFrame, fixed: bool = False) -> DataFrame:
    """First acceptable role, company and subject of study of each owner."""
    rules = [(k, t, ROLE_FIXED if fixed and k == "role" else p) for k, t, p in SELF]
    found = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(k).alias("key"), F.lit(t).alias("type"),
                               strip(F.regexp_extract("text", "(?iU)" + p, 1)).alias("v"))
                      for i, (k, t, p) in enumerate(rules)])
    hits = (messages.select("owner_id", "conv_id", "pos", F.explode(found).alias("h"))
            .where(F.length("h.v").between(3, 59))
            .groupBy("owner_id", "h.key", "h.type").agg(
                F.min_by("h.v", _at(F.col("h.n"), F.lit(0))).alias("value"), F.min(_at(F.col("h.n"), F.lit(0))).alias("at")))
    rank = F.row_number().over(Window.partitionBy("owner_id").orderBy("at"))
    return _fact(hits.withColumn("_n", rank), F.col("_n") + 1, F.col("key"), F.array("value"), False,
                 F.col("type"), "low", TREE_SOURCE)


def detect_preferences(messages: DataFrame) -> DataFrame:
    hits = _regex_hits(messages, [PREFERENCE]).where(F.length("hit").between(4, 79))
    return _fact(_top(hits, TOP_PREFERENCES, MIN_PREFERENCE), F.col("rank") + 4, "preferences.detected",
                 F.array("hit"), False, "preference", "low", TREE_SOURCE)


def detect_topics(messages: DataFrame) -> DataFrame:
    top = _top(_word_hits(messages, TOPICS), TOP_TOPICS, MIN_TOPIC)
    return _fact(_ranked_list(top), 10, "topics.frequent", F.col("items"), True, "context", "medium", TREE_SOURCE)


def import_chat_tree(messages: DataFrame) -> DataFrame:
    """All facts of the tree import, in stored order, from one pass over the messages.

    Hits of all rules become one array per message; they are counted by (owner, rule, hit), ranked inside each rule, and
    only the top hits of an owner, a few dozen rows at most, meet again in one row.
    """
    low = messages.select("owner_id", "conv_id", "pos", "text", F.lower("text").alias("_low"))
    hit = lambda rule, n, i, m: F.struct(F.lit(rule).alias("rule"), n.cast("int").alias("n"), i.cast("int").alias("i"), m.alias("hit"))
    none = F.lit(0)

    def matches(rule: str, n: int, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit("(?iU)" + pattern), F.lit(1)), lambda m, i: hit(rule, F.lit(n), i, strip(m)))

    def words(rule: str, table: dict[str, list[str]]) -> Column:
        return F.array(*[F.when(contains_any(F.col("_low"), [w.lower() for w in ws]), hit(rule, F.lit(i), none, F.lit(name)))
                         for i, (name, ws) in enumerate(table.items())])

    told = [hit(f"self.{key}", F.lit(n), none, strip(F.regexp_extract("text", "(?iU)" + p, 1))) for n, (key, _, p) in enumerate(SELF)]
    found = F.concat(*[matches("language", n, p) for n, p in enumerate(LANGUAGE_PATTERNS)], words("framework", {w: [w] for w in FRAMEWORKS}),
                     F.array(*told), matches("preference", 0, PREFERENCE), words("topic", TOPICS))
    rule, text = F.col("h.rule"), F.col("h.hit")
    fits = (F.when(rule == "language", F.lower(text).isin(LANGUAGES)).when(F.startswith(rule, F.lit("self.")), F.length(text).between(3, 59))
            .when(rule == "preference", F.length(text).between(4, 79)).otherwise(True))
    counted = (low.select("owner_id", "conv_id", "pos", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("h")).where(fits)
               .groupBy("owner_id", rule.alias("rule"), text.alias("hit")).agg(
                   F.count(F.lit(1)).alias("n"), F.min(_at(F.col("h.n"), F.col("h.i"))).alias("at")))
    own = F.startswith("rule", F.lit("self."))
    order = Window.partitionBy("owner_id", "rule").orderBy(F.when(own, 0).otherwise(-F.col("n")), "at")
    ranked = counted.withColumn("rank", F.row_number().over(order))
    limits = {"language": (TOP_LANGUAGES, 1), "framework": (TOP_FRAMEWORKS, MIN_FRAMEWORK), "preference": (TOP_PREFERENCES, MIN_PREFERENCE),
              "topic": (TOP_TOPICS, MIN_TOPIC)}
    keep = own & (F.col("rank") == 1)
    for name, (k, least) in limits.items():
        keep = keep | ((F.col("rule") == name) & (F.col("rank") <= k) & (F.col("n") >= least))
    top = ranked.where(keep).groupBy("owner_id").agg(F.array_sort(F.collect_list(F.struct("rule", "rank", "hit", "at"))).alias("top"))

    def fact(pos, key, items, many: bool, type_, confidence: str) -> Column:
        col = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(col(pos).cast("bigint").alias("pos"), col(key).alias("key"), items.alias("value_items"), F.lit(many).alias("value_is_list"),
                        col(type_).alias("type"), F.lit(confidence).alias("confidence"), F.lit(TREE_SOURCE).alias("source"))

    def listed(name: str) -> Column:
        return F.transform(F.filter("top", lambda x: x["rule"] == name), lambda x: x["hit"])

    kinds = F.create_map(*[F.lit(x) for key, type_, _ in SELF for x in (f"self.{key}", type_)])
    selves = F.array_sort(F.transform(F.filter("top", lambda x: F.startswith(x["rule"], F.lit("self."))),
                                      lambda x: F.struct(x["at"].alias("at"), x["rule"].alias("rule"), x["hit"].alias("hit"))))
    facts = F.concat(
        F.filter(F.array(fact(0, "languages.detected", listed("language"), True, "skill", "medium"),
                         fact(1, "frameworks.detected", listed("framework"), True, "skill", "medium"),
                         fact(10, "topics.frequent", listed("topic"), True, "context", "medium")), lambda x: F.size(x["value_items"]) > 0),
        F.transform(selves, lambda x, i: fact(i + 2, F.substring(x["rule"], 6, 100), F.array(x["hit"]), False, F.element_at(kinds, x["rule"]), "low")),
        F.transform(F.filter("top", lambda x: x["rule"] == "preference"),
                    lambda x: fact(x["rank"] + 4, "preferences.detected", F.array(x["hit"]), False, "preference", "low")))
    return top.select("owner_id", F.inline(facts))


def import_pack(stats: DataFrame, tags: list[str], name: str) -> DataFrame:
    """Pack rows with the import statistics in the description."""
    text = F.concat(F.lit("Imported from chat export ("), F.col("conversations").cast("string"),
                    F.lit(" conversations, "), F.col("messages").cast("string"), F.lit(" messages)"))
    empty = F.lit("Imported from chat export (no messages found)")
    return stats.select("owner_id", F.lit(name).alias("pack"), F.lit("general").alias("scope"),
                        F.when(F.col("messages") > 0, text).otherwise(empty).alias("description"),
                        F.array(*[F.lit(t) for t in tags]).alias("tags"))


def _mentions(messages: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Names found in any message of the owner, in table order."""
    low = messages.select("owner_id", F.lower("text").alias("_low"))
    flags = low.groupBy("owner_id").agg(*[
        F.bool_or(F.col("_low").rlike("(?U)" + p)).alias(f"_f{i}") for i, p in enumerate(patterns.values())])
    names = F.array(*[F.when(F.col(f"_f{i}"), F.lit(n)) for i, n in enumerate(patterns)])
    return (flags.select("owner_id", F.filter(names, lambda x: x.isNotNull()).alias("items"))
            .where(F.size("items") > 0))


def mentioned_languages(messages: DataFrame) -> DataFrame:
    return _fact(_mentions(messages, MENTIONED_LANGUAGES), 0, "languages.mentioned", F.col("items"), True,
                 "skill", "medium", FLAT_SOURCE)


def mentioned_frameworks(messages: DataFrame) -> DataFrame:
    return _fact(_mentions(messages, MENTIONED_FRAMEWORKS), 1, "frameworks.mentioned", F.col("items"), True,
                 "skill", "medium", FLAT_SOURCE)


def topic_counts(messages: DataFrame) -> DataFrame:
    """(owner_id, n, topic, hits): matches of each topic pattern, summed over messages."""
    low = messages.select("owner_id", F.lower("text").alias("_low"))
    sums = low.groupBy("owner_id").agg(*[
        F.sum(F.regexp_count("_low", F.lit("(?U)" + p))).alias(f"_s{i}") for i, p in enumerate(TOPIC_PATTERNS.values())])
    rows = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(t).alias("topic"), F.col(f"_s{i}").alias("hits"))
                     for i, t in enumerate(TOPIC_PATTERNS)])
    return sums.select("owner_id", F.inline(rows))


def topic_frequency(messages: DataFrame) -> DataFrame:
    w = Window.partitionBy("owner_id").orderBy(F.desc("hits"), "n")
    top = (topic_counts(messages).where(F.col("hits") >= MIN_TOPIC_HITS)
           .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP_TOPIC_HITS)
           .withColumnRenamed("topic", "hit"))
    return _fact(_ranked_list(top), 2, "topics.frequent", F.col("items"), True, "context", "medium", FLAT_SOURCE)


def message_style(messages: DataFrame) -> DataFrame:
    """Brevity from average length, frequent French, frequent code."""
    low = F.lower("text")
    per = messages.groupBy("owner_id").agg(
        F.avg(F.length("text")).alias("avg_len"), F.count(F.lit(1)).alias("n"),
        F.count_if(low.rlike(FRENCH)).alias("french"), F.count_if(contains_any(F.col("text"), CODE_MARKS)).alias("code"))
    avg = F.col("avg_len")
    brevity = (F.when(avg < BREVITY[0][0], BREVITY[0][1]).when(avg < BREVITY[1][0], BREVITY[1][1])
               .when(avg > LONG, LONG_TEXT))
    rows = F.array(
        F.struct(F.lit(3).alias("p"), F.lit("style.brevity").alias("k"), brevity.alias("v")),
        F.struct(F.lit(4).alias("p"), F.lit("style.language").alias("k"),
                 F.when(F.col("french") > F.col("n") * FRENCH_SHARE, FRENCH_TEXT).alias("v")),
        F.struct(F.lit(5).alias("p"), F.lit("style.code_heavy").alias("k"),
                 F.when(F.col("code") > F.col("n") * CODE_SHARE, CODE_TEXT).alias("v")))
    out = per.select("owner_id", F.inline(rows)).where(F.col("v").isNotNull())
    return _fact(out, F.col("p"), F.col("k"), F.array("v"), False, "style", "low", FLAT_SOURCE)


def message_count(messages: DataFrame) -> DataFrame:
    n = messages.groupBy("owner_id").agg(F.count(F.lit(1)).cast("string").alias("n"))
    return _fact(n, 6, "import.message_count", F.array("n"), False, "context", "high", FLAT_SOURCE)


def import_chat_flat(messages: DataFrame) -> DataFrame:
    """All facts of the flat import, in stored order, from one pass over the messages."""
    low = messages.select("owner_id", "text", F.lower("text").alias("_low"))
    flags = {f"_{kind}{i}": F.bool_or(F.col("_low").rlike("(?U)" + p)) for kind, table in (("l", MENTIONED_LANGUAGES), ("f", MENTIONED_FRAMEWORKS))
             for i, p in enumerate(table.values())}
    sums = {f"_s{i}": F.sum(F.regexp_count("_low", F.lit("(?U)" + p))) for i, p in enumerate(TOPIC_PATTERNS.values())}
    per = low.groupBy("owner_id").agg(
        *[c.alias(n) for n, c in {**flags, **sums}.items()], F.avg(F.length("text")).alias("avg_len"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_low").rlike(FRENCH)).alias("french"), F.count_if(contains_any(F.col("text"), CODE_MARKS)).alias("code"))

    def named(kind: str, table: dict[str, str]) -> Column:
        return F.filter(F.array(*[F.when(F.col(f"_{kind}{i}"), F.lit(n)) for i, n in enumerate(table)]), lambda x: x.isNotNull())

    hits = F.array(*[F.struct((-F.col(f"_s{i}")).alias("less"), F.lit(i).alias("n"), F.lit(t).alias("hit")) for i, t in enumerate(TOPIC_PATTERNS)])
    topics = F.transform(F.slice(F.array_sort(F.filter(hits, lambda x: x["less"] <= -MIN_TOPIC_HITS)), 1, TOP_TOPIC_HITS), lambda x: x["hit"])
    avg = F.col("avg_len")
    brevity = (F.when(avg < BREVITY[0][0], BREVITY[0][1]).when(avg < BREVITY[1][0], BREVITY[1][1]).when(avg > LONG, LONG_TEXT))
    one = lambda v: F.array(v.cast("string"))
    facts = [("languages.mentioned", named("l", MENTIONED_LANGUAGES), True, "skill", "medium"),
             ("frameworks.mentioned", named("f", MENTIONED_FRAMEWORKS), True, "skill", "medium"),
             ("topics.frequent", topics, True, "context", "medium"), ("style.brevity", one(brevity), False, "style", "low"),
             ("style.language", one(F.when(F.col("french") > F.col("n") * FRENCH_SHARE, FRENCH_TEXT)), False, "style", "low"),
             ("style.code_heavy", one(F.when(F.col("code") > F.col("n") * CODE_SHARE, CODE_TEXT)), False, "style", "low"),
             ("import.message_count", one(F.col("n")), False, "context", "high")]
    rows = F.array(*[F.struct(F.lit(i).cast("bigint").alias("pos"), F.lit(key).alias("key"), items.alias("value_items"), F.lit(many).alias("value_is_list"),
                              F.lit(kind).alias("type"), F.lit(sure).alias("confidence"), F.lit(FLAT_SOURCE).alias("source"))
                     for i, (key, items, many, kind, sure) in enumerate(facts)])
    full = lambda x: (F.size(x["value_items"]) > 0) & F.get(x["value_items"], F.lit(0)).isNotNull()
    return per.select("owner_id", F.inline(F.filter(rows, full)))
