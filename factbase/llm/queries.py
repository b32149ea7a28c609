"""Registered queries of the operators: name -> (builder over session and data folder, DuckDB text or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factbase.llm import oracles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_columns(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of every document, as digests."""
    import public_tokenizers
    from factbase.llm.bpe import encode_decode
    return op10_columns(encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 with equal numbers of rows."""
    from factbase.llm.sharding import shard
    return shard(table(spark, sf_dir, "documents"), shards=40)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it overlaps."""
    from factbase.llm.decontaminate import find_overlaps
    found = find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("matches"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 20-word sequences that occur earlier."""
    from factbase.llm.substrings import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those that are not held out."""
    from factbase.llm.language import fit, predict
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(2)) == 2
    model = fit(docs, where=~held_out)
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from factbase.llm.pages import extract
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every fiftieth vector among all others."""
    from factbase.llm.mtree import top_k
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component of its near copies."""
    from factbase.llm.ngram_join import similar_groups
    return similar_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue from every participant's perspective."""
    from factbase.llm.chat import rotate
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"], F.lit("-"), s["end"])), ",")
    return rotate(table(spark, sf_dir, "conversations")).select(
        "conv_id", "speaker", "part", "n_turns", "rendered", spans.alias("spans"))


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page by the fixed rules and the link graph."""
    from factbase.llm.urls import judge
    rules = spark.sql("select * from values " + ", ".join(map(repr, RULES)) + " as r(host, path, verdict)")
    return judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Turns (conv_id, pos, digest, chars) where conversation c begins with the first h turns of conversation
    c - c % group, then has its own after its first h; h = crc32(decimal c) % most. A row with null pos for each conversation."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    base = (F.col("conv_id") - F.col("conv_id") % group).alias("base")
    heads = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv_id", "base")
    convs = turns.select("conv_id").distinct().select("conv_id", h, base)
    lent = convs.join(heads, "base").where("pos < h").select("conv_id", "pos", "digest", "chars")
    number = heads.groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    own = turns.select("*", h, base).where("pos >= h").join(number, "base", "left")
    place = F.col("pos") - F.col("h") + F.least("h", F.coalesce("n", F.lit(0)))
    none = convs.select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("digest"),
                        F.lit(None).cast("long").alias("chars"))
    return lent.unionByName(own.select("conv_id", place.alias("pos"), "digest", "chars")).unionByName(none)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    from factbase.llm.prefix_trie import EMPTY, ends_digest, prefix_trie, turn_digests
    from factbase.llm.storage import cut
    trie = prefix_trie(rebuilt(cut(turn_digests(table(spark, sf_dir, "conversations")))))
    out = trie.nodes.join(ends_digest(trie.ends), "node", "left").fillna(EMPTY, ["ends_sha256"])
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def planted_repeats(docs: DataFrame) -> DataFrame:
    """In documents whose crc32(decimal doc_id), h, is divisible by 10, words from a on repeat the p words from a on:
    g = floor(h / 10), a = g % n, p = 1 + floor((n - a) / (3 + g % 8)) for n words. A null doc_id has no h."""
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    g = F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 10)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    rows = docs.select("doc_id", "text", F.when(chosen, words).alias("w"), g.alias("g"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times)), F.lit(1), F.col("n") - F.col("a"))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), repeated), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, in every tenth one after planting repeats, and the text without them."""
    from factbase.llm.periods import collapse_runs
    found = collapse_runs(planted_repeats(table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more than 1024 tokens."""
    import public_tokenizers
    from factbase.llm.token_counts import count_tokens
    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


QUERIES = {
    "op1_sharding": (op1_sharding, oracles.sharding(40, 64, 14)),
    "op2_decontaminate": (op2_decontaminate, None),
    "op3_substrings": (op3_substrings, oracles.SUBSTRINGS),
    "op5_pages": (op5_pages, None),
    "op6_top_k": (op6_top_k, oracles.TOP_K),
    "op7_ngram_join": (op7_ngram_join, oracles.NGRAM_JOIN),
    "op8_chat": (op8_chat, oracles.CHAT),
    "op9_urls": (op9_urls, oracles.urls(RULES)),
    "op4_language": (op4_language, None),
    "op10_bpe": (op10_bpe, None),
    "op11_prefix_trie": (op11_prefix_trie, oracles.trie()),
    "op12_runs": (op12_runs, oracles.runs()),
    "op13_token_counts": (op13_token_counts, None),
}
