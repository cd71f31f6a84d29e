"""The registered query of each operator: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, group_ranks, language_id, mixing, ngram_join, pitman_yor, prefix_trie, quality, repeats, secret_scan, simhash, token_counts, topk
from lodestar.llm.common import remainder, table


def held(n: int, rest: int):
    return F.coalesce(remainder("doc_id", n) == rest, F.lit(False))


def op1_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), quality.learn_on("doc_id"))
    scored = quality.score(docs.select("doc_id", held(4, 2).alias("held_out"), "text"), model, into="score").drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.cluster(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(language_id.learnable(docs))
    found = language_id.identify(docs.select("doc_id", held(4, 2).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.size("lang_spans").cast("long").alias("n_spans"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    names = F.transform("secret_spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    base = F.filter("secret_spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long")
    join = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(join(base).cast("binary"), 256).alias("base_sha256"),
        F.array_join(names, ",").alias("spans"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.histogram(table(spark, sf_dir, "documents"))


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = F.col("doc_id").isNotNull() & (remainder("doc_id", 10) != 0)
    found = pitman_yor.score(docs, learn)
    return found.select("doc_id", held(10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("n_matched").cast("bigint").alias("n_matched"))


def op3_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.quantised(table(spark, sf_dir, "embeddings")))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.cluster(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def op12_group_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "sale_lines")
    whole = lambda x: F.when(F.abs(x) < float("inf"), F.floor(x))  # noqa: E731  null for what is no finite number
    alone = F.coalesce(remainder("sale_id", 5) == 0, F.lit(False))
    of_group = lambda x: F.when(alone, F.lit(-1)).otherwise(F.coalesce(x, F.lit(-1))).cast("long")
    keys = lines.select(
        F.when(alone, F.lit(-1)).otherwise(F.col("vendor_id")).cast("long").alias("vendor_id"),
        of_group(F.col("item_id") % 10).alias("part"),
        of_group(100 * F.year("shipped_at") + F.month("shipped_at")).alias("month"),
        F.floor(F.col("quantity") / 10).alias("tens"),
        whole(100 * F.col("discount") + 0.5).alias("percent"),
        "sale_id",
        F.col("line_no").cast("long").alias("line_no"),
        F.col("quantity").cast("long").alias("quantity"),
        whole(100 * F.col("amount") + 0.5).alias("amount_cents"),
    )
    found = group_ranks.ranked(keys, ["vendor_id", "part", "month"], [("tens", True), ("percent", False)], ["sale_id", "line_no", "quantity", "amount_cents"], most=3)
    return found.drop("tens")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    turns = prefix_trie.numbered(conversations.select("conv_id", "turn", "role", "text"))
    convs = turns.select("conv").distinct()
    turns = prefix_trie.rebuilt(turns, convs, F.col("conv") - F.col("conv") % 5, remainder("conv", 9))
    found = prefix_trie.build(turns, convs)
    return found.select(
        F.col("conv").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.lower(F.hex("ends")).alias("ends_sha256"),
    )
