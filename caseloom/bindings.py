"""The test tables seen as mentions, events, entities, edges, messages and so on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.operators.pairs import pair_counts
from caseloom.operators.scoring import edge_weight, entity_scores
from caseloom.operators.skew import dealt
from caseloom.session import cut

ORG = 1_000_000_000_000      # id offset of suppliers
PERSON = 2_000_000_000_000   # id offset of customers
TYPES = {"email": "1-URGENT", "flight": "2-HIGH", "money": "3-MEDIUM", "author": "A", "recipient": "R"}
KIND_OF_PRIORITY = {"1-URGENT": "email", "2-HIGH": "flight_log", "3-MEDIUM": "financial"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def day(c: str | Column) -> Column:
    """Date as text, so results compare across engines."""
    return F.date_format(c, "yyyy-MM-dd")


def rounded(c: str, digits: int) -> Column:
    """Rounded as a scaled double; ``round`` alone goes by the decimal digits, which turns 40.17499... shown as 40.175 into 40.18."""
    return F.round(F.col(c) * 10**digits) / 10**digits


def mentions(spark: SparkSession, sf: str, entity: str = "l_partkey") -> DataFrame:
    """One row per (entity, document, page): the strongest line item. Lines are dealt once, by document."""
    lines = table(spark, sf, "lineitem")
    lines = dealt(lines, lines.count(), "l_orderkey").select(
        F.col(entity).alias("entity_id"), F.col("l_orderkey").alias("document_id"),
        F.col("l_linenumber").alias("page"), F.col("l_quantity").cast("int").alias("q"),
        "l_shipdate", "l_partkey", "l_extendedprice", "l_returnflag",
    )
    key = ["entity_id", "document_id", "page"]
    order = Window.partitionBy(*key).orderBy(
        F.desc("q"), "l_shipdate", "l_partkey", "l_extendedprice", "l_returnflag")
    best = lines.withColumn("rn", F.row_number().over(order)).filter("rn = 1")
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("doc_type"))
    return best.join(orders, "document_id").select(
        *key, F.col("l_shipdate").alias("event_ts"), "doc_type", F.col("l_returnflag").alias("evidence_type"),
        F.col("q").alias("evidence_score"), (F.col("l_returnflag") == "R").alias("redacted"),
    )


def supplier_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf, "l_suppkey")


def flights(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as dated events with a registry id, a route and participants."""
    orders = table(spark, sf, "orders")
    return orders.select(
        F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("registry"),
        F.col("o_orderdate").alias("event_ts"), F.col("o_orderpriority").alias("origin"),
        F.col("o_orderstatus").alias("dest"),
    )


def participants(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, entity_id), the exploded participant lists."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("entity_id")).distinct()


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """(entity_id, name, entity_type, is_protected) over parts, suppliers and customers."""
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"),
        F.when(F.col("p_size") % 4 == 0, "organization").when(F.col("p_size") % 4 == 1, "location")
        .otherwise("person").alias("entity_type"), (F.col("p_size") == 13).alias("is_protected"),
    )
    supplier = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") + ORG).alias("entity_id"), F.col("s_name").alias("name"),
        F.lit("organization").alias("entity_type"), (F.col("s_nationkey") == 0).alias("is_protected"),
    )
    customer = table(spark, sf, "customer").select(
        (F.col("c_custkey") + PERSON).alias("entity_id"), F.col("c_name").alias("name"),
        F.lit("person").alias("entity_type"), (F.col("c_nationkey") == 0).alias("is_protected"),
    )
    return part.unionByName(supplier).unionByName(customer)


def edges(spark: SparkSession, sf: str, at_least: int = 2) -> DataFrame:
    """Part pairs seen together in at least two orders."""
    lines = table(spark, sf, "lineitem")
    lines = dealt(lines, lines.count(), "l_orderkey").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("entity_id"))
    known = table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"))
    seen = lines.join(known, "document_id", "left_semi")
    pairs = pair_counts(seen, "document_id", "entity_id", at_least)
    return pairs.select(
        F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.lit("co_occurs_with").alias("kind"),
        F.col("groups").alias("evidence"), edge_weight(F.lit("co_occurs_with"), F.col("groups")).alias("weight"),
    )


def scored_parts(spark: SparkSession, sf: str, seen: DataFrame | None = None, linked: DataFrame | None = None) -> DataFrame:
    """Parts with their computed score; ``seen`` and ``linked`` are written mentions and edges that the caller reads too."""
    if seen is None:
        seen = cut(mentions(spark, sf).select("entity_id", "document_id", "evidence_score"), "seen")
    scores = entity_scores(seen, edges(spark, sf) if linked is None else linked)
    names = entities(spark, sf).filter(F.col("entity_id") < ORG)
    return names.join(scores, "entity_id")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as messages; the subject comes from the first turn."""
    turns = table(spark, sf, "conversations")
    first = turns.filter("turn = 0").groupBy("conv_id").agg(F.min(F.element_at(F.split("text", r"\. "), 1)).alias("subject"))
    return turns.join(first, "conv_id", "left").select(
        F.col("conv_id"), F.col("turn"), F.col("role").alias("sender"), F.col("text").alias("body"), "subject")


def dated_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as dated messages in the thread of their customer."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("thread_id"), F.col("o_orderkey").alias("message_id"),
        F.col("o_orderdate").alias("sent_at"), F.col("o_orderpriority").alias("sender"))


def judgements(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as answers of four annotators."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_returnflag").alias("item"),
        (F.col("l_suppkey") % 4).alias("annotator"), F.col("l_quantity").cast("int").alias("score"),
        F.col("l_linenumber").alias("slot"))


def mirror_listing(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url")


def current_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The listing without its German section, some addresses written with a fragment or a slash."""
    rest = table(spark, sf, "pages").filter(~F.col("url").contains("/de/"))
    return rest.select(
        "page_id",
        F.when(F.col("url").contains("?"), F.concat("url", F.lit("#again")))
        .when(~F.col("url").rlike("[?#/]$|[?#]"), F.concat("url", F.lit("/"))).otherwise(F.col("url")).alias("url"))


def raw_names(spark: SparkSession, sf: str) -> DataFrame:
    """Part names dressed with titles, suffixes and stray blanks."""
    before = F.element_at(F.array(*map(F.lit, ["", "Dr. ", "mrs ", " Judge  ", "Prof. ", "Lord "])),
                          (F.col("p_size") % 6 + 1).cast("int"))
    after = F.element_at(F.array(*map(F.lit, ["", ", Jr.", " PhD", "  ", ", Esq", " III"])),
                         (F.col("p_retailprice").cast("int") % 6 + 1).cast("int"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("plain"),
        F.concat(before, F.regexp_replace("p_name", " ", "  "), after).alias("name"), "p_size", "p_brand", "p_type")


def letters(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written out as e-mail text: headers, amounts, account, case and registry numbers."""
    o, key = table(spark, sf, "orders"), F.col("o_orderkey").cast("string")
    cust = F.col("o_custkey").cast("string")
    text = F.concat(
        F.lit("From: Customer "), cust, F.lit(" <c"), cust, F.lit("@mail.example.com>\nTo: Desk <desk@example.org>; c"),
        (F.col("o_custkey") + 1).cast("string"), F.lit("@mail.example.com\nSubject: Re: Fwd: order "),
        F.col("o_orderpriority"), F.lit("\nDate: "), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"),
        F.lit("\n\nPlease send a wire transfer of $"), F.floor("o_totalprice").cast("string"),
        F.lit(".00 to account 55"), key, F.lit(" for case No. 12-cv-100"), key, F.lit(". Pilot of N"),
        (F.col("o_custkey") % 900 + 100).cast("string"), F.lit("AB will meet you at 12 Oak Street.\n> earlier line "),
        F.col("o_orderstatus"), F.lit("\nSincerely, Customer "), cust)
    return o.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"), F.col("o_custkey").alias("cust"),
                    F.col("o_orderdate").alias("sent_at"))
