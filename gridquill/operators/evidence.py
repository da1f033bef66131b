"""Evidence of several kinds in one numbered list, and checks of drafts that cite it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridquill.functions import text as tx
from gridquill.sources.catalog import SECTIONS
from gridquill.sources.shared import cut, work_dir

#: Fields of a piece of evidence that slices may lack.
FIELDS = {"kind": "string", "source": "string", "title": "string", "pub_date": "string", "validation": "string", "temporal": "string", "url": "string", "score": "double", "doc_id": "string", "chunk_id": "string", "adjusted": "boolean", "text": "string"}
FEEDS = ("forecast", "retrospective", "conditions", "calendar")


def union(slices: Sequence[DataFrame], order: Sequence[str] = ("rank",), by: Sequence[str] = ()) -> DataFrame:
    """(by, n, FIELDS): the slices one behind the other, numbered from 1; a piece that two slices have stays twice."""
    rows = []
    for i, s in enumerate(slices):
        have = set(s.columns)
        fields = [F.col(f).cast(t).alias(f) if f in have else F.lit(None).cast(t).alias(f) for f, t in FIELDS.items()]
        rows.append(s.select(*by, F.lit(i).alias("__slice"), F.struct(*order).alias("__order"), *fields))
    whole = rows[0]
    for more in rows[1:]:
        whole = whole.unionByName(more)
    n = F.row_number().over(Window.partitionBy(*by).orderBy("__slice", "__order"))
    return whole.select(*by, n.alias("n"), *FIELDS)


def feed_of() -> Column:
    kind = F.col("kind")
    return F.when(kind == "document", F.when(F.col("temporal") == "forecast", "forecast").otherwise("retrospective")).otherwise(kind)


def stats(evidence: DataFrame, *by: str) -> DataFrame:
    """(by, forecast_hits, retrospective_hits, conditions, calendar, is_evidence); a calendar alone is no evidence."""
    count = lambda name: F.count_if(feed_of() == name)
    return evidence.groupBy(*by).agg(
        count("forecast").alias("forecast_hits"), count("retrospective").alias("retrospective_hits"), (count("conditions") > 0).alias("conditions"), (count("calendar") > 0).alias("calendar"), (F.count_if(F.col("kind") != "calendar") > 0).alias("is_evidence")
    )


def feeds(evidence: DataFrame) -> DataFrame:
    """(ord, feed, cites, empty): the numbers that each feed brought; a feed that brought nothing has its row too."""
    four = evidence.sparkSession.createDataFrame(list(enumerate(FEEDS)), "ord int, feed string")
    found = evidence.groupBy(feed_of().alias("feed")).agg(F.array_sort(F.collect_list("n")).alias("cites"))
    none = F.array().cast("array<int>")
    joined = four.join(found, "feed", "left").select("ord", "feed", F.coalesce("cites", none).alias("cites"))
    return joined.withColumn("empty", F.size("cites") == 0)


def grouped_sources(evidence: DataFrame) -> DataFrame:
    """(key, first_n, source, title, cites): evidence by document; pieces that are no documents stand alone."""
    key = F.when(F.col("kind") == "document", F.coalesce("doc_id", F.concat(F.lit("doc-"), F.col("n").cast("string")))).otherwise(F.concat_ws("-", "kind", F.col("n").cast("string")))
    return evidence.groupBy(key.alias("key")).agg(F.min("n").alias("first_n"), F.min_by(F.coalesce("source", F.lit("unknown source")), "n").alias("source"), F.min_by("title", "n").alias("title"), F.array_sort(F.collect_list("n")).alias("cites"))


def sources_text(evidence: DataFrame, *by: str) -> DataFrame:
    """(by, sources): a line for each piece of evidence, its link below it."""
    bits = F.concat_ws(" — ", F.coalesce(tx.blank_to_null(F.col("source")), F.lit("unknown source")), tx.blank_to_null(F.col("title")), tx.blank_to_null(F.col("pub_date")), F.concat(F.lit("validation: "), tx.blank_to_null(F.col("validation"))))
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), bits, F.coalesce(F.concat(F.lit("\n    source: "), tx.blank_to_null(F.col("url"))), F.lit("")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"])
    return evidence.groupBy(*by).agg(F.array_join(ordered, "\n").alias("sources"))


def numbers_of(evidence: DataFrame, *by: str) -> DataFrame:
    """(by, valid, numbers): the citation numbers there are, and every number that the evidence states."""
    said = F.concat_ws(" ", "text", "pub_date", "title", "source")
    return evidence.groupBy(*by).agg(F.array_sort(F.collect_set("n")).alias("valid"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(tx.number_tokens(said))))).alias("numbers"))


def check_drafts(drafts: DataFrame, sections: Sequence[str] = SECTIONS) -> DataFrame:
    """drafts (draft_id, draft, valid, numbers) with cited, phantom, missing_sections, own_sources, uncited (the first
    70 characters of paragraphs without a citation), unverified and passed.

    Numbers that no evidence states are recorded and don't fail a draft."""
    draft = F.coalesce("draft", F.lit(""))
    cited = tx.cited_numbers(draft)
    missing = F.filter(F.array(*map(F.lit, sections)), lambda s: ~F.contains(draft, s))
    bare = F.filter(tx.blocks(draft), lambda p: ~F.regexp_like(p, F.lit(tx.CITATION)))
    uncited = F.transform(bare, lambda p: F.substring(p, 1, 70))
    unverified = F.array_sort(F.array_except(tx.number_tokens(tx.without_citations(draft)), F.col("numbers")))
    out = drafts.withColumns({"cited": cited, "phantom": F.array_sort(F.array_except(cited, F.col("valid"))), "missing_sections": missing, "own_sources": F.contains(draft, F.lit("## Sources")), "uncited": uncited, "unverified": unverified})
    ok = (F.size("missing_sections") == 0) & ~F.col("own_sources") & (F.size("cited") > 0) & (F.size("phantom") == 0) & (F.size("uncited") == 0)
    return out.withColumn("passed", ok)


def claims(drafts: DataFrame) -> DataFrame:
    """(draft_id, claim, section, text, cites) of drafts (draft_id, draft): paragraphs with the last heading above
    them, "Preamble" without one; what follows a Sources heading is left out."""
    body = F.element_at(F.split(F.coalesce("draft", F.lit("")), r"\n## Sources\b"), 1)
    blocks = drafts.select("draft_id", F.posexplode(F.transform(F.split(body, "\n\n"), tx.strip)).alias("at", "block")).where("block <> ''")
    lines = F.split("block", "\n")
    headed = F.col("block").startswith("#")
    rest = tx.strip(F.array_join(F.filter(F.slice(lines, 2, F.size(lines)), lambda x: ~F.ltrim(x).startswith("#")), "\n"))
    parts = blocks.select("draft_id", "at", F.when(headed, F.regexp_replace(F.element_at(lines, 1), r"^#+\s*", "")).alias("heading"), F.when(headed, rest).otherwise(F.col("block")).alias("body"))
    order = Window.partitionBy("draft_id").orderBy("at")
    placed = parts.withColumn("section", F.coalesce(F.last("heading", ignorenulls=True).over(order), F.lit("Preamble"))).where("body <> ''")
    plain = F.trim(F.regexp_replace(tx.without_citations(F.col("body")), r"\s+", " "))
    cites = F.filter(tx.cited_numbers(F.col("body")), lambda n: n > 0)
    return placed.select("draft_id", (F.row_number().over(order) - 1).alias("claim"), "section", plain.alias("text"), cites.alias("cites"))


def claim_edges(claimed: DataFrame) -> DataFrame:
    """(draft_id, src, dst): from each cited piece of evidence to its claim, from each claim to its section."""
    name = F.concat(F.lit("claim-"), F.col("claim").cast("string"))
    cites = claimed.select("draft_id", F.explode(F.transform("cites", lambda n: F.concat(F.lit("cite-"), n.cast("string")))).alias("src"), name.alias("dst"))
    sections = claimed.select("draft_id", name.alias("src"), F.concat(F.lit("section-"), F.col("section")).alias("dst"))
    return cites.unionByName(sections).distinct()


#: Rounds of one step each before chains are taken in jumps, and the jumps of a round: 2 ** JUMPS steps.
PLAIN_ROUNDS, JUMPS = 8, 10


def reachable(edges: DataFrame, starts: DataFrame, forward: bool = True, max_steps: int | None = None) -> DataFrame:
    """(start, node) of all nodes that edges (src, dst) lead to from each start (start), itself included.

    A round joins only what the last one has newly reached to the edges, and drops by an anti join what is reached
    already; so cycles end, and a node with many paths counts once.  Rounds are written, none is kept in the plan.  After
    PLAIN_ROUNDS nodes with a single successor are left by jumps of 1, 2, 4... steps, so that a chain takes few rounds.
    Edges and starts with a null are left out; max_steps ends the walk after so many steps."""
    spark = edges.sparkSession
    a, b = ("src", "dst") if forward else ("dst", "src")
    root = work_dir(spark, "reachable")
    steps = cut(edges.select(F.col(a).cast("string").alias("node"), F.col(b).cast("string").alias("next")).where("node is not null and next is not null").distinct(), f"{root}/steps")
    rounds, jumps = f"{root}/rounds", None
    starts.select(F.col("start").cast("string").alias("start"), F.col("start").cast("string").alias("node")).where("start is not null").distinct().write.parquet(f"{rounds}/round=0")
    schema, at = "start string, node string, round int", 0
    while max_steps is None or at < max_steps:
        reached = spark.read.schema(schema).parquet(rounds)
        new = reached.where(F.col("round") == at).join(steps, "node").select("start", F.col("next").alias("node")).distinct()
        if at >= PLAIN_ROUNDS and max_steps is None:
            jumps = jumps or chain_jumps(steps, f"{root}/jumps")
            for k in range(JUMPS):
                step = jumps.where(F.col("k") == k).select("node", "next")
                both = F.array_compact(F.array("node", "next"))
                new = new.join(step, "node", "left").select("start", F.explode(both).alias("node")).distinct()
        at += 1
        new.join(reached, ["start", "node"], "left_anti").write.parquet(f"{rounds}/round={at}")
        if spark.read.schema("start string, node string").parquet(f"{rounds}/round={at}").isEmpty():
            break
    return spark.read.schema(schema).parquet(rounds).select("start", "node")


def chain_jumps(steps: DataFrame, path: str) -> DataFrame:
    """(k, node, next): where 2 ** k steps lead from a node, of nodes from which each of these steps is the only one."""
    spark = steps.sparkSession
    now = steps.groupBy("node").agg(F.min("next").alias("next"), F.count("*").alias("n")).where("n = 1").select("node", "next")
    for k in range(JUMPS):
        now.write.parquet(f"{path}/k={k}")
        now = spark.read.schema(now.schema).parquet(f"{path}/k={k}")
        now = now.join(now.select(F.col("node").alias("next"), F.col("next").alias("after")), "next").select("node", F.col("after").alias("next"))
    return spark.read.schema("node string, next string, k int").parquet(path)


def used_citations(claimed: DataFrame, evidence: DataFrame) -> DataFrame:
    """evidence with used: whether any claim cites it."""
    cited = claimed.select(F.explode("cites").alias("n")).distinct().withColumn("used", F.lit(True))
    return evidence.join(cited, "n", "left").withColumn("used", F.coalesce("used", F.lit(False)))


def gaps(evidence: DataFrame, messages: Mapping[str, str]) -> DataFrame:
    """(feed, gap): what to say of feeds that brought nothing."""
    said = F.create_map(*(F.lit(x) for pair in messages.items() for x in pair))
    return feeds(evidence).where("empty").select("feed", F.element_at(said, F.col("feed")).alias("gap")).where("gap is not null")
