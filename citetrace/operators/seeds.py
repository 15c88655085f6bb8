"""Seeds: notice rows to records, duplicates, resolution and keyed merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citetrace.functions import identifiers as ids

FAR = "9999-12-31"


def from_notices(rows: DataFrame) -> DataFrame:
    """Seed records of notice rows: those that are notices and have a record id, under either of its names."""
    have = set(rows.columns)
    col = lambda name: F.col(f"`{name}`") if name in have else F.lit(None).cast("string")
    record = F.coalesce(ids.as_text(col("Record ID")), ids.as_text(col("RecordID")))  # row by row
    out = rows.select(
        record.alias("record_id"),
        ids.as_text(col("Title")).alias("title"),
        ids.as_text(col("RetractionNature")).alias("notice_type"),
        ids.parse_date(col("RetractionDate")).alias("notice_date"),
        ids.parse_date(col("OriginalPaperDate")).alias("original_paper_date"),
        ids.doi(col("OriginalPaperDOI")).alias("original_doi"),
        ids.pmid(col("OriginalPaperPubMedID")).alias("original_pmid"),
        *[ids.as_text(col(n)).alias(a) for n, a in (("Author", "author"), ("Journal", "journal"), ("Publisher", "publisher"), ("Subject", "subject"), ("Reason", "reason"), ("ArticleType", "article_type"), ("Country", "country"))],
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("source_row_json"),
    )
    return out.where(ids.is_notice(F.col("notice_type")) & F.col("record_id").isNotNull())


def _by_notice(*partition: str) -> Window:
    return Window.partitionBy(*partition).orderBy(F.coalesce("notice_date", F.lit(FAR).cast("date")), "record_id")


def partition_by_doi(seeds: DataFrame) -> DataFrame:
    """``seeds`` with seed_class: the earliest record of a DOI is canonical, the others duplicate; no_doi without one."""
    place = F.row_number().over(_by_notice("original_doi"))
    kind = F.when(F.col("original_doi").isNull(), "no_doi").when(place == 1, "canonical").otherwise("duplicate")
    return seeds.withColumn("seed_class", kind)


def prepare(seeds: DataFrame) -> DataFrame:
    """Statuses and node ids of seeds resolved by DOI alone."""
    status = {"canonical": "resolved", "duplicate": "duplicate_doi", "no_doi": "no_doi"}
    kind = F.create_map(*[F.lit(x) for pair in status.items() for x in pair])
    out = partition_by_doi(seeds).withColumn("resolved_status", kind[F.col("seed_class")])
    return out.withColumn("node_id", F.when(F.col("original_doi").isNotNull(), F.concat(F.lit("doi:"), "original_doi"))).drop("seed_class")


def mark_duplicates(seeds: DataFrame) -> DataFrame:
    """Of linked records of one paper the earliest notice stays resolved, the others become duplicate_node."""
    order = Window.partitionBy("node_id").orderBy(F.col("notice_date").asc_nulls_last(), "record_id")
    status = F.when(F.col("node_id").isNull(), F.col("resolved_status")).when(F.row_number().over(order) == 1, "resolved").otherwise("duplicate_node")
    return seeds.withColumn("resolved_status", status)


def canonical(seeds: DataFrame) -> DataFrame:
    """One row for each linked paper: earliest record and date, all distinct record ids, all notice types. A paper's records, which its row lists, are held together."""
    key = F.struct(F.coalesce("notice_date", F.lit(FAR).cast("date")).alias("d"), F.col("record_id").alias("r"))
    listed = F.sort_array(F.collect_list(F.struct(key.alias("k"), F.col("record_id"), F.col("notice_type"))))
    grouped = seeds.where("node_id is not null").groupBy("node_id").agg(
        F.count_distinct("record_id").alias("seed_record_count"),
        listed.alias("rows"),
        F.min("notice_date").alias("notice_date"),
        F.min_by("title", F.when(F.col("title").isNotNull(), key)).alias("title"),
    )
    types = F.array_distinct(F.filter(F.transform("rows", lambda x: x["notice_type"]), lambda x: x.isNotNull()))
    return grouped.select(
        "node_id",
        F.col("rows")[0]["record_id"].alias("record_id"),
        F.col("seed_record_count").cast("long").alias("seed_record_count"),
        F.array_join(F.array_distinct(F.transform("rows", lambda x: x["record_id"])), ";").alias("seed_record_ids"),
        F.array_join(types, "; ").alias("notice_type"),
        "notice_date",
        "title",
    )


def duplicate_counts(seeds: DataFrame) -> DataFrame:
    n = F.col("n")
    per_paper = seeds.where("node_id is not null").groupBy("node_id").agg(F.count("*").alias("n"))
    return per_paper.agg(
        F.count("*").alias("resolved_seed_papers"),
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("duplicate_resolved_seed_records"),
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("duplicate_seed_rows_in_duplicate_groups"),
    )


def resolve(seeds: DataFrame, works: DataFrame, title_fallback: bool = True, limit: int | None = None) -> DataFrame:
    """Seeds linked to works by DOI, else PMID, else title and author, with how (works: node_id, doi, pmid, title, authors).

    Without ``title_fallback`` the unlinked ones wait for it, with it they are not found. ``limit`` takes the first seeds by record id.
    """
    if limit is not None:
        seeds = seeds.orderBy("record_id").limit(limit)
    by = lambda key, name: works.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_{name}")).agg(F.min("node_id").alias(name))
    by_doi, by_pmid = by("doi", "by_doi"), by("pmid", "by_pmid")
    rows = seeds.join(by_doi, F.col("original_doi") == F.col("_by_doi"), "left").join(by_pmid, F.col("original_pmid") == F.col("_by_pmid"), "left")
    titled = resolve_title_author(seeds, works).select(F.col("record_id").alias("_r"), F.col("node_id").alias("by_title"))
    rows = rows.join(titled, F.col("record_id") == F.col("_r"), "left") if title_fallback else rows.withColumn("by_title", F.lit(None).cast("string"))
    how = F.when(F.col("by_doi").isNotNull(), "doi").when(F.col("by_pmid").isNotNull(), "pmid").when(F.col("by_title").isNotNull(), "title_author")
    node = F.coalesce("by_doi", "by_pmid", "by_title")
    left = "not_found" if title_fallback else "pending_title_fallback"
    return rows.select(
        *seeds.columns, node.alias("resolved_node"), F.coalesce(how, F.lit("all" if title_fallback else "exact")).alias("resolved_by"), F.when(node.isNotNull(), "resolved").otherwise(left).alias("status")
    )


def resolve_stats(resolved: DataFrame) -> DataFrame:
    """One row of what ``resolve`` did: seeds resolved, not found, waiting for their title, and look-ups made (one for each identifier or title tried)."""
    by, status = F.col("resolved_by"), F.col("status")
    doi, pmid, title = F.col("original_doi").isNotNull(), F.col("original_pmid").isNotNull(), F.col("title").isNotNull()
    tried = doi.cast("long") + (pmid & (by != "doi")).cast("long") + (title & by.isin("title_author", "all")).cast("long")
    return resolved.agg(
        F.count_if(status == "resolved").alias("resolved"), F.count_if(status == "not_found").alias("not_found"),
        F.count_if(status == "pending_title_fallback").alias("pending_title_fallback"), F.coalesce(F.sum(tried), F.lit(0)).alias("checked"),
    )


def title_key(c: Column) -> Column:
    """Compared form of a title: its lower-case words, of letters, marks and digits of all scripts."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{M}\\p{N}]+", " ")), F.lit(""))


def resolve_title_author(seeds: DataFrame, works: DataFrame) -> DataFrame:
    """(record_id, node_id): of works of the same title the one with the author, else the first by rank, then by id."""
    last = F.lower(ids.author_last_name(F.col("author")))
    s = seeds.select("record_id", title_key(F.col("title")).alias("t"), last.alias("last"))
    w = works.select(title_key(F.col("title")).alias("t"), F.col("node_id"), "authors", "rank")
    hit = F.coalesce(F.exists("authors", lambda a: F.lower(a).contains(F.col("last"))), F.lit(False))
    best = F.min_by("node_id", F.struct((~hit).alias("miss"), F.coalesce("rank", F.lit(2147483647)).alias("rank"), F.col("node_id")))
    return s.join(w, "t").groupBy("record_id").agg(best.alias("node_id"))


def unresolved(seeds: DataFrame, limit: int | None = None, pending_title: bool = True) -> DataFrame:
    done = ["no_doi", "duplicate_doi", "unresolvable"] + ([] if pending_title else ["pending_title_fallback"])
    out = seeds.where(F.col("node_id").isNull() & ~F.coalesce("resolved_status", F.lit("")).isin(done)).orderBy("record_id")
    return out.limit(limit) if limit is not None else out


def propagate_retracted(works: DataFrame, seeds: DataFrame) -> DataFrame:
    """``works`` with is_retracted: whether a seed is linked to the work."""
    flagged = seeds.where("node_id is not null").select(F.col("node_id").alias("_seed")).distinct()
    return works.join(flagged, works.node_id == flagged["_seed"], "left").withColumn("is_retracted", F.col("_seed").isNotNull()).drop("_seed")


def last_wins(rows: DataFrame, keys: list[str], order: tuple[str | Column, ...] = ("seq",)) -> DataFrame:
    """The last row of each key, nulls included: what repeated upserts leave. Aggregated map-side."""
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_row.*")
