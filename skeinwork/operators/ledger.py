"""Incremental writes as set operations: anti-joins and unions for tables without row updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions import text as T


def normalised(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): candidates(source_id, url, title, raw_content, ...) trimmed, with excerpt and hash; rows with a blank title or URL are set aside, never dropped."""
    trimmed = candidates.withColumns({"title": T.compact(F.col("title")), "url": F.trim(F.coalesce("url", F.lit(""))), "raw_content": T.compact(F.col("raw_content"))})
    good = (F.col("title") != "") & (F.col("url") != "")
    full = trimmed.where(good).withColumns({"canonical_url": T.without_fragment(F.col("url")), "content_excerpt": T.excerpt(F.col("raw_content")), "content_hash": T.content_hash(F.col("title"), F.col("raw_content")), "status": F.lit("new")})
    return full, trimmed.where(~good)


def new_rows(batch: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows of the batch whose key isn't in the ledger, one a key, of rows that are equal but for what is passed over here; null keys are never new."""
    one = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
    return one.join(ledger.select(key), key, "left_anti")


def enriched(ledger: DataFrame, batch: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """The ledger with `fields` taken from the batch where it has a value; content and all other columns stay."""
    news = batch.groupBy(F.col(key).alias("__key")).agg(*[F.max(f).alias(f"__{f}") for f in fields])
    return ledger.join(news, ledger[key] == news["__key"], "left").withColumns({f: F.coalesce(f"__{f}", f) for f in fields}).drop("__key", *[f"__{f}" for f in fields])


def upserted(base: DataFrame, new: DataFrame, key: str, kept: tuple[str, ...]) -> DataFrame:
    """base with rows of `new` inserted or updated by key; columns in `kept` of existing rows are preserved."""
    b, n = base.alias("b"), new.dropDuplicates([key]).alias("n")
    out = []
    for c in base.columns:
        old, fresh = F.col(f"b.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None).cast(base.schema[c].dataType)
        known = F.col(f"b.{key}").isNotNull()
        out.append((F.when(known, old).otherwise(fresh) if c in kept or c not in new.columns else F.when(F.col(f"n.{key}").isNotNull(), fresh).otherwise(old)).alias(c))
    return b.join(n, F.col(f"b.{key}") == F.col(f"n.{key}"), "full_outer").select(*out)


def patched(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """base with the fields of patch(key, field, value) set: only submitted fields change; values are cast to the column's type, '' becomes null."""
    wide = patch.groupBy(F.col(key).alias("__key")).agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("value")))).alias("__set"))
    out = base.join(wide, base[key] == wide["__key"], "left")
    sets = {c: F.when(F.coalesce(F.map_contains_key("__set", F.lit(c)), F.lit(False)), F.when(F.element_at("__set", F.lit(c))["value"] != "", F.element_at("__set", F.lit(c))["value"]).try_cast(base.schema[c].dataType)).otherwise(F.col(c)) for c in base.columns if c != key}
    return out.withColumns(sets).drop("__key", "__set")


def deletable(base: DataFrame, references: DataFrame, key: str, by: str) -> DataFrame:
    """Rows of base that no row of references points at; only these may be deleted."""
    return base.join(references.select(F.col(by).alias(key)).distinct(), key, "left_anti")


def rewritten_urls(rows: DataFrame, moved: dict[str, str]) -> DataFrame:
    """rows with url and canonical_url replaced where they equal an old address."""
    if not moved:
        return rows
    table = F.create_map(*[F.lit(x) for kv in moved.items() for x in kv])
    return rows.withColumns({c: F.coalesce(F.element_at(table, F.col(c)), F.col(c)) for c in ("url", "canonical_url")})


def first_by(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key; Spark keeps a group limit below the shuffle."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def numbered(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """rows with `place`, from 1, in the order within each key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def backfilled_dates(raw: DataFrame) -> DataFrame:
    """(id, day, origin) of rows without published_at: the labelled date of the text, else the date of the URL; rows with neither are left out."""
    missing = raw.where(F.col("published_at").isNull())
    by_text, by_url = T.text_date(F.col("raw_content")), T.url_date(F.col("url"))
    dated = missing.select("id", F.coalesce(by_text, by_url).cast("string").alias("day"), F.when(by_text.isNotNull(), "text").otherwise("url").alias("origin")).where("day is not null")
    return dated.dropDuplicates(["id"])
