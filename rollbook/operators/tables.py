"""Keyed writes as DataFrame operators: replace, upsert, patch, reassign, expand, delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def replace_by_key(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """All rows of a key present in ``incoming`` are replaced by its rows."""
    return current.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], version: list[str] | None = None) -> DataFrame:
    """Incoming rows replace rows of the same keys; the latest by ``version`` wins among them."""
    latest = incoming if version is None else latest_by(incoming, keys, version)
    return current.join(latest, keys, "left_anti").unionByName(latest, allowMissingColumns=True)


def latest_by(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """One row a key, the one with the greatest ``version``; a partial aggregate, no sort."""
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*version)).alias("r")).select("r.*")


def patch(current: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Overwrite ``columns`` on matching keys; a change may set a column to null.

    ``changes`` has one row a key. Rows without a change, and other columns, stay.
    """
    c = changes.select(*keys, F.lit(True).alias("_hit"), *[F.col(x).alias(f"_new_{x}") for x in columns])
    out = current.join(c, keys, "left")
    pick = lambda x: F.when(F.col("_hit"), F.col(f"_new_{x}")).otherwise(F.col(x)) if x in current.columns \
        else F.col(f"_new_{x}")
    out = out.withColumns({x: pick(x) for x in columns})
    return out.drop("_hit", *[f"_new_{x}" for x in columns])


def reassign(assignments: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """At most one worker per sheet: the newest assignment replaces older ones."""
    return latest_by(assignments.unionByName(incoming, allowMissingColumns=True), ["project_id"], order)


def expand_counts(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sheets, lines) for hand counts: n approved placeholder lines each, n at least 1.

    ``entries``: project_id, worker_id, sig_count, notes, entered_at.
    """
    ok = entries.where("sig_count >= 1")
    sheets = ok.select(
        "project_id", "worker_id", F.lit("[manual entry]").alias("pdf_path"), F.lit("").alias("county"),
        F.lit("").alias("cause"), F.col("entered_at").alias("created_at"), F.col("sig_count").alias("total_lines"),
        F.col("sig_count").alias("approved"), F.lit(0).alias("review"), F.lit(0).alias("rejected"),
        F.lit(0).alias("duplicates"), F.col("sig_count").alias("manual_sig_count"))
    lines = ok.select(
        "project_id", F.explode(F.sequence(F.lit(1), F.col("sig_count").cast("int"))).alias("line_number"), "notes").select(
        "project_id", "line_number", F.lit(1).alias("page"),
        F.concat(F.lit("Manual entry "), F.col("line_number").cast("string")).alias("raw_name"),
        F.lit("").alias("raw_address"), F.lit("").alias("raw_date"), F.lit(True).alias("signature_present"),
        F.lit("approved").alias("status"), F.col("notes").alias("staff_notes"))
    return sheets, lines


def delete_by_key(current: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return current.join(keys.select(*on).distinct(), on, "left_anti")


def first_by(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """One row a key, the one that sorts first; a partial aggregate, no sort."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    return df.groupBy(*named).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


def drop_duplicate_people(people: DataFrame, children: dict[str, DataFrame], key: list[Column],
                          order: list[Column], child_key: str = "worker_id") -> dict[str, DataFrame]:
    """Keep the first person of each key and delete the child rows of the others."""
    kept = first_by(people, key, order)
    gone = people.join(kept.select(child_key), child_key, "left_anti")
    out = {"people": kept}
    out.update({name: delete_by_key(df, gone, [child_key]) for name, df in children.items()})
    return out


def split_failures(results: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good rows, failed rows with status and the whole error text)."""
    bad = results.where(F.col(error).isNotNull()).withColumns({
        "status": F.lit("failed"), "error_msg": F.col(error)}).drop(error)
    return results.where(F.col(error).isNull()).drop(error), bad


# ── lists ────────────────────────────────────────────────────────────────────

def listed(df: DataFrame, equals: dict | None = None, time: str | None = None, time_from=None, time_to=None,
           order: list | None = None, limit: int | None = None) -> DataFrame:
    """Optional equality and inclusive range filters; None and '' mean no filter."""
    for col, value in (equals or {}).items():
        if value is not None and value != "":
            df = df.where(F.col(col) == F.lit(value))
    if time_from is not None:
        df = df.where(F.col(time) >= time_from)
    if time_to is not None:
        df = df.where(F.col(time) <= time_to)
    if order:
        df = df.orderBy(*order)
    return df.limit(limit) if limit else df


def page_of(df: DataFrame, keys: list[str], order: list, page: int = 1, size: int = 50) -> DataFrame:
    """Rows of one page per key, with the key's total row count."""
    w = Window.partitionBy(*keys).orderBy(*order)
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    lo, hi = (page - 1) * size, page * size
    ranked = df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= hi).where(F.col("rn") > lo)
    return ranked.join(total, keys)


def visible(df: DataFrame, viewer_id: int | None, is_reviewer: bool, owner: str = "worker_id") -> DataFrame:
    """Reviewers see all rows, others their own."""
    return df if is_reviewer else df.where(F.col(owner) == F.lit(viewer_id))


def visible_to(df: DataFrame, viewers: DataFrame, owner: str = "worker_id") -> DataFrame:
    """(viewer_id, row) for non-reviewers: an equi-join of rows to their owners.

    Reviewers see the whole table; give them ``df`` itself rather than a copy each.
    """
    own = viewers.where(~F.col("is_reviewer")).select("viewer_id")
    return own.join(df, F.col("viewer_id") == F.col(owner))


def visible_counts(df: DataFrame, viewers: DataFrame, owner: str = "worker_id") -> DataFrame:
    """(viewer_id, n_rows): how many rows each viewer sees, reviewers included; no row is copied for a reviewer."""
    per = df.groupBy(F.col(owner).alias("viewer_id")).agg(F.count(F.lit(1)).alias("own"))
    every = df.agg(F.count(F.lit(1)).alias("every"))
    own = viewers.join(per, "viewer_id", "left")
    return own.join(F.broadcast(every)).select(
        "viewer_id", F.when(F.col("is_reviewer"), F.col("every")).otherwise(F.coalesce("own", F.lit(0))).alias("n_rows"))
