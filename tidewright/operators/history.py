"""Change capture and versions over append-only tables.

Content is told apart by hash. "Current" is a window over events; nothing is updated in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(*columns: str | Column, length: int | None = None) -> Column:
    """SHA-256, lower-case hex, of one string, or of the canonical JSON of several columns
    (fields by name); length keeps a prefix."""
    text = columns[0] if len(columns) == 1 else F.to_json(F.struct(*sorted(columns, key=str)))
    h = F.sha2((F.col(text) if isinstance(text, str) else text).cast("string"), 256)
    return F.substring(h, 1, length) if length else h


def snapshot_diff(previous: DataFrame, current: DataFrame, keys: Sequence[str], hash: str = "hash") -> DataFrame:
    """keys, old_hash, new_hash and status (new, changed, unchanged, gone) of every key."""
    old = previous.select(*keys, F.col(hash).alias("old_hash"), F.lit(True).alias("_old"))
    new = current.select(*keys, F.col(hash).alias("new_hash"), F.lit(True).alias("_new"))
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged").otherwise("changed")
    return old.join(new, list(keys), "full").select(*keys, "old_hash", "new_hash", status.alias("status"))


def new_versions(stored: DataFrame, items: DataFrame, keys: Sequence[str], hash: str = "hash") -> DataFrame:
    """Items whose (keys, hash) is not stored yet, once each: what an append-only store takes."""
    k = [*keys, hash]
    return items.dropDuplicates(k).join(stored.select(*k), k, "left_anti")


def upsert(versions: DataFrame, docs: DataFrame, key: str, hash: str = "hash", version: str = "version") -> DataFrame:
    """docs with action (created, updated, unchanged) and the version that they get; only those
    not unchanged are to be appended."""
    last = versions.groupBy(key).agg(F.max(version).alias("_v"), F.max_by(hash, version).alias("_h"))
    out = docs.join(last, key, "left")
    action = F.when(F.col("_v").isNull(), "created").when(F.col("_h").eqNullSafe(F.col(hash)), "unchanged").otherwise("updated")
    return out.withColumn("action", action).withColumn(version, F.coalesce("_v", F.lit(0)) + (F.col("action") != "unchanged").cast("int")).drop("_v", "_h")


def replace_edges(stored: DataFrame, fresh: DataFrame, prefixes: Sequence[str] = ()) -> DataFrame:
    """Edges after a load: all of them replaced, or only those whose src has one of the
    prefixes."""
    if not prefixes:
        return fresh
    mine = F.lit(False)
    for p in prefixes:
        mine |= F.col("src").startswith(p)
    return stored.where(~F.coalesce(mine, F.lit(False))).unionByName(fresh.where(mine))


def missing(stored: DataFrame, keep: DataFrame, key: str, type_: str | None = None, types: Sequence[str] = ()) -> DataFrame:
    """Stored rows that the last load no longer has, of the given types."""
    rows = stored.where(F.col(type_).isin(*types)) if type_ and types else stored
    return rows.join(keep.select(key), key, "left_anti")


def purge(tables: dict[str, tuple[DataFrame, Column]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the rows of their conditions, and (table, n) of the rows that go."""
    left = {name: df.where(~F.coalesce(cond, F.lit(False))) for name, (df, cond) in tables.items()}
    counts = [df.where(cond).agg(F.lit(name).alias("table"), F.count("*").alias("n")) for name, (df, cond) in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return left, out


def with_versions(events: DataFrame, key: str, order: Sequence[str], content: str) -> DataFrame:
    """events numbered as versions of their key from 1, with the content before."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumns({"version": F.row_number().over(w).cast("long"), "prev_content": F.lag(content).over(w)})


def current(versions: DataFrame, key: str, version: str = "version") -> DataFrame:
    """The last version of each key; tombstones (deleted = true), if that column is there, hide
    it. One aggregation, no sort."""
    rest = [c for c in versions.columns if c != key]
    last = versions.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(key, "_r.*")
    return last.where(~F.coalesce("deleted", F.lit(False))).select(*versions.columns) if "deleted" in rest else last.select(*versions.columns)


def keep_last(versions: DataFrame, key: str, n: int, version: str = "version") -> DataFrame:
    """Versions within the last n numbers of their key."""
    return versions.withColumn("_top", F.max(version).over(Window.partitionBy(key))).where(F.col(version) > F.col("_top") - n).drop("_top")


def recent_updates(versions: DataFrame, key: str, order: Sequence[Column], limit: int) -> DataFrame:
    """The newest current versions (a feature with a limit: a top-k report)."""
    return current(versions, key).orderBy(*order).limit(limit)


def before_blocked(versions: DataFrame, blocked: DataFrame, key: str, hash: str, at: Sequence[str]) -> DataFrame:
    """The latest version of each key whose hash is not blocked."""
    ok = versions.join(blocked.select(hash).distinct(), hash, "left_anti")
    rest = [c for c in ok.columns if c != key]
    return ok.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("_r")).select(key, "_r.*")


def substitute_blocked(items: DataFrame, versions: DataFrame, blocked: DataFrame, key: str, hash: str, at: Sequence[str]) -> DataFrame:
    """items with each blocked content replaced by the latest stored one that is not blocked;
    those without such a one go. substituted marks them."""
    bad = blocked.select(hash).distinct()
    fine = items.join(bad, hash, "left_anti").withColumn("substituted", F.lit(False))
    old = before_blocked(versions, blocked, key, hash, at)
    swapped = old.join(items.join(bad, hash, "left_semi").select(key), key, "left_semi").withColumn("substituted", F.lit(True))
    return fine.unionByName(swapped.select(*fine.columns))


def undo(versions: DataFrame, targets: DataFrame, key: str, content: str, version: str = "version") -> DataFrame:
    """The rows that undo the last version of each target: (key, version, content, deleted).

    The content before becomes a new version; a key of one version gets a tombstone."""
    w = Window.partitionBy(key).orderBy(version)
    rows = versions.withColumns({"_prev": F.lag(content).over(w), "_last": F.lead(version).over(w).isNull()})
    last = rows.where("_last").join(targets.select(key).distinct(), key, "left_semi")
    first = F.col(version) == 1
    return last.select(key, (F.col(version) + 1).alias(version), F.when(first, F.lit(None)).otherwise(F.col("_prev")).alias(content), first.alias("deleted"))


def undo_candidates(versions: DataFrame, run: str, key: str, hash: str, version: str = "version") -> DataFrame:
    """Versions with what undoing each would restore, and whether it still is the last one."""
    w = Window.partitionBy(key).orderBy(version)
    return versions.withColumns({"restores": F.lag(hash).over(w), "is_last": F.lead(version).over(w).isNull()}).select(run, key, version, hash, "restores", "is_last")


def active_blocks(events: DataFrame, hash: str = "hash", at: str = "at", action: str = "action") -> DataFrame:
    """Hashes whose latest event is a block."""
    return events.groupBy(hash).agg(F.max_by(action, at).alias("_a"), F.max(at).alias(at)).where("_a = 'block'").select(hash, at)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per group, the first in order. One aggregation, no window sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def section_changes(old: DataFrame, new: DataFrame, key: str, section: str, body: str) -> DataFrame:
    """(key, section, change): sections that were added, changed or removed."""
    a = old.select(key, section, F.col(body).alias("_a"), F.lit(1).alias("_o"))
    b = new.select(key, section, F.col(body).alias("_b"), F.lit(1).alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, [key, section], "full").select(key, section, change.alias("change")).where("change IS NOT NULL")
