"""Identity, dedupe, ordering, paging, upkeep of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from valuetide.functions import actions as act
from valuetide.functions.addresses import normalize_address
from valuetide.functions.text import text_or_blank
from valuetide.operators.stitch import transfer_key
from valuetide.session import cut_lineage


def keep_best(df: DataFrame, keys: list[str | Column], best: Column, smallest: bool = True) -> DataFrame:
    """One row per key.

    Each task keeps its best row of a key before rows are moved, so a key with very many copies is no hot spot; only
    the columns that are read later on are moved. Of equally good rows the last one read stays.
    """
    named = {f"_key{i}": F.col(k) if isinstance(k, str) else k for i, k in enumerate(keys)}
    first = Window.partitionBy(*named).orderBy(F.asc(best) if smallest else F.desc(best), F.desc("_read"))
    return df.withColumns(named | {"_read": F.monotonically_increasing_id()}).withColumn("_nth", F.row_number().over(first)).where("_nth = 1").select(*df.columns)


def action_key(actions: DataFrame) -> DataFrame:
    """Canonical actions with their identity and the tx id that stands for them."""
    return actions.withColumns({"key": act.action_key(), "synthetic_tx": act.synthetic_tx()})


def merge_histories(*sources: DataFrame, key: str = "key") -> DataFrame:
    """Union of histories; the earlier source wins per key, the row's own order breaks ties."""
    tagged = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, tagged).where(F.col(key).isNotNull())
    return keep_best(rows, [F.col(key).alias("_key")], F.struct("_source", "_tie")).drop("_source", "_tie", "_key")


def dedupe_transfers(transfers: DataFrame) -> DataFrame:
    """One row per movement, the most confident one."""
    order = F.struct(-F.col("confidence"), *[F.col(c) for c in ("source_rank", "time") if c in transfers.columns])
    return keep_best(transfers, [transfer_key().alias("_key")], order)


def dedupe_canonical_swaps(segments: DataFrame) -> DataFrame:
    """First segment per canonical swap; segments without a canonical key pass."""
    swaps = segments.where("canonical_key IS NOT NULL")
    firsts = keep_best(swaps, [F.col("canonical_key").alias("_key")], F.col("ord"))
    return segments.where("canonical_key IS NULL").unionByName(firsts.select(*segments.columns))


def swap_dedupe_counts(segments: DataFrame) -> DataFrame:
    """Emitted and dropped swap segments, one row."""
    swaps = segments.where("canonical_key IS NOT NULL AND action_class = 'swaps'")
    per_key = swaps.groupBy("canonical_key").agg(F.count("*").alias("n"))
    return per_key.agg(
        F.count("*").alias("swap_emitted"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("swap_deduped")
    )


def sort_newest_first(df: DataFrame, key: str = "uid") -> DataFrame:
    return df.orderBy(F.desc_nulls_last("ts"), F.desc("height_n"), F.desc(key))


def sort_outputs(nodes: DataFrame, edges: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        nodes.orderBy("depth", "stage", "label", "key"),
        edges.orderBy(F.desc("usd_spot"), "edge_id"),
        actions.orderBy(F.asc_nulls_first("time"), "tx_id", "edge_id"),
    )


PAGE_ROWS = 50


def page_actions(
    actions: DataFrame, direction: str = "newest", offset: int = 0, batch: int = 10, key: str = "uid"
) -> tuple[DataFrame, DataFrame]:
    """A window of ``batch`` pages of an address's history and its paging facts.

    ``offset`` counts pages from the newest row; the oldest window counts them from
    the end of the exact row count. Ranks come from a range-partitioned sort plus
    partition offsets, so no single task orders the whole history.
    """
    if batch < 1:
        raise ValueError("batch must be at least one page")
    ranked = global_rank(actions, [F.desc_nulls_last("ts"), F.desc("height_n"), F.desc(key)])
    total = actions.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / PAGE_ROWS))
    if direction == "oldest":
        start = F.greatest(F.lit(0), F.col("pages") - batch if offset == 0 else F.lit(offset))
        facts = total.select(
            "total", start.alias("start_page"), (start > 0).alias("has_more"), F.greatest(F.lit(0), start - batch).alias("next_offset")
        )
    else:
        facts = total.select(
            "total", F.lit(offset).cast("bigint").alias("start_page"), (F.col("pages") > offset + batch).alias("has_more"),
            F.lit(offset + batch).cast("bigint").alias("next_offset"),
        )
    first = facts.select("start_page").scalar() * PAGE_ROWS
    window = ranked.where((F.col("_rank") > first) & (F.col("_rank") <= first + batch * PAGE_ROWS))
    return window.withColumnRenamed("_rank", "position"), facts


def global_rank(df: DataFrame, order: list[Column], out: str = "_rank") -> DataFrame:
    """1-based position in a total order without gathering all rows in one task."""
    return sorted_position(df.orderBy(*order), out)


def sorted_position(ordered: DataFrame, out: str = "_rank") -> DataFrame:
    """1-based position of the rows of a sorted table."""
    # ids that rise within each partition of the sort, written once so that counts and places agree
    placed = cut_lineage(ordered.withColumn("_id", F.monotonically_increasing_id()))
    part, within = F.shiftrightunsigned("_id", 33), F.col("_id") % F.lit(1 << 33) + 1
    local = placed.withColumns({"_part": part, "_local": within}).drop("_id")
    sizes = local.groupBy("_part").agg(F.max("_local").alias("_size"))
    # one row per partition of the sort
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return local.join(starts, "_part").withColumn(out, F.col("_start") + F.col("_local")).drop("_part", "_local", "_start")


def merge_coverage(new: DataFrame, old: DataFrame) -> DataFrame:
    """Stored windows after adding new ones; an equal window is replaced only by a complete or deeper one."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    better = F.struct((~F.col("truncated")).cast("int"), F.col("max_pages"), F.col("_new"), F.col("stored_at"))
    return keep_best(rows, ["address", "start_s", "end_s"], better, smallest=False).drop("_new")


def merge_two_sources_status(first: DataFrame, second: DataFrame, first_ok: bool, second_ok: bool) -> tuple[DataFrame, bool]:
    """Best-effort union of two sources; anything but two successes leaves it truncated."""
    parts = [df for df, ok in ((first, first_ok), (second, second_ok)) if ok]
    merged = merge_histories(*parts) if parts else first.limit(0).drop("_tie")
    return merged, not (first_ok and second_ok)


def upsert_addresses(addresses: DataFrame, changes: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace all addresses of changed actors; a repeated address inside one actor is an error.

    Returns (addresses, rejected actors).
    """
    norm = normalize_address("address")
    incoming = changes.withColumn("normalized", norm)
    bad = incoming.groupBy("actor_id", "normalized").agg(F.count("*").alias("n")).where("n > 1").select("actor_id").distinct()
    good = incoming.join(bad, "actor_id", "left_anti")
    touched = good.select("actor_id").unionByName(deleted.select("actor_id")).distinct()
    kept = addresses.withColumn("normalized", norm).join(touched, "actor_id", "left_anti")
    return kept.unionByName(good.join(deleted.select("actor_id"), "actor_id", "left_anti")), bad


def upsert_annotations(annotations: DataFrame, changes: DataFrame) -> DataFrame:
    """Last value per address and kind; a blank value deletes it. ``seq`` orders the changes."""
    rows = annotations.withColumn("seq", F.lit(-1).cast("bigint")).unionByName(changes)
    last = rows.groupBy("normalized_address", "kind").agg(F.max_by("value", "seq").alias("value"))
    return last.where(F.trim(text_or_blank("value")) != "")


def upsert_blocklist(blocklist: DataFrame, changes: DataFrame, removed: DataFrame) -> DataFrame:
    """First reason per address wins; removals apply last."""
    rows = blocklist.withColumn("seq", F.lit(-1).cast("bigint")).unionByName(changes)
    first = rows.groupBy("normalized_address").agg(F.min_by("reason", "seq").alias("reason"))
    return first.join(removed.select("normalized_address").distinct(), "normalized_address", "left_anti")


def list_actors(actors: DataFrame, addresses: DataFrame) -> DataFrame:
    """Actors by lower(name) with their addresses, one row each, in order; an actor without addresses has one row."""
    own = addresses.select("actor_id", "address_id", "address", "chain_hint", "label")
    return actors.join(own, "actor_id", "left").orderBy(F.lower("name"), "actor_id", F.lower("address"), "address_id")


def merge_height_ranges(heights: DataFrame, keys: list[str], padding: int = 2, gap: int = 24) -> DataFrame:
    """Padded heights merged into ranges when at most ``gap`` apart (gaps and islands); ``keys`` are needed."""
    if not keys:
        raise ValueError("merge_height_ranges needs at least one key")
    distinct = heights.select(*keys, "height").distinct()
    padded = distinct.select(*keys, F.greatest(F.lit(1), F.col("height") - padding).alias("s"), (F.col("height") + padding).alias("e"))
    in_order = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    islands = padded.withColumn("_new", F.coalesce((F.col("s") > reach + gap).cast("int"), F.lit(1))).withColumn(
        "_island", F.sum("_new").over(in_order)
    )
    return islands.groupBy(*keys, "_island").agg(F.min("s").alias("start_height"), F.max("e").alias("end_height")).drop("_island")


def preferred_source(rows: DataFrame, keys: list[str], status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the best-ranked provider that worked for each key, and which better ones did not.

    ``status``: keys + provider, rank, ok.
    """
    chosen = status.where("ok").groupBy(*keys).agg(F.min_by("provider", "rank").alias("_provider"), F.min("rank").alias("_rank"))
    kept = rows.join(chosen.select(*keys, F.col("_provider").alias("provider")), [*keys, "provider"], "left_semi")
    failed = status.where("NOT ok").join(chosen, keys, "left").where(F.col("_rank").isNull() | (F.col("rank") < F.col("_rank")))
    # a handful of providers per key
    notes = failed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "provider"))).alias("_f"))
    note = status.select(*keys).distinct().join(chosen, keys, "left").join(notes, keys, "left").select(
        *keys, F.col("_provider").alias("provider"), F.array_join(F.col("_f.provider"), ",").alias("skipped")
    )
    return kept, note


def covering_window_lookup(requests: DataFrame, windows: DataFrame) -> DataFrame:
    """Stored window per request: an exact one, else the narrowest complete one that contains it.

    ``requests``: request_id, address, want_start, want_end; ``windows``: address, start_s, end_s, truncated, window_id.
    The join is on the address with the containment as a residual; only the best
    window per request survives the map-side aggregate.
    """
    contains = (F.col("start_s") <= F.col("want_start")) & (F.col("end_s") >= F.col("want_end"))
    exact = (F.col("start_s") == F.col("want_start")) & (F.col("end_s") == F.col("want_end"))
    hits = requests.join(windows, "address").where(exact | (contains & ~F.col("truncated")))
    best = F.struct((~exact).cast("int"), F.col("end_s") - F.col("start_s"), F.col("window_id"))
    found = hits.groupBy("request_id").agg(F.min_by(F.struct("window_id", "start_s", "end_s", "truncated"), best).alias("w"))
    return found.select("request_id", "w.*")


def clip_rows(rows: DataFrame, matches: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows of matched windows clipped to the asked interval (unknown time stays)."""
    asked = matches.join(requests, "request_id").select("request_id", F.col("window_id"), "want_start", "want_end")
    return rows.join(asked, "window_id").where(
        F.col("time_s").isNull() | F.col("time_s").between(F.col("want_start"), F.col("want_end"))
    )


def lookup_by_tx(actions: DataFrame, tx_ids: DataFrame) -> DataFrame:
    """Actions that touch any of the given tx ids, shadow sends removed, newest first.

    The ids of those found are written, so that their size tells how to meet the actions; so are the actions found, which
    the search for shadows reads several times.
    """
    from valuetide.operators.suppress import shadow_send_antijoin

    wanted = tx_ids.select(F.upper(F.trim("tx_id")).alias("_tx")).distinct()
    hits = cut_lineage(actions.select("action_id", F.explode(act.tx_ids()).alias("_tx")).join(wanted, "_tx", "left_semi").select("action_id").distinct())
    return sort_newest_first(shadow_send_antijoin(cut_lineage(actions.join(hits, "action_id", "left_semi"))))


def tie(df: DataFrame, *columns: str) -> DataFrame:
    """Attach the order in which a source lists its rows."""
    return df.withColumn("_tie", F.struct(*columns))


