"""Choice sets: for each event the chosen item and sampled others that were on offer before the event.

Everything is joins and windows, so neither events nor catalogue need fit anywhere. The catalogue is laid on a line
by first sighting, each item a stretch as long as its weight; an event's pool is the line up to its time, and a draw
is a point on it. Points find their items by an equi-join on cells as wide as the mean weight, into which no more
items fit than the mean weight itself. Draws come from hashes of the event's own key: they don't depend on
partitioning, and a lost task makes the same ones again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .catalog import brand_map, dominant_category, first_seen, popularity, train
from .prefix import running

TINY = 1e-6
NO_CATEGORY = "Unknown"
#: Times the wanted number of negatives that are drawn for an event that a first round leaves short.
ROUNDS = 6
#: What the second round draws beyond the wanted number.
SPARE = 3


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) fixed by its parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def catalogue(events: DataFrame) -> DataFrame:
    """(asin, category, first_us, weight) of items that training rows have; others can't be drawn."""
    weights = popularity(events).select("asin", (F.col("popularity") + TINY).alias("weight"))
    return first_seen(events).join(weights, "asin").join(dominant_category(events), "asin")


def line(items: DataFrame, key: str | None = None) -> DataFrame:
    """Items with their stretch [low, high) of the line of their key, by first sighting, and the mean width of a stretch."""
    laid = running(items, ["first_us", "asin"], "weight", key, name="low").withColumn("high", F.col("low") + F.col("weight"))
    width = items.groupBy(*([key] if key else [])).agg(F.avg("weight").alias("width"))
    return laid.join(width, key) if key else laid.crossJoin(F.broadcast(width))  # one row


def _widths(laid: DataFrame, keys: list[str]) -> DataFrame:
    return laid.groupBy(*keys).agg(F.max("width").alias("width"))


def pools(events: DataFrame, laid: DataFrame, key: str | None = None) -> DataFrame:
    """Events with pool, the length of the line strictly before their time (0 where nothing was on offer), and the line's
    width."""
    keys = [key] if key else []
    last = laid.groupBy(*keys, F.col("first_us").alias("us")).agg(F.max("high").alias("_h"))
    times = events.select(*keys, "us").distinct().join(last, [*keys, "us"], "full")
    got = running(times, ["us"], "_h", key, how="max", name="pool").select(*keys, "us", "pool")
    widths = _widths(laid, keys)
    got = got.join(widths, keys, "left") if key else got.crossJoin(F.broadcast(widths))  # one row
    return events.join(got, [*keys, "us"], "left").withColumn("pool", F.coalesce("pool", F.lit(0.0)))


def drawn(points: DataFrame, laid: DataFrame, key: str | None = None) -> DataFrame:
    """Points (…, at) with the item whose stretch they lie in. Points that bring their line's width need no join for it."""
    keys = [key] if key else []
    if "width" not in points.columns:
        points = points.join(_widths(laid, keys), keys) if key else points.crossJoin(F.broadcast(_widths(laid, keys)))  # one row
    cell = lambda x: F.floor(x / F.col("width")).cast("long")
    cells = laid.select(*keys, "asin", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("_cell"))
    return points.withColumn("_cell", cell(F.col("at"))).drop("width").join(cells, [*keys, "_cell"]).filter((F.col("low") <= F.col("at")) & (F.col("at") < F.col("high"))).drop("_cell", "low", "high")


def choice_sets(events: DataFrame, negatives: int = 9, seed: int = 42, resamples: int = 1, distinct: bool = True) -> DataFrame:
    """(event_key, resample_k, chosen_asin, chosen_idx, choice_asins, dedup_fallback) of every event.

    Half of the negatives, rounded down, come from the event's category, the rest from the whole pool; a point that
    falls on the chosen item or, where items are to be ``distinct``, on one already taken makes room for the next draw.
    A first round draws one more of each kind than is wanted; only events it leaves short draw again, in a second round
    some more, in a third ROUNDS times as many. What a round leaves full, more draws wouldn't change. Draws carry a number
    of their event, not its key. Events whose pool has too few items repeat theirs, flagged; those without a pool repeat
    the chosen one.
    """
    same = negatives // 2
    base = events.select(
        F.concat_ws("|", "customer_id", "seq").alias("event_key"), "us", F.col("asin").alias("chosen_asin"), "category", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample_k")
    )
    items = stored(catalogue(events), "catalogue")
    whole_line = stored(line(items), "line")
    own_line = stored(line(items.filter(F.col("category") != NO_CATEGORY), "category"), "own-line")
    placed = pools(base, whole_line).withColumnsRenamed({"pool": "whole_pool", "width": "whole_width"})
    placed = pools(placed, own_line, "category").withColumnsRenamed({"pool": "own_pool", "width": "own_width"}).drop("us")
    placed = stored(placed.withColumn("event", F.monotonically_increasing_id()), "placed")

    def picked(of: DataFrame, near_draws: int, draws: int) -> DataFrame:
        """Some events with negatives: the category's first ones, then the pool's in order, then more of the category's."""
        each = lambda pool, n, tag: of.filter(F.col(f"{pool}_pool") > 0).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("at", uniform(F.lit(seed), F.lit(tag), "event_key", "resample_k", "d") * F.col(f"{pool}_pool"))
        point = lambda pool, first: ("event", (F.col("d") + first).alias("d"), "at", F.col(f"{pool}_width").alias("width"))
        near = drawn(each("own", near_draws, "own").select("category", *point("own", 0)), own_line, "category").drop("category")
        rest = drawn(each("whole", draws, "all").select(*point("whole", near_draws)), whole_line)
        # Dealt before they are grouped: half-made lists would take more room on the way than the draws.
        both = near.select("event", "d", "asin").unionByName(rest.select("event", "d", "asin")).repartition("event")
        drawn_ = of.join(both.groupBy("event").agg(F.collect_list(F.struct("d", "asin")).alias("all")), "event", "left")
        other = F.array_sort(F.filter("all", lambda x: x["asin"] != F.col("chosen_asin")))
        of_kind = lambda own: F.transform(F.filter(other, lambda x: (x["d"] < near_draws) == own), lambda x: x["asin"])
        lists = drawn_.withColumns({"own": of_kind(True), "far": of_kind(False)}).drop("all")
        if distinct:
            lists = lists.withColumn("own", F.array_distinct("own")).withColumn("far", F.array_except("far", F.slice("own", 1, same)))
        tail = F.slice("own", same + 1, 1 << 20)
        n = F.slice(F.concat(F.slice("own", 1, same), "far", F.array_except(tail, F.col("far")) if distinct else tail), 1, negatives)
        head = F.least(F.size("own"), F.lit(same))
        return lists.select(*of.columns, n.alias("n"), head.alias("head"), (head + F.size("far")).alias("ready"))

    twice = max(same, 1) * 2
    first = stored(picked(placed, same + 1, negatives - same + 1), "first-draws")
    full = F.coalesce((F.col("ready") >= negatives) & (F.col("head") == same), F.lit(False)) | (F.col("whole_pool") <= 0)
    second = stored(picked(first.filter(~full).select(placed.columns), twice, negatives + SPARE), "second-draws")
    enough = F.coalesce(F.col("ready") >= negatives, F.lit(False))
    third = picked(second.filter(~enough).select(placed.columns), twice, negatives * ROUNDS)
    sets = first.filter(full).unionByName(second.filter(enough)).unionByName(third)
    found = F.coalesce("n", F.expr("cast(array() as array<string>)"))
    filled = F.when(F.size(found) == 0, F.array_repeat("chosen_asin", negatives)).otherwise(F.slice(F.flatten(F.array_repeat(found, negatives)), 1, negatives))
    alts = F.concat(F.array("chosen_asin"), filled)
    mixed = F.array_sort(F.transform(alts, lambda a, i: F.struct(F.xxhash64(F.lit(seed), F.lit("order"), F.col("event_key"), F.col("resample_k"), i).alias("h"), i.alias("i"), a.alias("a"))))
    return sets.select(
        "event_key", "resample_k", "chosen_asin",
        F.transform(mixed, lambda x: x["a"]).alias("choice_asins"),
        (F.size(found) < negatives).alias("dedup_fallback"),
    ).withColumn("chosen_idx", (F.array_position("choice_asins", F.col("chosen_asin")) - 1).cast("int"))


def uncovered(events: DataFrame, persons: DataFrame) -> DataFrame:
    """Customers of events whom no person row covers."""
    return events.select("customer_id").distinct().join(persons.select("customer_id"), "customer_id", "left_anti")


def alternative(title: Column, category: Column, price: Column, rank: Column, brand: Column, repeat: Column, state: Column) -> Column:
    """What a generator or ranker sees of an alternative; what is missing has a value that says so."""
    plain = F.nullif(F.trim(brand), F.lit(""))
    return F.struct(
        F.coalesce(title, F.lit("")).alias("title"), F.coalesce(category, F.lit("")).alias("category"), F.coalesce(price, F.lit(0.0)).alias("price"), rank.alias("popularity_rank"),
        F.coalesce(plain, F.lit("unknown_brand")).alias("brand"), F.coalesce(repeat, F.lit(False)).alias("is_repeat"), F.coalesce(state, F.lit("")).alias("state"),
    )


def score_rank(popularity_: Column) -> Column:
    """The rank of a popularity where no bands are fitted."""
    return F.concat(F.lit("popularity score "), F.coalesce(popularity_, F.lit(0)).cast("string"))


def _known(events: DataFrame) -> DataFrame:
    """What training rows say of an item: its first row, brand and popularity."""
    first = train(events).groupBy("asin").agg(F.min_by(F.struct("title", "category", "price"), F.struct("us", "seq")).alias("item"), F.count("*").alias("popularity"))
    return first.join(brand_map(events), "asin", "left")


def _key() -> Column:
    return F.concat_ws("|", "customer_id", "seq").alias("event_key")


def _text(item: Column, own: Column, mine: Column, routine: Column, rank: Callable[[Column], Column]) -> Column:
    """An alternative from its item (item, brand, popularity) and, for the chosen one, its own event."""
    pick = lambda f: F.when(mine, own[f]).otherwise(item["item"][f])
    return alternative(pick("title"), F.coalesce(pick("category"), F.lit(NO_CATEGORY)), pick("price"), rank(item["popularity"]), item["brand"], mine & (routine > 0), F.when(mine, own["state"]))


def records(sets: DataFrame, events: DataFrame, rank: Callable[[Column], Column] = score_rank) -> DataFrame:
    """Sets as rows of alternatives with rendered fields: the chosen one from its own event, others from their item's
    first training row; what only an event knows stays empty for those. ``rank`` turns a popularity into words."""
    own = events.select(_key(), F.struct("title", "category", "price", "state").alias("own"), *(["routine"] if "routine" in events.columns else [F.lit(0).alias("routine")]))
    rows = sets.select("event_key", "resample_k", "chosen_idx", F.posexplode("choice_asins").alias("alt_idx", "asin")).join(_known(events), "asin", "left").join(own, "event_key")
    mine = F.col("alt_idx") == F.col("chosen_idx")
    text = _text(F.struct("item", "brand", "popularity"), F.col("own"), mine, F.col("routine"), rank)
    return rows.withColumn("alt_text", text).select("event_key", "resample_k", "alt_idx", "asin", mine.alias("chosen"), "alt_text.*")


def choice_records(sets: DataFrame, events: DataFrame, persons: DataFrame, context: Column, rank: Callable[[Column], Column] = score_rank, also: tuple[str, ...] = ()) -> DataFrame:
    """One row a set, with all that models, generators and rankers take: chosen_features, metadata, z_d, c_d, alt_texts.

    ``events`` have a split, state features and ``recent`` titles; ``persons`` have customer_id, z and the columns that
    ``context``, an expression over a person and the event's ``recent``, needs. A customer without a person row raises
    when read. Columns ``also`` of the events follow.

    Items' texts are fetched by a number of the set and meet it as one list; the wide rows are dealt no more.
    """
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    known = _known(events)
    facts = known.select("asin", "brand", "popularity")
    own = events.join(facts, "asin", "left").select(
        _key(), "customer_id", "us", "category", "recent", "routine", *also, F.struct("title", "category", "price", "state").alias("own"),
        F.struct(*map(number, ("routine", "recency_days", "novelty", "cat_affinity", "popularity", "price")), F.coalesce("brand", F.lit("")).alias("brand")).alias("chosen_features"),
        F.struct((F.col("routine") > 0).alias("is_repeat"), F.col("price").cast("double").alias("price"), F.col("routine").cast("int").alias("routine")).alias("facts"),
    )
    numbered = stored(sets.withColumn("_set", F.monotonically_increasing_id()), "numbered-sets")
    each = numbered.select("_set", F.posexplode("choice_asins").alias("alt_idx", "asin")).join(known, "asin", "left").select("_set", "alt_idx", "item", "brand", "popularity")
    items = each.repartition("_set").groupBy("_set").agg(F.array_sort(F.collect_list(F.struct("alt_idx", "item", "brand", "popularity"))).alias("_items"))
    people = persons.withColumn("_known", F.lit(True))
    rows = numbered.join(own, "event_key").join(people, "customer_id", "left").join(items, "_set", "left")
    texts = F.transform("_items", lambda x: _text(x, F.col("own"), x["alt_idx"] == F.col("chosen_idx"), F.col("routine"), rank))
    checked = F.when(F.col("_known"), context).otherwise(F.raise_error(F.concat(F.lit("no person row for customer "), F.col("customer_id"))).cast("string"))
    return rows.select(
        "event_key", "resample_k", "customer_id", "us", "category", "chosen_asin", "choice_asins", "chosen_idx", "chosen_features",
        F.struct("facts.*", "dedup_fallback").alias("metadata"), F.col("z").alias("z_d"), checked.alias("c_d"),
        F.transform(texts, lambda t: F.struct(*(t[f].alias(f) for f in ("title", "category", "price", "popularity_rank", "brand", "is_repeat", "state")))).alias("alt_texts"), *also,
    )


def with_persons(events: DataFrame, persons: DataFrame) -> DataFrame:
    """Rows of customers that have a person row: before translation against the survey, after it against those whom no
    field dropped."""
    return events.join(persons.select("customer_id"), "customer_id", "left_semi")


def with_weights(events: DataFrame, weights: DataFrame) -> DataFrame:
    """Events with omega, their customer's importance weight, 1 where there is none."""
    return events.join(weights.select("customer_id", F.col("weight").alias("omega")), "customer_id", "left").withColumn("omega", F.coalesce("omega", F.lit(1.0)))


def selected_or_untrained(events: DataFrame, selected: DataFrame) -> DataFrame:
    """Rows of selected customers and of those who have no training row."""
    every = events.groupBy("customer_id").agg(F.max((F.col("split") == "train").cast("int")).alias("trained")).filter("trained = 0").select("customer_id")
    return events.join(selected.select("customer_id").union(every), "customer_id", "left_semi")


def subset(alternatives: DataFrame, wanted: DataFrame) -> DataFrame:
    """Alternatives of the wanted events (event_id)."""
    return alternatives.join(wanted.select("event_id"), "event_id", "left_semi")


def sidecar(events: DataFrame) -> DataFrame:
    """Each customer's test rows with event_idx, their place in time, so that runs can be paired."""
    place = F.row_number().over(Window.partitionBy("customer_id").orderBy("us", "seq")) - 1
    return events.filter("split = 'test'").withColumn("event_idx", place.cast("long"))
