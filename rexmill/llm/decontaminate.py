"""Benchmark decontamination by template canonicalisation. DataFrame functions only.

Texts are tagged: numbers, units after numbers and names (capitalised words in
the middle of a sentence) become typed slots that keep their value. Templates
drop the values and the case. Windows of template words are hash-joined with
the benchmark's; an item is found in a document that holds at least ``share``
of its distinct windows. If the item has slots, the values aligned with each of
its values must agree wherever it recurs, so a question with other numbers is
caught and a mere mosaic of templates is not. Slots are aligned by the matching
windows they lie in, so an inserted word shifts nothing. Plain windows, of the
lower-cased words with their values, are matched beside the templates: a copy of
an item is found whatever its case and line breaks make of its slots. A part of
an item is found, too, if it is long: ``run`` consecutive words with their values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

WINDOW = 5
SHARE = 0.8
#: Consecutive words of an item that count by themselves, whatever their share of it.
RUN = 13
#: Benchmark windows that are broadcast (8 bytes and an item each); more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Units that follow a number (fixed values).
UNITS = "kg|g|mg|km|m|cm|mm|miles?|inch(?:es)?|feet|ft|lbs?|hours?|hrs?|minutes?|mins?|seconds?|secs?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|liters?|litres?|ml|l|mph|kmh|degrees?"
_NUM, _UNIT, _NAME = "0num0", "0unit0", "0name0"
_SPLIT = r"[^\p{L}\p{N}\p{M}]+"


def tagged(text: Column) -> Column:
    """Slots written as marker + value without separators; other words lower-cased."""
    t = F.regexp_replace(text, r"(?<![\p{L}\p{N}])\p{Nd}+(?:[.,:]\p{Nd}+)*(?![\p{L}\p{N}])", f"{_NUM}$0x")
    t = F.when(text.rlike(r"\p{Nd}"), F.regexp_replace(F.regexp_replace(t, r"(?<=\p{Nd})[.,:](?=\p{Nd})", "p"), rf"(?<=\p{{Nd}}x )(?i:{UNITS})(?![\p{{L}}\p{{N}}])", f"{_UNIT}$0")).otherwise(text)
    t = F.regexp_replace(t, r"(?<=[\p{Ll},;] )\p{Lu}\p{Ll}+(?![\p{L}\p{N}])", f"{_NAME}$0")
    return F.lower(t)


def templates(tag: Column) -> Column:
    return F.regexp_replace(tag, rf"({_NUM}|{_UNIT}|{_NAME})[\p{{L}}\p{{N}}]+", "$1")


def plain(tag: Column) -> Column:
    """Names and units as bare words again; numbers are told whatever the case, and keep marker and value."""
    return F.regexp_replace(tag, f"{_UNIT}|{_NAME}", "")


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPLIT, -1), lambda w: w != "")


def _hashed(tokens: Column, at: Column, size: int) -> Column:
    return F.transform(at, lambda i: F.xxhash64(*[F.element_at(tokens, i + j) for j in range(size)]))


def windows(tokens: Column, size: int) -> Column:
    """Hashes of all windows of ``size`` words, in order."""
    n = F.size(tokens)
    at = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
    return _hashed(tokens, at, size)


def slot_windows(template: Column, bare: Column, size: int) -> Column:
    """Hashes of the windows of ``bare`` words that hold a slot; the others are those of the template. Null bare: none."""
    n = F.size(template)
    slots = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(template, i).isin(_NUM, _UNIT, _NAME))
    at = F.array_distinct(F.flatten(F.transform(slots, lambda p: F.sequence(F.greatest(p - (size - 1), F.lit(1)), F.least(p, n - (size - 1))))))
    return F.when(bare.isNotNull() & (n >= size), _hashed(bare, at, size)).otherwise(F.array().cast("array<long>"))


def row_key(doc_id: Column, text: Column) -> Column:
    """Names a row by its doc_id, which may be null, and its text: rows that share an id are told apart, equal rows are one."""
    return F.xxhash64(doc_id.isNull(), doc_id.cast("long"), text)


def _with_runs(pairs: DataFrame, hits: DataFrame, listed: DataFrame, need: int) -> DataFrame:
    """The (row, item_id) of pairs with ``need`` consecutive windows of the item in a row, one behind the other there as well."""
    there = pairs.select("row", "item_id").join(hits, "row").join(listed.select("item_id", "h", "at", "p"), ["item_id", "h"])
    # the values of a window with slots must be the item's own: its plain window is in the row as well
    plain = hits.select("row", F.col("h").alias("p")).distinct()
    there = there.join(plain, ["row", "p"], "left_semi").select("row", "item_id", "at", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    order = Window.partitionBy("row", "item_id", "shift").orderBy("at")
    islands = there.withColumn("island", F.col("at") - F.row_number().over(order))
    return islands.groupBy("row", "item_id", "shift", "island").count().filter(F.col("count") >= need).select("row", "item_id").distinct()


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, run: int = RUN) -> DataFrame:
    """Pairs ``row, item_id, matched, windows, slots, consistent`` of found items; ``row`` is the row_key.

    docs: ``doc_id, text``; benchmark: ``item_id, text``; other columns are
    ignored. Null and empty texts match nothing, in an empty table nothing is
    found. An item of fewer words than a window is one window of its own length;
    rows that share an item_id are one item, those without one are ignored. The
    whole of every text is read. A pair that holds ``run`` consecutive words of
    the item with their values is consistent.
    """
    docs = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), "text")
    items = benchmark.filter("item_id is not null").select("item_id", tagged(F.col("text")).alias("tag")).withColumn("tokens", words(F.col("tag"))).withColumn("template", words(templates(F.col("tag")))).withColumn("plain", words(plain(F.col("tag")))).filter(F.size("template") > 0)
    short = sorted(r["n"] for r in items.filter(F.size("template") < window).select(F.size("template").alias("n")).distinct().collect())
    sizes = [*short, window]
    of_item = [F.lit(None).cast("array<long>")] * 2
    for n in sizes:
        fits = (F.size("template") == n) if n < window else (F.size("template") >= window)
        of_item = [F.when(fits, windows(F.col(name), n)).otherwise(one) for name, one in zip(("template", "plain"), of_item)]
    slot = F.exists("template", lambda w: w.isin(_NUM, _UNIT, _NAME))
    width = F.least(F.size("template"), F.lit(window))
    both = F.arrays_zip(of_item[0].alias("t"), of_item[1].alias("p"))
    listed = items.select("item_id", slot.alias("has_slots"), "tokens", width.alias("width"), F.posexplode(both).alias("at", "w"))
    listed = stash(listed.select("item_id", "has_slots", "at", F.col("w.t").alias("h"), F.col("w.p").alias("p"), F.slice("tokens", F.col("at") + 1, F.col("width")).alias("values")), "bench-windows")
    as_plain = listed.select("item_id", F.col("p").alias("h"))
    totals = listed.groupBy("item_id").agg(F.countDistinct("h").alias("windows"), F.countDistinct("p").alias("plain_windows"), F.first("has_slots").alias("has_slots"))
    keys = listed.select("h").union(as_plain.select("h")).distinct()
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    given = docs.filter("text is not null").select("row", tagged(F.col("text")).alias("tag")).select("row", words(templates(F.col("tag"))).alias("template"), F.when(F.col("tag").rlike(f"{_NUM}|{_UNIT}|{_NAME}"), words(plain(F.col("tag")))).alias("plain"))
    hashes = F.concat(*[windows(F.col("template"), n) for n in sizes], *[slot_windows(F.col("template"), F.col("plain"), n) for n in sizes])
    seen = given.select("row", F.size("template").alias("n"), F.posexplode(hashes).alias("pos", "h"))
    # positions within the windows of one size: shorter sizes come first, and plain windows, whose positions aren't used, last
    before, pos = F.lit(0), F.col("pos")
    for n in sizes[:-1]:
        before = before + F.greatest(F.col("n") - (n - 1), F.lit(0))
        pos = F.when(F.col("pos") >= before, F.col("pos") - before).otherwise(pos)
    seen = seen.select("row", pos.alias("pos"), "h")
    side = F.broadcast(keys) if small else keys
    hits = stash(seen.join(side, "h", "left_semi"), "bench-hits")
    # a doc's window counts once per distinct hash, so a repeated passage isn't multiplied by itself
    once = hits.select("row", "h").distinct()
    of_kind = listed.select("item_id", "h", F.lit(False).alias("exact")).union(as_plain.select("item_id", "h", F.lit(True))).distinct()
    per = once.join(of_kind, "h").groupBy("row", "item_id").agg(F.sum(F.when(~F.col("exact"), 1).otherwise(0)).alias("as_template"), F.sum(F.when(F.col("exact"), 1).otherwise(0)).alias("as_plain")).join(totals, "item_id")
    exact = F.col("as_plain") >= share * F.col("plain_windows")
    need = max(run - window + 1, 1)
    whole = F.col("exact") | (F.col("as_template") >= share * F.col("windows"))
    per = stash(per.withColumn("exact", exact).filter(whole | (F.col("as_template") >= need)), "bench-pairs")
    parts = stash(_with_runs(per.filter(~F.col("exact") & (F.col("as_template") >= need)), hits, listed, need).withColumn("part", F.lit(True)), "bench-parts")
    found = per.join(parts, ["row", "item_id"], "left").withColumn("part", F.col("part").isNotNull()).filter(whole | F.col("part"))
    found = found.select("row", "item_id", F.when(F.col("exact"), F.col("as_plain")).otherwise(F.col("as_template")).alias("matched"), F.when(F.col("exact"), F.col("plain_windows")).otherwise(F.col("windows")).alias("windows"), (F.col("has_slots") & ~F.col("exact") & ~F.col("part")).alias("has_slots"))
    found = stash(found, "bench-found")
    slotted = found.filter("has_slots")
    if slotted.limit(1).count() == 0:
        return found.select("row", "item_id", "matched", "windows", F.lit(0).cast("long").alias("slots"), F.lit(True).alias("consistent"))

    # align the slots of every matching window with the document's words there
    a_slot = lambda c: F.col(c).rlike(f"^({_NUM}|{_UNIT}|{_NAME})")
    aligned = slotted.select("row", "item_id").join(hits, "row").join(listed.select("item_id", "h", "at", "values"), ["item_id", "h"])
    aligned = aligned.select("row", "item_id", "at", "pos", F.posexplode("values").alias("j", "want")).filter(a_slot("want"))
    aligned = aligned.select("row", "item_id", "want", (F.col("at") + F.col("j")).alias("i"), (F.col("pos") + F.col("j")).alias("place")).distinct()
    there = docs.join(slotted.select("row").distinct(), "row", "left_semi").select("row", F.posexplode(words(tagged(F.col("text")))).alias("place", "got")).filter(a_slot("got"))
    aligned = aligned.join(there, ["row", "place"]).select("row", "item_id", "want", "i", "got").distinct()
    # an item's value agrees if one value of the document stands at all of its places
    places = aligned.groupBy("row", "item_id", "want").agg(F.countDistinct("i").alias("n"))
    most = aligned.groupBy("row", "item_id", "want", "got").agg(F.count("*").alias("k")).groupBy("row", "item_id", "want").agg(F.max("k").alias("k"))
    values = places.join(most, ["row", "item_id", "want"])
    check = values.groupBy("row", "item_id").agg(F.sum("n").alias("slots"), F.sum(F.when(F.col("k") == F.col("n"), F.col("n")).otherwise(0)).alias("agree"))
    out = found.join(check, ["row", "item_id"], "left")
    agree = F.coalesce(F.col("agree") >= share * F.col("slots"), F.lit(True))
    return out.select("row", "item_id", "matched", "windows", F.coalesce("slots", F.lit(0)).cast("long").alias("slots"), agree.alias("consistent"))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """row (see row_key), n_items and the sorted item ids of rows that hold an item with consistent slots."""
    found = find_items(docs, benchmark, window, share).filter("consistent")
    return found.groupBy("row").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_set("item_id")).alias("items"))


def tag_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """Every row of docs: ``doc_id, n_items, items, contaminated``; rows without a doc_id and rows that share one are judged by their own texts."""
    bad = contaminated(docs, benchmark, window, share)
    out = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row")).join(bad, "row", "left")
    return out.select("doc_id", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items", F.array().cast(bad.schema["items"].dataType)).alias("items"), F.col("n_items").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """docs without the rows that hold an item; all columns as they were."""
    bad = contaminated(docs, benchmark, window, share).select(F.col("row").alias("__bad"))
    return docs.join(bad, row_key(docs["doc_id"], docs["text"]) == F.col("__bad"), "left_anti")
