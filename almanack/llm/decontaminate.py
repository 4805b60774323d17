"""Benchmark decontamination by templates (DataFrame functions only).

Texts become lists of tokens. A token's template form is a typed placeholder for numbers, for units
after a number and for names (capitalised words, a run of them within a sentence is one), and else the
word in lower case. Words at sentence starts count as names too, so those may differ. Windows of
``window`` forms are hashed and those of items joined with those of documents, once as templates and
once as plain lower-case tokens, so a copy in any case is found.

Matches of one document and item whose alignments (document position less item position) are near
each other are put together: a band is at least 16 positions wide or half the item, and bands overlap by
half, so words put in or left out don't part a match. A template match counts if its windows cover a share of
``coverage`` of the item's forms of which a quarter are plain words, or LONG forms in a row of which half are. Then slots are compared
inside the matched windows, each with its own partner: those that don't have the most frequent partner of
their value may be ``contradictions`` of the slots. Slots at an item's ends aren't held against it, as a run of names may
go on outside. A match of plain tokens counts if it covers that share, or VERBATIM tokens in a row; its slots aren't compared.

A first pass over all documents replaces slots within the texts, which is quick, and finds those that
share any window with the benchmark; tokens, alignments and slots are worked out for these alone.

Items of fewer tokens than a window are found by windows of their own length, which must have the same
tokens in any case. As templates they are found as a whole document only. An item that has
enough tokens, but fewer forms as runs of names are one, is also compared with each name as a form. The windows
of the benchmark are broadcast in blocks of about ``block`` rows, whatever the size of the benchmark; a
document is read once per kind of window and block. NULL or empty texts and items have no tokens and match nothing; rows
without an id are left out of the result. Repeated rows give one result row. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.llm.common import staged

# Units that follow numbers.
UNITS = [
    "mm", "cm", "m", "km", "inch", "inches", "ft", "feet", "foot", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "t", "oz", "lb", "lbs", "pound", "pounds", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks",
    "month", "months", "year", "years", "percent", "dollar", "dollars", "euro", "euros", "cent", "cents",
    "degree", "degrees", "mph", "kmh", "hz", "khz", "w", "kw", "v", "a", "j", "kj", "cal", "kcal",
]

#: Tokens in a row that are a leak whatever the length of the item: as they are, and as template forms.
VERBATIM, LONG = 13, 24

NUMBER = r"\p{N}+(?:[.,]\p{N}+)*"
TOKEN = rf"[\p{{L}}\p{{M}}]+|{NUMBER}|[.!?]"


def tokens_of(text: Column) -> Column:
    """Words, numbers and sentence ends of a text, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def templated(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, values (tokens without sentence ends), names (their forms), forms (runs of names are one), places
    (of forms in values), wholes (the tokens of each form)."""
    rows = rows.select(*keys, tokens_of(F.col("text")).alias("raw"))
    is_end = lambda t: t.isin(".", "!", "?")
    before = lambda array, i: F.when(i > 0, F.try_element_at(array, F.greatest(i, F.lit(1))))  # noqa: E731  (1-based)

    def form(token: Column, i: Column) -> Column:
        number = token.rlike(r"^\p{N}")
        unit = F.lower(token).isin(*UNITS) & F.coalesce(before(F.col("raw"), i).rlike(r"^\p{N}"), F.lit(False))
        return F.when(number, "<num>").when(unit, "<unit>").when(token.rlike(r"^\p{Lu}"), "<name>").otherwise(F.lower(token))

    rows = rows.withColumn("all", F.transform("raw", form))
    goes_on = lambda i: F.coalesce((F.get("all", i) == "<name>") & (before(F.col("all"), i) == "<name>"), F.lit(False))
    words = F.transform("raw", lambda t, i: F.struct(F.lower(t).alias("value"), F.get("all", i).alias("form"), goes_on(i).alias("on")))
    rows = rows.select(*keys, F.filter(words, lambda w: ~is_end(w["value"])).alias("words"))
    first = F.filter(F.transform("words", lambda w, i: F.struct(w["form"].alias("form"), w["on"].alias("on"), i.alias("place"))), lambda w: ~w["on"])
    # Taken out by transform: a plain field of an array would be worked out again for every token that looks into it.
    field = lambda rows, name: F.transform(rows, lambda x: x[name])
    rows = rows.select(*keys, field("words", "value").alias("values"), field("words", "form").alias("names"), first.alias("first"))
    rows = rows.select(*keys, "values", "names", field("first", "form").alias("forms"), field("first", "place").alias("places"))
    after = lambda k: F.coalesce(F.get("places", k + 1), F.size("values"))
    # A slice copies its whole array first, so only runs are sliced.
    run = lambda p, k: F.array_join(F.slice("values", p + 1, after(k) - p), " ")
    return rows.withColumn("wholes", F.transform("places", lambda p, k: F.when(after(k) - p == 1, F.get("values", p)).otherwise(run(p, k))))


def quick_forms(rows: DataFrame, key: str, *, runs: bool = True) -> DataFrame:
    """key, forms: the template forms by replacement within the text; placeholders are 0, 1 and 2."""
    text = F.coalesce(F.col("text"), F.lit(""))
    gap, letter = r"[^\p{L}\p{M}\p{N}.!?]", r"[\p{L}\p{M}]"
    counted = F.regexp_replace(text, NUMBER, " 0 ")
    measured = F.regexp_replace(counted, rf" 0 {gap}*(?i:{'|'.join(UNITS)})(?!{letter})", " 0  1 ")
    # The capital comes first in the pattern: most positions are done with after one look.
    more = rf"(?:{gap}++\p{{Lu}}{letter}*+)*+" if runs else ""
    named = F.regexp_replace(measured, rf"\p{{Lu}}(?<!{letter}\p{{Lu}}){letter}*+{more}", " 2 ")
    forms = F.array_remove(F.split(F.lower(named), r"[^\p{L}\p{M}\p{N}]+"), "")
    return rows.select(key, forms.alias("forms"))


def plain_forms(rows: DataFrame, key: str) -> DataFrame:
    """key, forms: the words and numbers in lower case."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(rf"[\p{{L}}\p{{M}}]+|{NUMBER}"), F.lit(0))
    return rows.select(key, words.alias("forms"))


def windows_of(rows: DataFrame, key: str, window: int) -> DataFrame:
    """key, at (position), h (hash of the window's forms), for every window of every row.

    Hashes of two neighbours give those of two, four, ... forms, a column each, so a window costs
    a few hashes of two numbers whatever its length. A row of fewer forms has one window.
    """
    # No filter on the forms here: it would be pushed down to the text and work out the forms twice.
    rows = rows.select(key, F.size("forms").alias("n"), F.transform("forms", lambda f: F.xxhash64(f)).alias("h"))
    have = 1
    while have < window:
        step = min(have, window - have)
        beyond = F.slice("h", step + 1, 1 << 30)
        rows = rows.withColumn("h", F.zip_with("h", beyond, lambda x, y: F.xxhash64(x, y)))
        have += step
    whole = F.slice("h", F.lit(1), F.greatest(F.col("n") - window + 1, F.lit(1)))
    return rows.select(key, F.posexplode(whole).alias("at", "h"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = 8,
    coverage: float = 0.5,
    contradictions: float = 0.1,
    block: int = 500_000,
) -> DataFrame:
    """doc_id, item_id, at (token of the document where the item would begin), n_windows, coverage (share of the
    item's tokens or forms in matched windows), n_slots (compared; 0 for plain tokens).

    One row per document and item, for the best match.
    """
    benchmark = benchmark.where("item_id IS NOT NULL").select("item_id", "text").withColumn("item", F.xxhash64("item_id", "text"))
    items = staged(templated(benchmark.dropDuplicates(["item", "text"]), "item", "item_id", "text").where("size(values) > 0"), "items")
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    small = items.where(F.size("values") < window)
    lengths = sorted(r[0] for r in small.select(F.size("values")).distinct().collect())
    long, merged = items.where(F.size("values") >= window), (F.size("values") >= window) & (F.size("forms") < window)
    kinds = [(quick_forms, items, window), (plain_forms, long, window)]
    if apart := items.where(merged).limit(1).count():
        kinds.append((partial(quick_forms, runs=False), items.where(merged), window))
    kinds += [(plain_forms, small.where(F.size("values") == n), n) for n in lengths]
    suspects = docs.join(sharing(docs, kinds, block), "doc_id").withColumn("doc", F.xxhash64("doc_id", "text"))
    suspects = staged(templated(suspects.dropDuplicates(["doc", "text"]), "doc", "doc_id"), "suspects")
    found = [
        consistent(suspects, items, chained(suspects, items, "forms", window, coverage, LONG), "wholes", coverage, contradictions),
        placed(chained(suspects, long, "values", window, coverage, VERBATIM)),
        *[in_full(suspects, small, n) for n in lengths],
    ]
    if apart:
        runs = chained(suspects, items.where(merged), "names", window, coverage, LONG)
        found.append(consistent(suspects, items, runs, "values", coverage, contradictions))
    best = F.max(F.struct("coverage", "n_windows", "n_slots", (-F.col("at")).alias("at"))).alias("best")
    rows = reduce(DataFrame.unionByName, found).join(suspects.select("doc", "doc_id"), "doc").join(items.select("item", "item_id"), "item")
    rows = rows.groupBy("doc_id", "item_id").agg(best)
    return rows.select(
        "doc_id", "item_id", (-F.col("best.at")).cast("long").alias("at"), F.col("best.n_windows").cast("long").alias("n_windows"),
        F.round("best.coverage", 6).alias("coverage"), F.col("best.n_slots").cast("long").alias("n_slots"),
    )


def sharing(docs: DataFrame, kinds: list[tuple[Callable[..., DataFrame], DataFrame, int]], block: int) -> DataFrame:
    """doc_id of the documents that share a window with any item; kinds: forms, items and window.

    The windows asked for are broadcast in blocks of about ``block`` rows.
    """
    parts = []
    for forms, items, window in kinds:
        asked = staged(windows_of(forms(items, "item"), "item", window).select("h").distinct(), "item-windows")
        blocks = max(1, -(-asked.count() // block))
        found = windows_of(forms(docs, "doc_id"), "doc_id", window).select("doc_id", "h")
        number = F.pmod(F.xxhash64("h"), F.lit(blocks))
        parts += [found.join(F.broadcast(asked.where(number == n)), "h", "left_semi") for n in range(blocks)]
    return staged(reduce(DataFrame.unionByName, parts).select("doc_id").distinct(), "suspect-ids")


def chained(docs: DataFrame, items: DataFrame, forms: str, window: int, coverage: float, row: int) -> DataFrame:
    """doc, item, hits (item_at, at), n_windows, coverage, longest (forms in a row): bands that cover enough or have ``row`` forms in a row."""
    asked = windows_of(items.select("item", F.col(forms).alias("forms")), "item", window).withColumnRenamed("at", "item_at")
    asked = asked.join(items.select("item", F.size(forms).alias("n")), "item")
    hits = windows_of(docs.select("doc", F.col(forms).alias("forms")), "doc", window).join(asked, "h")
    width, shift = F.greatest(F.lit(16), (F.col("n") / 2).cast("int")), F.col("at") - F.col("item_at")
    bands = F.array(2 * F.floor(shift / width), 2 * F.floor((shift + width / 2) / width) + 1)
    hits = hits.select("doc", "item", "n", F.explode(bands).alias("band"), F.struct(shift.alias("shift"), "item_at", "at").alias("hit"))
    rows = hits.groupBy("doc", "item", "n", "band").agg(F.array_sort(F.collect_set("hit")).alias("hits"))
    size = F.least(F.lit(window), F.col("n"))
    starts = F.array_sort(F.array_distinct("hits.item_at"))
    rows = rows.withColumn("starts", starts).withColumn("size", size)
    gaps = F.zip_with(F.slice("starts", 2, 1 << 30), "starts", lambda b, a: F.coalesce(F.least(b - a, F.col("size")), F.col("size")))
    covered = F.aggregate(gaps, F.lit(0), lambda a, x: a + x)
    zero = F.struct(*[F.lit(x).cast("int").alias(n) for n, x in (("shift", 0), ("last", -(1 << 30)), ("start", 0), ("best", 0))])

    def step(a: Column, x: Column) -> Column:
        on = (a["shift"] == x["shift"]) & (x["item_at"] - a["last"] <= F.col("size"))
        start = F.when(on, a["start"]).otherwise(x["item_at"])
        best = F.greatest(a["best"], x["item_at"] - start + F.col("size"))
        return F.struct(x["shift"].alias("shift"), x["item_at"].alias("last"), start.alias("start"), best.alias("best"))

    rows = rows.select(
        "doc", "item", "n", "size", "hits", F.size("starts").alias("n_windows"), (covered / F.col("n")).alias("coverage"),
        F.aggregate("hits", zero, step, lambda a: a["best"]).alias("longest"),
    )
    return rows.where((F.col("coverage") >= coverage) | (F.col("longest") >= row))


def placed(runs: DataFrame) -> DataFrame:
    """Matches of plain tokens, whose slots aren't compared."""
    return runs.select("doc", "item", F.col("hits")[0]["shift"].alias("at"), "n_windows", "coverage", F.lit(0).alias("n_slots"))


def in_full(docs: DataFrame, items: DataFrame, length: int) -> DataFrame:
    """Where items of that many tokens stand in documents of any length, by hash and then by their tokens."""
    items = items.where(F.size("values") == length)
    asked = windows_of(items.select("item", F.col("values").alias("forms")), "item", length).select("item", "h")
    hits = windows_of(docs.select("doc", F.col("values").alias("forms")), "doc", length).join(asked, "h")
    hits = hits.groupBy("doc", "item").agg(F.min("at").alias("at"))
    hits = hits.join(items.select("item", "values"), "item").join(docs.select("doc", F.col("values").alias("doc_values")), "doc")
    hits = hits.where(F.slice("doc_values", F.col("at") + 1, length) == F.col("values"))
    return hits.select("doc", "item", "at", F.lit(1).alias("n_windows"), F.lit(1.0).alias("coverage"), F.lit(0).alias("n_slots"))


def consistent(
    docs: DataFrame, items: DataFrame, runs: DataFrame, tokens: str, coverage: float, contradictions: float
) -> DataFrame:
    """The runs whose slots map each value of the item to one value of the document, but for a few."""
    names = {"wholes": "forms", "values": "names"}
    pick = lambda rows, key, as_: rows.select(key, F.col(tokens).alias(f"{as_}_values"), F.col(names[tokens]).alias(f"{as_}_forms"), F.col("places").alias(f"{as_}_places"))
    both = runs.join(pick(docs, "doc", "doc"), "doc").join(pick(items, "item", "item"), "item")
    pairs = F.transform("hits", lambda x: F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda j: F.struct((x["item_at"] + j).alias("i"), (x["at"] + j).alias("d"))))
    both = both.withColumn("pairs", F.array_distinct(F.flatten(pairs)))
    slots = F.transform(
        F.filter("pairs", lambda p: F.get("item_forms", p["i"]).startswith("<")),
        lambda p: F.struct(F.get("item_forms", p["i"]).alias("form"), F.get("item_values", p["i"]).alias("item"), F.get("doc_values", p["d"]).alias("doc"), p["i"].alias("i")),
    )
    both = both.withColumn("slots", slots)
    both = both.withColumn("inner", F.array_sort(F.filter("slots", lambda s: (s["i"] > 0) & (s["i"] < F.col("n") - 1))))
    zero = F.struct(*[F.lit("").alias(n) for n in ("form", "item", "doc")], *[F.lit(0).alias(n) for n in ("n", "best", "right")])

    def step(a: Column, s: Column) -> Column:
        """Slots come sorted, so those of a value and partner follow each other; the most frequent partner is right."""
        value = (a["form"] == s["form"]) & (a["item"] == s["item"])
        n = F.when(value & (a["doc"] == s["doc"]), a["n"] + 1).otherwise(1)
        more = ~value | (n > a["best"])
        best = F.when(value, F.greatest(a["best"], n)).otherwise(n)
        return F.struct(s["form"].alias("form"), s["item"].alias("item"), s["doc"].alias("doc"), n.alias("n"), best.alias("best"), (a["right"] + more.cast("int")).alias("right"))

    wrong = F.size("inner") - F.aggregate("inner", zero, step, lambda a: a["right"])
    both = both.withColumns({"wrong": wrong, "n_slots": F.size("slots"), "share": F.size("slots") / F.size("pairs")})
    # Forms that are nearly all placeholders are those of any list of numbers or names.
    enough = (F.col("coverage") >= coverage) & (F.col("share") <= 0.75) | (F.col("share") <= 0.5)
    both = both.where((F.col("wrong") <= contradictions * F.col("n_slots")) & enough)
    first = F.col("hits")[0]
    if tokens == "wholes":
        at = F.get("doc_places", first["at"]) - F.get("item_places", first["item_at"])
    else:
        at = first["shift"]
    return both.select("doc", "item", at.alias("at"), "n_windows", "coverage", "n_slots")
