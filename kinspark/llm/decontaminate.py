"""Benchmark decontamination by template canonicalisation.

Words become a template: numbers, units and names (capitalised words inside a
sentence) turn into typed placeholders, the others into their lower-case letters
and digits.  Windows of WINDOW template words of the benchmark items are joined
by hash with those of all documents; an item's first window also as it reads
inside a sentence, where a capitalised first word is a name.  A document that
holds at least COVERAGE of an item's distinct windows is then laid beside the
item at every place where a window of both stands, and once more with each
window at a place of its own, for copies with words put in or left out (of a
window's places the one whose shift most windows have).  If in one of these one
value of the item's slots always stands for one value of the document's, the
document is contaminated.

The kind is `exact` if at one place all words of the item stand, but for case
and the punctuation around them; `partial` if words are missing or others, but
all slots that meet are equal; `reparameterised` if slots have other values.

Only DataFrame functions are used.  Documents send distinct window hashes into
the join, no text; an item's windows are broadcast after their number was
checked, and joined by shuffle beyond it; texts are read again only for the
candidates, whose keys are broadcast behind the same check.

Defined results: null and empty texts hold nothing, documents and items without
a key match nothing; items of fewer than LEAST words match nothing (a word or
two stand in many clean documents; a text without spaces is one word), those of
fewer than WINDOW words match as one window; windows with fewer than LITERAL
words that are no placeholders count only for items that have no others, which
must then be there word for word; repeated rows count once; extra columns are
left out; empty tables give an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

WINDOW, LEAST, LITERAL, COVERAGE = 8, 3, 3, 0.5
#: Rows up to which a side is broadcast.
BROADCAST_ROWS = 1_000_000
#: Words that name a unit (a fixed list).
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles g kg mg gram grams kilogram kilograms pound pounds ounce ounces ton tons tonnes l ml litre litres "
    "liter liters gallon gallons second seconds sec minute minutes min hour hours h day days week weeks month months year years dollar dollars cent cents euro "
    "euros usd eur percent % degree degrees celsius fahrenheit kelvin watt watts volt volts amp amps newton newtons joule joules hz khz mhz ghz kb mb gb tb km/h mph"
).split()
NUMBER, NAME, UNIT = "<num>", "<name>", "<unit>"


def raw_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def plain(word: Column) -> Column:
    """A word without the punctuation around it."""
    return F.btrim(word, F.lit(".,;:!?\"'()[]{}<>*#$&|-_"))


def is_slot(word: Column) -> Column:
    return word.isin(NUMBER, NAME, UNIT)


def shifted(array: str, by: int) -> Column:
    return F.slice(array, by + 1, F.size(array))


def templated(df: DataFrame, text: str, sizes: list[int]) -> DataFrame:
    """With raw (words), words (of the template) and w1, w2.. (windows of the sizes) in place of the text.

    A window is a bigint: a hash, and in the low four bits how many of its words
    are literal; null where the text ends before it.  Every step is a projection
    of its own over arrays laid side by side: a lambda that looks into another
    array would build that array anew for each element.
    """
    out = df.withColumn("raw", raw_words(F.col(text))).drop(text)
    out = out.withColumn("bare", F.transform("raw", plain))
    before = F.transform(F.concat(F.array(F.lit(".")), F.slice("raw", 1, F.size("raw") - 1)), lambda w: F.substring(w, -1, 1))
    out = out.withColumn("before", F.when(F.size("raw") > 0, before).otherwise(F.array().cast("array<string>")))

    def one(bare: Column, last: Column) -> Column:
        first = F.substring(bare, 1, 1)
        return (
            F.when((first >= "0") & (first <= "9"), NUMBER)
            .when((F.lower(first) != first) & ~last.isin(".", "!", "?", ":"), NAME)
            .when(F.lower(bare).isin(UNITS), UNIT)
            .otherwise(F.lower(bare))
        )

    return windows_of(out.withColumn("words", F.zip_with("bare", "before", one)).drop("bare", "before"), sizes)


def windows_of(out: DataFrame, sizes: list[int]) -> DataFrame:
    """With w1, w2.. (windows of the sizes) beside the words of a template."""

    def both(a: Column, b: Column) -> Column:
        return F.xxhash64(a, b).bitwiseAND(-16).bitwiseOR(a.bitwiseAND(15) + b.bitwiseAND(15))

    out = out.withColumn("w1", F.transform("words", lambda w: F.xxhash64(w).bitwiseAND(-16).bitwiseOR(F.when(is_slot(w), 0).otherwise(1).cast("bigint"))))
    made = {1}

    def make(size: int) -> None:
        nonlocal out
        if size in made:
            return
        half = 1 << (size - 1).bit_length() - 1
        make(half)
        make(size - half)
        out = out.withColumn(f"w{size}", F.zip_with(f"w{half}", shifted(f"w{size - half}", half), both))
        made.add(size)

    for size in sizes:
        make(size)
    return out


def counting(windows: str) -> Column:
    """The windows with enough literal words, each once."""
    return F.array_distinct(F.filter(windows, lambda w: w.isNotNull() & (w.bitwiseAND(15) >= LITERAL)))


def small(df: DataFrame) -> DataFrame:
    """Broadcast a written table of a few numbers a row if its rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def other_reading(words: Column, raw: Column) -> Column:
    """The words of a template with the first one, if it is a capitalised word, as a name, as inside a sentence."""
    first = F.substring(plain(F.get(raw, F.lit(0))), 1, 1)
    named = (F.lower(first) != first) & ~is_slot(F.get(words, F.lit(0)))
    return F.when(named, F.concat(F.array(F.lit(NAME)), F.slice(words, 2, F.size(words))))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """Rows (key, item, n_windows, coverage, kind): every document and item that it contains."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    sizes = list(range(LEAST, WINDOW + 1))
    items = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).filter("item is not null").dropDuplicates()
    items = templated(items, "text", sizes).filter(F.size("words") >= LEAST).withColumn("span", F.least(F.size("words"), F.lit(WINDOW)))
    own = F.coalesce(*[F.when(F.col("span") == n, F.filter(f"w{n}", F.isnotnull)) for n in sizes])
    items = items.select("item", "span", F.col("raw").alias("item_raw"), F.col("words").alias("item_words"), own.alias("own")).withColumn("literal", counting("own"))
    # an item of hardly any literal words counts by all its windows, and must then be there word for word
    items = items.withColumn("counted", F.when(F.size("literal") > 0, F.col("literal")).otherwise(F.array_distinct("own"))).withColumn("strict", F.size("literal") == 0).drop("literal")
    second = windows_of(items.select("item", "item_raw", "strict", "span", other_reading(F.col("item_words"), F.col("item_raw")).alias("words")).filter("words is not null"), sizes)
    second = second.select("item", "item_raw", F.coalesce(*[F.when(F.col("span") == n, F.get(f"w{n}", F.lit(0))) for n in sizes]).alias("second"))
    items = scratch.write(items.join(second, ["item", "item_raw"], "left"), "items")
    # (item, hash, the window that it stands for, number of windows); the first window may stand under two hashes
    pieces = items.select("item", F.explode("counted").alias("hash"), F.size("counted").alias("total")).withColumn("window", F.col("hash"))
    heads = items.filter("second is not null and array_contains(counted, own[0])").select("item", F.col("second").alias("hash"), F.size("counted").alias("total"), F.expr("own[0]").alias("window"))
    pieces = scratch.write(pieces.unionByName(heads), "windows")
    spans = sorted(r[0] for r in items.select("span").distinct().collect())  # at most WINDOW values

    held = templated(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), "text", spans)
    found = F.concat(*[F.array_distinct(F.filter(f"w{n}", F.isnotnull)) for n in spans]) if spans else F.array().cast("array<bigint>")
    # explode() would have the optimizer push a filter on the arrays' size below, and build them once more for it
    held = held.select("id", F.explode_outer(found).alias("hash")).filter("hash is not null and id is not null")
    pairs = held.join(small(pieces), "hash")
    pairs = pairs.groupBy("id", "item").agg(F.count_distinct("window").alias("n_windows"), F.first("total").alias("total"))
    pairs = scratch.write(pairs.filter(F.col("n_windows") >= COVERAGE * F.col("total")), "pairs")

    near = small(scratch.write(pairs.select("id").distinct(), "candidates"))
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(near, "id", "left_semi")
    both = templated(texts, "text", spans).select("id", "raw", "words", *[f"w{n}" for n in spans])
    both = both.join(pairs, "id").join(items.drop("counted"), "item")
    theirs = F.coalesce(*[F.when(F.col("span") == n, F.col(f"w{n}")) for n in spans]) if spans else F.col("own")
    both = both.select(F.monotonically_increasing_id().alias("number"), "id", "item", "n_windows", "total", "span", "strict", "item_raw", "item_words", "raw", "words", theirs.alias("theirs"))
    both = scratch.write(both, "beside")
    places = items.select("item", "counted", "second", F.posexplode_outer("own").alias("i", "hash")).filter("array_contains(counted, hash)")
    places = places.select("item", "i", "hash").unionByName(places.filter("i = 0 and second is not null").select("item", "i", F.col("second").alias("hash"))).distinct()
    places = small(scratch.write(places, "places"))
    met = both.select("number", "item", F.posexplode_outer("theirs").alias("j", "hash")).filter("hash is not null").join(places, ["item", "hash"])
    met = scratch.write(met.select("number", "i", (F.col("j") - F.col("i")).alias("shift")), "met")
    shifts = met.groupBy("number", "shift").agg(F.count("*").alias("n"))
    own = met.join(shifts, ["number", "shift"]).groupBy("number", "i").agg(F.max(F.struct("n", (-F.col("shift")).alias("back"))).alias("best"))
    own = own.groupBy("number").agg(F.collect_list(F.struct("i", (-F.col("best.back")).alias("shift"))).alias("laid"))
    both = both.drop("theirs").join(shifts.groupBy("number").agg(F.collect_list("shift").alias("shifts")), "number").join(own, "number")
    slot = "struct(item_words[i] as t, get(words, i + {0}) as u, item_raw[i] as x, get(raw, i + {0}) as y)"
    whole = f"transform(shifts, s -> transform(sequence(0, size(item_words) - 1), i -> {slot.format('s')}))"
    alone = f"flatten(transform(laid, w -> transform(sequence(w.i, w.i + span - 1), i -> {slot.format('w.shift')})))"
    both = both.withColumn("whole", F.expr(whole)).withColumn("alone", F.expr(alone))

    def same(s: Column) -> Column:
        """Whether the words at a place are equal but for case and the punctuation around them."""
        return F.coalesce(F.lower(plain(s["x"])) == F.lower(plain(s["y"])), F.lit(False))

    def kind(layout: Column) -> Column:
        slots = F.filter(layout, lambda s: (s["t"] == s["u"]) & is_slot(s["t"]))
        slots = F.array_distinct(F.transform(slots, lambda s: F.struct(s["t"].alias("t"), plain(s["x"]).alias("x"), plain(s["y"]).alias("y"))))
        return F.struct(
            (F.size(slots) == F.size(F.array_distinct(F.transform(slots, lambda s: F.struct(s["t"], s["x"]))))).alias("consistent"), F.forall(slots, lambda s: s["x"] == s["y"]).alias("equal")
        )

    both = both.withColumn("exact", F.exists("whole", lambda layout: F.forall(layout, same)))
    kinds = F.filter(F.transform(F.concat("whole", F.array("alone")), kind), lambda k: k["consistent"])
    both = both.withColumn("kinds", F.when(F.col("strict"), F.array().cast("array<struct<consistent: boolean, equal: boolean>>")).otherwise(kinds))
    both = both.filter(F.col("exact") | (F.size("kinds") > 0)).select(
        F.col("id").alias(key),
        F.col("item").alias(item),
        F.col("n_windows").cast("bigint").alias("n_windows"),
        (F.col("n_windows") / F.col("total")).alias("coverage"),
        F.when(F.col("exact"), "exact").when(F.exists("kinds", lambda k: k["equal"]), "partial").otherwise("reparameterised").alias("kind"),
    )
    return both.groupBy(key, item).agg(F.max("n_windows").alias("n_windows"), F.max("coverage").alias("coverage"), F.min("kind").alias("kind"))
