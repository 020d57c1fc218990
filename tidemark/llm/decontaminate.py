"""Benchmark decontamination by template canonicalisation, with column expressions only.

Numbers, units and names become typed placeholders and punctuation goes, so a
question keeps its template when it is asked again with other values.  A run of
names is one placeholder, and so is a number with its unit, as other values may
have more or fewer words.  Windows of template words are hashed and joined with
those of the benchmark, and so are windows of case-folded literal words, as
templates depend on case.  Windows mostly of placeholders are no evidence as
templates.

Matches on one diagonal (document position minus item position, in literal words),
or on diagonals at most SHIFT apart, add up to covered words; a document is
contaminated where they reach NEED_WORDS or half of the item, a placeholder being
one word.  Where covered words are placeholders, the values must correspond
consistently: one value of the item to one of the document, and the other way
round.  Matches of literal windows are of equal values and need no such check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, scratched

WIDTH = 8
NEED_WORDS = 13
LEAST_LITERAL = 0.5  # of WIDTH, or of a shorter item, are literal in a template window; with fewer, literal words alone are matched
SHIFT = 8  # words between neighbouring diagonals of one item
BROADCAST_ROWS = 150_000  # benchmark windows of about 100 bytes, so 15 MB; beyond, the join shuffles

#: Placeholders are private-use characters, which no letter class contains.
NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"
SLOTS = "\ue000-\ue002"
#: Units of measure, currency and time that are replaced as whole words.
UNITS = (
    "mm cm m km in ft yd mi miles mile meter meters metre metres kilometers kilometres inches inch feet foot yards "
    "mg g kg lb lbs oz ounces pounds grams kilograms tons tonnes ml l liter liters litre litres gallons cups "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "percent dollars dollar cents cent euros euro usd eur gbp mph kmh degrees celsius fahrenheit"
).split()

#: Capitalised words that are no names.
FUNCTION = (
    "The A An In On At Of For From To With By As If It Its Is Are Was Were Be And Or But Not No So Then There This That These Those He She They We You I "
    "What Which Who Whom Whose When Where Why How Each Every All Some Any One After Before During While Do Does Did Has Have Had Can Could Will Would Should"
).split()


def templated(text: Column) -> Column:
    """Words with numbers and names as placeholders, one for each word of literal(text)."""
    edge = r"[^\p{L}\p{N}\s]*"
    t = F.regexp_replace(text, f"[{SLOTS}]", "")
    t = F.regexp_replace(t, rf"(?<!\S){edge}\p{{N}}[\p{{N}}.,:/]*(?:\p{{L}}{{1,3}})?{edge}(?!\S)", NUMBER)
    # Units come before names, so a unit's name is one whatever its case; they are set word by word, below.
    t = F.regexp_replace(t, rf"(?<!\S){edge}(?=\p{{Lu}})(?!(?:{'|'.join(FUNCTION)})(?![\p{{L}}\p{{N}}]))\S+", NAME)
    t = F.regexp_replace(F.lower(t), rf"[^\p{{L}}\p{{N}}\s{SLOTS}]+", "")
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def with_units(words: Column, plain: Column) -> Column:
    """templated() words, those whose literal word is a unit, but for the first, being its placeholder."""
    return F.transform(words, lambda w, i: F.when((i > 0) & (w != NUMBER) & F.get(plain, i).isin(UNITS), UNIT).otherwise(w))


def literal(text: Column) -> Column:
    """The words themselves, case-folded, without punctuation."""
    t = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]+", "")
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def units(words: Column) -> Column:
    """Place of the first word of each template unit: runs of names are one, and so is a number with its unit."""

    def goes_on(w, i):
        before = F.get(words, i - 1)
        return (i > 0) & (((w == NAME) & (before == NAME)) | ((w == UNIT) & (before == NUMBER)))

    return F.filter(F.transform(words, lambda w, i: F.when(~F.coalesce(goes_on(w, i), F.lit(False)), i)), lambda i: i.isNotNull())


def value_hash(plain: Column, starts: Column, k: Column) -> Column:
    """Hash of the literal words of template unit k, of hashed words."""
    at = F.get(starts, k)
    return F.xxhash64(F.slice(plain, at + 1, F.coalesce(F.get(starts, k + 1), F.size(plain)) - at))


def window_hash(hashes: Column, k: Column, width: int, family: Column) -> Column:
    """Hash of the `width` words from place k on; windows of template units (family 1) and of literal words (0) do not meet."""
    return F.xxhash64(family, *[F.get(hashes, k + i) for i in range(width)])


def windows(rows: DataFrame, keep: list[str], widths: list[int]) -> tuple[DataFrame, Column]:
    """(rows, values): a row keep, p, k, w, ... for each window of the `widths`, of both families, of the texts in shaped() rows; k is its place and p its first literal word.

    values, a column to be made of the rows that are wanted, holds the hashed literal words of each unit of a template window; it is null for other windows.
    The windows are numbers until a row is theirs, so hashing them is compiled code and no array of windows is built."""
    hashed = rows.select(*keep, "starts", *[F.transform(c, lambda w: F.xxhash64(w)).alias(c) for c in ("plain", "words")])

    def numbers(words: str, family: int, width: int) -> Column:
        first, places = 16 * family + width, F.size(words) - width
        return F.when(places >= 0, F.sequence(F.lit(first).cast("long"), F.lit(first) + 32 * places.cast("long"), F.lit(32).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    every = F.concat(*[numbers(c, f, width) for width in widths for f, c in enumerate(("plain", "words"))])
    placed = hashed.select("*", F.explode(every).alias("x"))
    k, family, size = F.shiftright("x", 5).cast("int"), F.shiftright(F.col("x").bitwiseAND(F.lit(16)), 4).cast("int"), F.col("x").bitwiseAND(F.lit(15))
    placed = placed.select(*keep, "starts", "plain", k.alias("k"), family.alias("family"), size.alias("size"), F.when(family == 1, F.col("words")).otherwise(F.col("plain")).alias("hashes"))
    w = None
    for width in widths:
        found = window_hash(F.col("hashes"), F.col("k"), width, F.col("family"))
        w = found if len(widths) == 1 else F.when(F.col("size") == width, found) if w is None else w.when(F.col("size") == width, found)
    p = F.when(F.col("family") == 1, F.get("starts", F.col("k"))).otherwise(F.col("k"))
    values = F.when(F.col("family") == 1, F.array(*[value_hash(F.col("plain"), F.col("starts"), F.col("k") + i) for i in range(max(widths))]))
    return placed.select(*keep, p.alias("p"), "k", w.alias("w"), "family", "plain", "starts"), values


def shaped(rows: DataFrame, text: Column) -> DataFrame:
    """rows with plain (literal words), starts (of template units) and words (template units)."""
    out = rows.withColumn("raw", templated(text)).withColumn("plain", literal(text))
    out = out.withColumn("raw", with_units(F.col("raw"), F.col("plain"))).withColumn("starts", units(F.col("raw")))
    return out.withColumn("words", F.transform("starts", lambda i: F.get("raw", i))).drop("raw")


SLOTS_TYPE = "array<struct<i:int,kind:string,a:bigint>>"


def benchmark_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(w, item_id, item_words, item_units, width, a, b, ua, ub, slots): windows of each item; items shorter than WIDTH are one window of their own width.

    [a, b) are the literal words of the window, [ua, ub) its template units.  slots: place, kind and hashed value of the placeholders of a template window, null for one of literal words."""
    held = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).where("item_id is not null")
    held = shaped(held, F.col("t")).withColumn("item_words", F.size("plain")).withColumn("item_units", F.size("words")).where("item_words > 0")
    hashed = lambda c, family: F.xxhash64(F.lit(family), F.transform(c, lambda w: F.xxhash64(w))).alias("w")
    ids = ["item_id", "item_words", "item_units", "width"]
    unit_of = lambda i: F.size(F.filter("starts", lambda s: s <= i)) - 1
    same = held.withColumn("width", F.least("item_words", F.lit(WIDTH))).select("*", F.explode(F.expr("sequence(0, item_words - width)")).alias("a")).withColumn("b", F.col("a") + F.col("width"))
    same = same.select(hashed(F.expr("slice(plain, a + 1, width)"), 0), *ids, "a", "b", unit_of(F.col("a")).alias("ua"), (unit_of(F.col("b") - 1) + 1).alias("ub"), F.lit(None).cast(SLOTS_TYPE).alias("slots"))
    part = held.withColumn("width", F.least("item_units", F.lit(WIDTH))).select("*", F.explode(F.expr("sequence(0, item_units - width)")).alias("ua")).withColumn("part", F.expr("slice(words, ua + 1, width)"))
    literals = F.size(F.filter("part", lambda w: ~w.isin(NUMBER, UNIT, NAME)))
    part = part.where((literals >= F.least("item_words", F.lit(WIDTH)) * LEAST_LITERAL) & (literals < F.col("width")))  # without placeholders, it is one of the others
    behind = F.expr("coalesce(get(starts, ua + width), item_words)")
    words = F.transform("plain", lambda w: F.xxhash64(w))
    slot = lambda j: F.struct(j.alias("i"), F.get("part", j).alias("kind"), value_hash(words, F.col("starts"), F.col("ua") + j).alias("a"))
    slots = F.filter(F.transform(F.sequence(F.lit(0), F.col("width") - 1), slot), lambda x: x["kind"].isin(NUMBER, UNIT, NAME)).cast(SLOTS_TYPE)
    part = part.select(hashed("part", 1), *ids, F.expr("get(starts, ua)").alias("a"), behind.alias("b"), "ua", (F.col("ua") + F.col("width")).alias("ub"), slots.alias("slots"))
    return same.unionByName(part).distinct()


def covered(spans: Column, start: str, end: str) -> Column:
    """Number of places that the spans cover."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x[start].alias("a"), x[end].alias("b"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["to"]))).alias("n"), F.greatest(s["to"], x["b"]).alias("to"))
    return F.aggregate(ordered, zero, step, lambda s: s["n"])


def contaminated(docs: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, th, item_id, matched_words, item_words): a row for each document and item it contains.

    th is xxhash64 of the text, so rows that share an id, or have none, are told
    apart by text; equal rows give one result row.  Null and empty texts match
    nothing.  An empty benchmark gives no rows.  Other columns are ignored.
    """
    bench = cut(benchmark_windows(items, item_id, item_text), "windows")
    widths = sorted(r[0] for r in bench.select("width").distinct().collect()) or [WIDTH]  # WIDTH values at most
    small = bench.count() <= BROADCAST_ROWS
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").alias("t")).where("t is not null")
    worded = shaped(own, F.col("t")).drop("t")
    # Texts are read and shaped once for the windows of all widths; hashes of different widths do not meet.
    places, values = windows(worded, ["doc_id", "th"], widths)
    if small:
        found = places.join(F.broadcast(bench), "w").withColumn("values", values)
    else:
        found = places.select("doc_id", "th", "p", "k", "w", values.alias("values")).join(bench.hint("merge"), "w")
    pairs = F.transform("slots", lambda x: F.struct(x["kind"].alias("kind"), x["a"].alias("a"), F.get("values", x["i"]).alias("b")))
    span = F.struct("a", "b", "ua", "ub", F.col("slots").isNull().alias("literal"), F.coalesce(pairs, F.array().cast("array<struct<kind:string,a:bigint,b:bigint>>")).alias("pairs"))
    hits = found.select("doc_id", "th", "item_id", "item_words", "item_units", (F.col("p") - F.col("a")).alias("diagonal"), span.alias("span"))
    key = ["doc_id", "th", "item_id", "item_words", "item_units"]
    runs = cut(hits.groupBy(*key, "diagonal").agg(F.collect_set("span").alias("spans")), "runs")
    # Runs count by themselves, and neighbouring ones together.
    along = Window.partitionBy(*key).orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > SHIFT).cast("int"), F.lit(0))
    chains = runs.withColumn("fresh", fresh).withColumn("chain", F.sum("fresh").over(along))
    chains = chains.groupBy(*key, "chain").agg(F.count("*").alias("c"), F.flatten(F.collect_list("spans")).alias("spans"), F.min("diagonal").alias("diagonal")).where("c > 1")
    groups = runs.unionByName(chains.select(*key, "diagonal", "spans")).where(consistent(F.flatten(F.transform("spans", lambda x: x["pairs"]))))
    alone = F.filter("spans", lambda x: x["literal"])
    least = lambda n: F.least(F.lit(NEED_WORDS), F.ceil(F.col(n) / 2))
    groups = groups.where((covered(alone, "a", "b") >= least("item_words")) | (covered(F.col("spans"), "ua", "ub") >= least("item_units")))
    strong = groups.withColumn("matched_words", covered(F.col("spans"), "a", "b"))
    return strong.groupBy("doc_id", "th", "item_id").agg(F.max("matched_words").cast("long").alias("matched_words"), F.max("item_words").cast("long").alias("item_words"))


def consistent(pairs: Column) -> Column:
    """Whether values of the item and of the document, (kind, a, b), correspond one to one."""
    distinct = F.array_distinct(pairs)
    sides = [F.array_distinct(F.transform(distinct, lambda x: F.struct(x["kind"], x[side]))) for side in "ab"]
    return (F.size(sides[0]) == F.size(distinct)) & (F.size(sides[1]) == F.size(distinct))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, matched_words, item_words of each contaminated document."""
    return contaminated(docs, items).select("doc_id", "item_id", "matched_words", "item_words")


@scratched
def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that no benchmark item contaminates; rows without text stay."""
    bad = cut(contaminated(docs, items).select("doc_id", "th").distinct(), "contaminated", outer=True)
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"]) == bad["th"]), "left_anti")
