"""Secret scan with column expressions only.

Named patterns give the base spans.  Beyond them, candidate strings (long runs of
token characters) are searched with a sliding window of Shannon entropy for their
character class: a fold over the characters holds the counts of the window, adds
the entering and drops the leaving character, and updates sum(c*log2(c)) by the
two counts that changed.  Base spans and leading path segments of plain words are
cut out of a candidate first; what remains is suppressed if it is on the allow-list.

Offsets count code points.  Spark has no function that returns the positions of
all matches, so they follow from the lengths of the pieces between the matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (kind, pattern, group whose length counts, least length); the order is that of equal starts.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs are maximal, so runs of 24 and more are the matches of [0-9a-f]+ that do not fail.
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED = "entropy"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: character class of a candidate, with the entropy in bits from which a window is taken for random
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 3.0), ("token", r"^[A-Za-z0-9+/_=-]+$", 3.7))
#: candidates that are no secrets: no digit at all, digits and separators alone, one symbol repeated, UUIDs, paths of words, placeholders
ALLOWED = (
    r"^[^0-9]+$",
    r"^[0-9_/=+-]+$",
    r"^(.)\1*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^/?([a-z]+[0-9]{0,4}[/_-])+[a-z]*[0-9]{0,4}$",
    r"(?i)example|sample|placeholder|xxxx|changeme",
)
#: leading segments of a path, which say nothing about the token behind them
PATH = r"^/?([a-z]+[0-9]{0,4}/)+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def located(text: Column, pattern: str, group: int) -> Column:
    """array<struct<s, e, g, m>> of leftmost non-overlapping matches: start, end, text of the group and of the match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<s:int,e:int,g:string,m:string>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("s"), end.alias("e"), x["g"].alias("g"), x["m"].alias("m"))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    zipped = F.filter(F.arrays_zip(pieces.alias("p"), found.alias("m"), groups.alias("g")), lambda x: x["m"].isNotNull())
    return F.when(text.rlike(pattern), F.aggregate(zipped, start, step)["out"]).otherwise(empty)


def _clogc(c: Column) -> Column:
    return F.when(c <= 1, F.lit(0.0)).otherwise(c * F.log2(c))


def _set(counts: Column, at: Column, value: Column) -> Column:
    """counts with the entry at 1-based `at` replaced."""
    return F.concat(F.slice(counts, 1, at - 1), F.array(value), F.slice(counts, at + 1, len(ALPHABET)))


def random_range(candidate: Column, bits: Column) -> Column:
    """struct<first, last>: from the first to behind the last window of WINDOW characters with entropy of `bits` or more; null ends if there is none."""
    indexed = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET)))
    # Each step has the entering symbol and the one that leaves (0 while the window fills).
    leaving = F.concat(F.array_repeat(F.lit(0), WINDOW), indexed)
    steps = F.filter(F.arrays_zip(indexed.alias("x"), leaving.alias("y")), lambda z: z["x"].isNotNull())
    zero = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("c"), F.lit(0.0).alias("s"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last")
    )

    def step(acc, z):
        old = F.element_at(acc["c"], F.when(z["y"] > 0, z["y"]).otherwise(1))
        without = F.when(z["y"] > 0, _set(acc["c"], z["y"], old - 1)).otherwise(acc["c"])
        less = F.when(z["y"] > 0, acc["s"] - _clogc(old) + _clogc(old - 1)).otherwise(acc["s"])
        return F.struct(without.alias("c"), less.alias("s"), acc["i"].alias("i"), acc["first"].alias("first"), acc["last"].alias("last"), z["x"].alias("x"))

    def enter(acc):
        old = F.element_at(acc["c"], acc["x"])
        s = acc["s"] - _clogc(old) + _clogc(old + 1)
        i = acc["i"] + 1
        hit = (i >= WINDOW) & (F.log2(F.lit(float(WINDOW))) - s / WINDOW >= bits)
        return F.struct(
            _set(acc["c"], acc["x"], old + 1).alias("c"),
            s.alias("s"),
            i.alias("i"),
            F.coalesce(acc["first"], F.when(hit, i - WINDOW)).alias("first"),
            F.when(hit, i).otherwise(acc["last"]).alias("last"),
        )

    def both(acc, z):
        # The inner one-element fold binds the state after the leaving symbol once.
        return F.element_at(F.transform(F.array(step(acc, z)), enter), 1)

    return F.aggregate(steps, zero, both)


def uncovered(run: Column, base: Column) -> Column:
    """array<struct<s, m>>: start and text of the parts of a located run outside base spans and without a leading path, WINDOW characters at least."""
    meet = F.filter(base, lambda b: (b["start"] < run["e"]) & (run["s"] < b["end"]))
    ends = F.concat(F.array(run["s"]), F.transform(meet, lambda b: b["end"]))
    starts = F.concat(F.transform(meet, lambda b: b["start"]), F.array(run["e"]))

    def part(to, i):
        # Base spans are sorted by start but may overlap: the part before one begins where all earlier ones have ended.
        at = F.array_max(F.slice(ends, 1, i + 1))
        return F.struct(at.alias("s"), run["m"].substr(at - run["s"] + 1, to - at).alias("m"))

    def behind_path(x):
        skip = F.length(F.regexp_extract(x["m"], PATH, 0))
        return F.struct((x["s"] + skip).alias("s"), x["m"].substr(skip + 1, F.length(x["m"])).alias("m"))

    return F.filter(F.transform(F.transform(starts, part), behind_path), lambda x: F.length(x["m"]) >= WINDOW)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, added: two arrays of (start, rank, kind, end), each sorted by start, then kind.

    Null texts count as empty.  Added spans never overlap a base span.
    Other columns are ignored; each input row gives one row, and nothing is shuffled.
    """
    text = F.coalesce(F.col("__t"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__t"))

    def spans(kind: str, rank: int, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(x["s"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["e"].alias("end")))

    def long_enough(least: int):
        return lambda x: F.length(x["g"]) >= least  # a second parameter, even a default one, would be the element's place

    base = F.array_sort(F.concat(*[spans(kind, rank, F.filter(located(text, pattern, group), long_enough(least))) for rank, (kind, pattern, group, least) in enumerate(BASE)]))

    def promising(x):
        """A digit and a letter are in the run, without which the allow-list takes every part of it."""
        return x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]")

    def suspicious(x):
        allowed = F.lit(False)
        for pattern in ALLOWED:
            allowed = allowed | x["m"].rlike(pattern)
        return ~allowed

    def threshold(x):
        bits = F.lit(CLASSES[-1][2])
        for _, pattern, b in reversed(CLASSES[:-1]):
            bits = F.when(x["m"].rlike(pattern), F.lit(b)).otherwise(bits)
        return bits

    def measured(x):
        return F.element_at(
            F.transform(
                F.array(random_range(x["m"], threshold(x))),
                lambda r: F.when(r["first"].isNotNull(), F.struct((x["s"] + r["first"]).alias("start"), F.lit(len(BASE)).alias("rank"), F.lit(ADDED).alias("kind"), (x["s"] + r["last"]).alias("end"))),
            ),
            1,
        )

    with_base = rows.select("doc_id", base.alias("base"), F.filter(located(text, CANDIDATE, 0), promising).alias("runs"))
    parts = F.filter(F.flatten(F.transform("runs", lambda x: uncovered(x, F.col("base")))), suspicious)
    with_parts = with_base.select("doc_id", "base", F.when(F.size("runs") > 0, parts).otherwise(F.array().cast("array<struct<s:int,m:string>>")).alias("parts"))
    added = F.when(F.size("parts") > 0, F.filter(F.transform("parts", measured), lambda x: x.isNotNull()))
    return with_parts.select("doc_id", "base", F.coalesce(added, F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(kind) for kind, *_ in BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"))
