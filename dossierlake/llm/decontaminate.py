"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

A text is brought to a common form as a whole, by a few regular expressions, and from that to typed
placeholders for numbers, names and units. Each template window of the benchmark is filed under a run of
words that stand outside its slots; hashes of all such runs in the documents are joined with them, and the
windows are compared where a run was found. A literal window counts as it is; in a template window equal
slots of the item must be equal in the document, so a question with other numbers or names is found, and
chance is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.common import staged, text_mark, without

WINDOW = 13
SHORT_WINDOW = 7
LEAST_LITERAL = 7  # words outside slots that a window of WINDOW must have
SHORT_LITERAL = 5  # and that a shorter item must have
RUNS = (4, 2, 1)  # lengths of the runs that windows are filed under, the longest that a window has
MOST_BROADCAST = 2_000_000  # runs of the benchmark (32 bytes each) that are broadcast at once; more of them take a pass over the documents for each such block

MARKS = ".,;:!?\"'()[]{}<>*#$%&|_-=+~`/\\«»"  # with U+2010 to U+2027 (dashes, quotes, dots) and white space: these do not count at a word's edge
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles g kg mg lb lbs pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur gbp percent "
    "degree degrees kmh mph hz khz mhz ghz w kw kwh v volt volts kb mb gb tb"
).split()
COMMON = (  # words that begin a sentence without being a name
    "a an the this that these those i he she it we you they his her its our your their my if when while after before since because although as at by for from in into of on to with without during "
    "and or but so then thus hence how what which who whose whom where why is are was were be do does did has have had can could will would shall should may might must there here now each every "
    "both all some many most no not one two three four five six seven eight nine ten find calculate compute suppose given let consider assume determine please however therefore first next finally also"
).split()

# classes of regular expressions; \x01 stands for a gap between words that ends a sentence, a blank for any other
_E = "".join("\\" + x if x.isascii() else x for x in MARKS) + "\\u2010-\\u2027"  # one range, since each character above Latin-1 slows every match
_S = "\\x20\\x09-\\x0D"
_UNIT = "(?i:" + "|".join(sorted(UNITS, key=len, reverse=True)) + ")"
_END = "(?![^ \\x01])"
_NAME = "\\p{Lu}[\\p{Ll}'-]++" + _END
#: Applied in this order; possessive and anchored at a run's start, so that long runs of marks take linear time and no stack.
BARE = (
    ("([0-9])(" + _UNIT + ")(?![0-9A-Za-z])", "$1 $2"),
    (f"(?<![{_E}{_S}])(?=[{_E}]*+[{_S}])(?=[{_E}{_S}]*[.!?:])[{_E}{_S}]++", "\x01"),
    (f"(?<![{_E}{_S}])[{_E}]*+[{_S}][{_E}{_S}]*+", " "),
    (f"^[{_E}{_S}\\x01]++|(?<![{_E}{_S}\\x01])[{_E}{_S}\\x01]++$", ""),
)
TEMPLATE = (
    ("(^|[ \\x01])[0-9]++(?:[.,:/-][0-9]++)*+(?:st|nd|rd|th)?" + _END, "$1<num>"),
    ("<num>([ \\x01])" + _UNIT + _END, "<num>$1<unit>"),
    (" " + _NAME, " <name>"),
)
WIDE = (("(^|\\x01)(?!(?i:" + "|".join(COMMON) + ")" + _END + ")" + _NAME, "$1<name>"),)


def _replaced(text: F.Column, rules: tuple[tuple[str, str], ...]) -> F.Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def _bare(df: DataFrame, *keys: str) -> DataFrame:
    """keys and _bare: the words of `text` without edge marks, parted by blanks, or by \\x01 where a sentence ends."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\x01"), F.lit(" "))
    return df.select(*keys, _replaced(text, BARE).alias("_bare"))


def _split(name: str, by: str = " ") -> F.Column:
    """The words of a text in that form, where by stands for \\x01."""
    return F.when(F.col(name) == "", F.array().cast("array<string>")).otherwise(F.split(F.replace(name, F.lit("\x01"), F.lit(by)), " "))


def _forms(bare: DataFrame, *keys: str) -> DataFrame:
    """keys and three arrays with one entry per word of `_bare`: literal (lower case), template (a placeholder where there is a slot) and wide (the same, with names that begin a sentence)."""
    # each form is a projection of its own, since the next one begins with it
    template = bare.select(*keys, "_bare", _replaced(F.col("_bare"), TEMPLATE).alias("_template"))
    wide = template.select(*keys, "_bare", "_template", _replaced(F.col("_template"), WIDE).alias("_wide"))
    lowered = wide.select(*keys, *[F.lower(f"_{x}").alias(f"_{x}") for x in ("bare", "template", "wide")])
    return lowered.select(*keys, _split("_bare").alias("literal"), _split("_template").alias("template"), _split("_wide").alias("wide"))


def canonical_words(df: DataFrame, *keys: str) -> DataFrame:
    """keys and the forms (literal, template, wide) of the words of `text`.

    Words of marks alone are left out, and a unit glued to its number is a word. A sentence begins with the
    text and after a gap that holds one of . ! ? and :.
    """
    return _forms(_bare(df, *keys), *keys)


def _runs(words: DataFrame, keys: list[str], lengths: list[int]) -> DataFrame:
    """keys and an array run_n for each length n in `lengths`: hashes of all n consecutive literal words, by their start.

    Each step is a projection of its own: inside a lambda, an array that is not a column would be computed
    again for every word. No filter on the number of words is given: pushed down, it would compute the words twice.
    """

    def beside(name: str, by: int) -> F.Column:  # a length beyond the words gives no entries
        left = F.greatest(F.size(name) - by, F.lit(0))
        return F.zip_with(F.slice(name, 1, left), F.slice(name, by + 1, left), lambda a, b: F.xxhash64(a, b))

    one, two = F.transform("literal", lambda w: F.xxhash64(w)), beside("literal", 1)
    now = words.select(*keys, *([one.alias("run_1")] if 1 in lengths else []), *([two.alias("run_2")] if {2, 4} & set(lengths) else []))
    if 4 in lengths:
        now = now.select(*now.columns, beside("run_2", 2).alias("run_4"))
    return now.select(*keys, *[f"run_{n}" for n in lengths])


def _filed(items: DataFrame, window: int, short_window: int) -> DataFrame:
    """length, hash, item_id, item_at and size (of the item) of the runs by which the windows of all items are found.

    A window with words enough outside its slots is filed under a run of such words, since a document that
    matches it in any form holds them literally; the least hash is taken, so that neighbouring windows share a run. Other
    windows match as they are only, and are filed under any run. Items shorter than `window` are one window.
    """
    size = F.size("literal")
    of, least = F.when(size >= window, window).otherwise(size), F.when(size >= window, LEAST_LITERAL).otherwise(SHORT_LITERAL)
    own = _runs(items, ["item_id", "literal", "wide"], list(RUNS)).withColumns({"of": of, "least": least, "fixed": F.zip_with("literal", "wide", lambda a, b: a == b)})
    part = lambda name, at, n: F.slice(name, at + 1, n)

    def places(n: int) -> F.Column:
        return F.transform(f"run_{n}", lambda h, i: F.struct(F.lit(n).alias("length"), h.alias("hash"), i.alias("item_at"), F.forall(part("fixed", i, F.lit(n)), lambda x: x).alias("fixed")))

    own = staged(own.withColumns({f"run_{n}": places(n) for n in RUNS}), "benchmark-places")  # laid down, since the lambdas below read it for every window
    windows = own.select("*", F.explode(F.sequence(F.lit(0), size - F.col("of"))).alias("at"))
    slotted = (size >= short_window) & (F.size(F.filter(part("fixed", F.col("at"), F.col("of")), lambda x: x)) >= F.col("least"))
    inside = lambda n, fixed: F.array_min(F.filter(f"run_{n}", lambda r: (r["item_at"] >= F.col("at")) & (r["item_at"] + n <= F.col("at") + F.col("of")) & (r["fixed"] | F.lit(not fixed))))
    run = F.when(slotted, F.coalesce(*[inside(n, True) for n in RUNS])).otherwise(F.coalesce(*[inside(n, False) for n in RUNS]))
    return windows.select("item_id", size.alias("size"), run.alias("run")).select("item_id", "size", "run.length", "run.hash", "run.item_at").distinct()


def _found(docs: DataFrame, benchmark: DataFrame, window: int, short_window: int) -> DataFrame:
    """doc_id, mark, item_id, n_windows, covered, slots: the alignments that hold."""
    items = staged(canonical_words(benchmark.select("item_id", "text"), "item_id"), "benchmark-words").filter(F.size("literal") > 0)
    filed = staged(_filed(items, window, short_window), "benchmark-runs")
    lengths = sorted(r["length"] for r in filed.select("length").distinct().collect()) or [1]  # some of RUNS
    blocks = max(1, -(-filed.count() // MOST_BROADCAST))
    bare = _bare(docs.select("doc_id", text_mark(), "text"), "doc_id", "mark").select("doc_id", "mark", F.lower("_bare").alias("_lower"), "_bare")
    # of the words as written, those that begin a sentence keep the mark
    rows = _runs(bare.select("doc_id", "mark", _split("_lower").alias("literal"), _split("_bare", " \x01").alias("written")), ["doc_id", "mark", "written"], lengths)
    each = rows.select("doc_id", "mark", "written", F.inline(F.array(*[F.struct(F.lit(x).alias("length"), F.col(f"run_{x}").alias("hashes")) for x in lengths])))
    each = each.select("doc_id", "mark", "written", "length", F.posexplode("hashes").alias("at", "hash"))
    shift = F.col("at") - F.col("item_at")
    first = F.greatest(shift, F.lit(0))
    lead = F.least(first, F.lit(1))  # with the word before, which decides on units and names
    there = F.slice("written", first - lead + 1, F.least(F.size("written"), shift + F.col("size")) - first + lead)
    found = None
    for b in range(blocks):
        # the words stay in the row until a run is found: the join is with a broadcast side, so they are neither copied nor shuffled
        hits = each.join(F.broadcast(filed.filter(F.pmod("hash", F.lit(blocks)) == b)), ["hash", "length"])
        hits = hits.select("doc_id", "mark", "item_id", shift.alias("shift"), lead.alias("lead"), F.array_join(there, " ").alias("written"))
        found = hits if found is None else found.unionByName(hits)
    hits = staged(found.dropDuplicates(["doc_id", "mark", "item_id", "shift"]), "alignments")

    own = ["doc_id", "mark", "item_id", "shift", "lead"]
    written = F.replace(F.regexp_replace("written", "^\x01", ""), F.lit(" \x01"), F.lit("\x01"))
    zipped = F.arrays_zip("literal", "template", "wide")
    theirs = _forms(hits.select(*own, written.alias("_bare")), *own).select(*own, zipped.alias("theirs")).select("doc_id", "mark", "item_id", "shift", F.slice("theirs", F.col("lead") + 1, F.size("theirs")).alias("theirs"))
    words = items.select(F.col("item_id").alias("item_"), zipped.alias("words"))
    aligned = theirs.join(words, F.col("item_id").eqNullSafe(F.col("item_")))
    size, low = F.size("words"), F.greatest(F.lit(0), -F.col("shift"))
    length = F.least(size - low, F.size("theirs"))
    pair = lambda a, b: F.struct(
        a["literal"].alias("a"), b["literal"].alias("b"), a["wide"].alias("ta"), b["wide"].alias("tb"), (a["literal"] == b["literal"]).alias("same"),
        ((a["literal"] == b["literal"]) | (a["template"] == b["template"]) | (a["wide"] == b["wide"])).alias("fits"), (a["literal"] == a["wide"]).alias("fixed"),
    )
    pairs = F.zip_with(F.slice("words", low + 1, length), F.slice("theirs", 1, length), pair)
    of = F.when(size >= window, window).otherwise(size)
    spans = aligned.filter(length >= of).select("doc_id", "mark", "item_id", of.alias("of"), size.alias("size"), low.alias("low"), pairs.alias("pairs"))
    part = lambda x: F.slice("pairs", x - F.col("low") + 1, F.col("of"))
    least = F.when(F.col("of") >= window, LEAST_LITERAL).otherwise(SHORT_LITERAL)
    # with a guard, since filters may be evaluated in any order
    starts = F.when(F.size("pairs") >= F.col("of"), F.sequence(F.col("low"), F.col("low") + F.size("pairs") - F.col("of"))).otherwise(F.array().cast("array<int>"))
    spans = staged(spans, "spans")  # laid down, as above
    spans = spans.withColumn("verbatim", F.filter(starts, lambda x: F.forall(part(x), lambda p: p["same"])))
    slotted = lambda x: F.forall(part(x), lambda p: p["fits"]) & (F.size(F.filter(part(x), lambda p: p["fixed"])) >= least)
    slots_of = lambda own: F.filter(own, lambda p: (p["ta"] == p["tb"]) & ((p["ta"] != p["a"]) | (p["a"] != p["b"])))
    distinct = lambda own, *names: F.size(F.array_distinct(F.transform(slots_of(own), lambda p: F.struct(p["ta"], *[p[x] for x in names]))))
    # within each type of placeholder, what is equal in the item stays equal; what differs may become equal
    consistent = lambda own: distinct(own, "a") == distinct(own, "a", "b")
    at = F.filter(starts, lambda x: F.array_contains("verbatim", x) | ((F.col("size") >= short_window) & slotted(x) & consistent(part(x))))
    told = spans.withColumn("at", at).filter(F.size("at") > 0)
    covered = F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x, x + F.col("of") - 1))))
    told = told.withColumn("covered", covered)
    slots = slots_of(F.filter("pairs", lambda p, i: F.array_contains("covered", i + F.col("low"))))
    return told.select("doc_id", "mark", "item_id", F.size("at").alias("n_windows"), F.size("covered").alias("n_words"), slots.alias("slots"))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, short_window: int = SHORT_WINDOW) -> DataFrame:
    """doc_id, item_id, n_windows, n_words (covered words of the item), n_slots, n_changed: one row per document and item it holds.

    An item of at least `window` words is found by any window of it, one of `short_window` words up only
    as a whole, and a shorter one only as a whole and word for word. Case, edge punctuation and
    white space do not matter. Null and empty texts hold nothing; rows that share an id count as one
    document; a repeated item is found under each of its ids; null ids stay null. An empty table on
    either side gives no rows. Columns besides doc_id, text, item_id and text are not read.
    """
    told = _found(docs, benchmark, window, short_window)
    changed = F.size(F.filter("slots", lambda p: p["a"] != p["b"]))
    best = told.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", "n_words", F.size("slots").alias("n_slots"), changed.alias("n_changed"))).alias("best"))
    return best.select("doc_id", "item_id", *[F.col(f"best.{x}").cast("long").alias(x) for x in ("n_windows", "n_words", "n_slots", "n_changed")])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns, whatever their names.

    Rows are told apart by id and text, so of rows that share an id, or have none, only those that hold an
    item go. Null and empty texts stay; repeated rows stay or go together; an empty table gives no rows.
    """
    return without(docs, _found(docs, benchmark, WINDOW, SHORT_WINDOW).select("doc_id", "mark"), "contaminated")
