"""License scans with DataFrame functions alone.

Ordered signature rules (``license_rules``) are matched where the words of their keyword occur. Detections are intervals of the
text; one that lies within a detection of higher priority, or of equal priority and greater or equal length, is
suppressed. Beside them stand the base phrases, which are told by whole words and never suppressed.

Defined cases: a null text counts as empty; a text without detections has empty labels, null places and score 0;
detections are ordered by start, length, priority and rule, so ties have one outcome; repeated rows are scanned alike;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import GATES, rules

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases, word by word, and their labels.
PHRASES = ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl"))
#: The score of a text in which only base phrases stand, such as "MIT. License".
BASE_SCORE = 0.4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEVELS = 4
#: Matches of a text that are folded together.
BLOCK = 128
RULES = rules()
WORDS = sorted({w for r in RULES for alt in r[2].split("/") for w in alt.split()})


def _rule_array() -> Column:
    """The rules; ``ways`` has the places in ``WORDS`` of each alternative's words."""
    names = ("rule", "label", "pattern", "priority", "confidence")
    ways = [F.array(*(F.array(*(F.lit(WORDS.index(w)) for w in alt.split())) for alt in r[2].split("/"))).alias("ways") for r in RULES]
    return F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(names, r[:2] + r[3:], strict=True)), w) for r, w in zip(RULES, ways, strict=True)))


def _hit(text: Column) -> Column:
    """The rules whose words the text holds. The words are looked for once, not once a rule."""
    held = F.transform(F.array(*(F.lit(w) for w in WORDS)), lambda w: F.contains(text, w))
    met = lambda held, r: F.exists(r["ways"], lambda way: F.forall(way, lambda i: F.get(held, i)))
    return F.get(F.transform(F.array(held), lambda h: F.filter(_rule_array(), lambda r: met(h, r))), F.lit(0))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _folded(items: Column, first: Column, total: Callable[[Column], Column], merge: Callable[[Column, Column], Column], fold: Callable[[Column, Column], Column]) -> Column:
    """What ``fold`` makes of each block of items, given the state before it, one after the other.

    An array that grows item by item is copied each time. So items are folded in blocks: the state before a block comes
    from the totals of those before it, and only a block's own array grows.
    """

    def cut(xs: Column) -> Column:
        last = F.greatest(F.ceil(F.size(xs) / BLOCK).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))

    def each(blocks: Column) -> Column:
        # states before the blocks, and the one behind the last; there are few
        states = F.aggregate(F.transform(blocks, total), F.array(first), lambda acc, t: F.concat(acc, F.array(merge(F.element_at(acc, -1), t))))
        return F.flatten(F.zip_with(blocks, F.slice(states, F.lit(1), F.size(blocks)), fold))

    return _once(items, lambda xs: _once(cut(xs), each))


SPANS = "array<struct<start:int,back:int,order:int,rule:int,label:string,stop:int,confidence:double>>"


def _matches(text: Column, rule: Column) -> Column:
    """Where the rule's pattern matches: array of start, stop, minus_stop and what the rule says."""
    found = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    gaps = F.transform(F.split(text, rule["pattern"], F.lit(-1)), lambda x: F.length(x))
    sized = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), F.transform(found, lambda m: F.length(m)), lambda g, m: F.struct(g.alias("gap"), m.alias("size")))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + x["size"]
        span = F.struct(start.alias("start"), (-stop).alias("back"), (-rule["priority"]).alias("order"), rule["rule"].alias("rule"), rule["label"].alias("label"), stop.alias("stop"), rule["confidence"].alias("confidence"))
        return F.struct(stop.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def block(items: Column, at: Column) -> Column:
        return F.aggregate(items, F.struct(at.alias("at"), F.array().cast(SPANS).alias("spans")), add, lambda a: a["spans"])

    length = lambda items: F.aggregate(items, F.lit(0), lambda a, x: a + x["gap"] + x["size"])
    return _folded(sized, F.lit(0), length, lambda at, n: at + n, block)


def _kept(spans: Column) -> Column:
    """Drops contained detections in one pass over those sorted by start, then longest, then highest priority."""
    nothing = F.array(*(F.lit(-1) for _ in range(LEVELS)))

    def reached(reach: Column, x: Column) -> Column:
        return F.transform(reach, lambda r, i: F.when(i == -x["order"], F.greatest(r, x["stop"])).otherwise(r))

    def add(acc: Column, x: Column) -> Column:
        inside = F.array_max(F.slice(acc["reach"], 1 - x["order"], F.lit(LEVELS))) >= x["stop"]
        return F.struct(reached(acc["reach"], x).alias("reach"), F.when(inside, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x))).alias("kept"))

    def block(items: Column, reach: Column) -> Column:
        return F.aggregate(items, F.struct(reach.alias("reach"), F.array().cast(SPANS).alias("kept")), add, lambda a: a["kept"])

    furthest = lambda items: F.aggregate(items, nothing, reached)
    return _folded(F.array_sort(spans), nothing, furthest, lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)), block)


def _has_base(words: Column, i: Column) -> Column:
    return reduce(lambda a, b: a | b, (_is(words, i, phrase) for phrase, _ in PHRASES))


def _is(words: Column, i: Column, phrase: tuple[str, ...]) -> Column:
    return F.coalesce(reduce(lambda a, b: a & b, (F.get(words, i + k) == w for k, w in enumerate(phrase))), F.lit(False))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, detections (array of start, stop, label, rule, confidence), places (first words of base phrases)
    and base (their labels)."""
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    rows = docs.select("doc_id", low.alias("low"))
    gate = reduce(lambda a, b: a | b, (F.contains("low", F.lit(g)) for g in GATES))
    rows = rows.select("doc_id", F.regexp_count("low", F.lit(WORD)).cast("long").alias("n_words"), F.when(gate, F.col("low")).alias("gated"), F.when(F.contains("low", F.lit("license")), F.regexp_extract_all("low", F.lit(WORD), F.lit(0))).alias("words"))
    found = F.when(F.col("gated").isNotNull(), _kept(F.flatten(F.transform(_hit(F.col("gated")), lambda r: _matches(F.col("gated"), r)))))
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: _has_base(F.col("words"), i))
    rows = rows.select("doc_id", "n_words", "words", found.alias("found"), F.when(F.size("words") > 0, places).alias("places"))
    base = F.array_distinct(F.transform("places", lambda i: reduce(lambda e, p: F.when(_is(F.col("words"), i, p[0]), p[1]).otherwise(e), PHRASES, F.lit(None).cast("string"))))
    none = F.array().cast("array<struct<start:int,stop:int,label:string,rule:int,confidence:double>>")
    seen = F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["label"].alias("label"), x["rule"].alias("rule"), x["confidence"].alias("confidence")))
    return rows.select("doc_id", "n_words", F.coalesce(seen, none).alias("detections"), F.coalesce("places", F.array().cast("array<int>")).alias("places"), F.coalesce(base, F.array().cast("array<string>")).alias("base"))


def summary(scanned: DataFrame) -> DataFrame:
    """The digest columns of a scan."""
    some = F.size("places") > 0
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.when(some, F.array_min("places")).cast("long").alias("first_word"),
        F.when(some, F.array_max("places")).cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "detections.label")), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max("detections.confidence"), F.lit(0.0)), F.when(some, BASE_SCORE).otherwise(0.0)).alias("score"),
    )
