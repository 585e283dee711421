"""Personal data by bootstrapped contextual extraction.

Seeds are what the base patterns find (e-mail, IP, card, phone): every valid
span, with its own context.  The words around a span form lexical patterns.
A pattern counts once it has enough different seeds of one kind.  Whatever
else stands in the slot of such a pattern is an unknown token, with or without
digits.  Patterns and tokens form a graph, and Spark scores it in rounds until
nothing crosses a threshold: a pattern by the share of its tokens that are of
a kind, an unknown token by the mean of its patterns.  Patterns of high
confidence then mark unknown tokens.  Everything is DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import match_spans, stored

KINDS = ("email", "ip", "card", "phone")
#: The contract's base patterns.  Each may only start where a run starts (or the last match ended) and never gives
#: characters back, which changes no match but keeps long runs linear; possessive groups are loops, not recursion.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a kind needs somewhere in the text; a cheap first look.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Unknown tokens of several words: phone numbers and spaced cards that do not count.
LONG = BASE["phone"] + r"|(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9])"
#: Other unknown tokens, inside a word: a run of INNER up to its last letter or digit, with what brackets or an apostrophe join to it.
ALNUM = r"a-zA-Z0-9\p{L}\p{M}\p{N}"  # the plain ones first, as they are found first
INNER = ALNUM + r"._%+@#/-"
UNIT = (rf"(?<![{INNER}])[{INNER}]*[{ALNUM}]"
        rf"(?:[(\[{{][{INNER}]*[{ALNUM}][)\]}}](?:[{INNER}]*[{ALNUM}])?|['’][{INNER}]*[{ALNUM}])*+")
WORD = r"\S+"
#: Up to so many patterns, or rows with a mark, go to every task as 64-bit numbers, 8 bytes each, so that no word outside their slots and no text is shuffled.
BROADCAST_PATTERNS = 2_000_000
#: Marks go to every task while their tokens and patterns have so many bytes, so that no unknown token is shuffled for them.
BROADCAST_BYTES = 16 << 20
#: Rounds of scoring at most; share of a kind that a pattern needs, different seeds it needs, and score that a token needs.
ROUNDS, PATTERN_SCORE, PATTERN_SEEDS, TOKEN_SCORE = 30, 0.9, 5, 0.9


def _digits(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    def add(total, i):
        v = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(v > 9, v - 9).otherwise(v)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, token: Column) -> Column:
    """Whether a match of the kind's base pattern counts."""
    if kind == "ip":
        return token.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$")
    if kind == "card":
        n = F.length(_digits(token))
        return F.when(n.between(13, 19), luhn(_digits(token))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(token)).between(9, 15)
    return F.lit(True)


def _may(text: Column, kind: str) -> Column:
    may = text.contains(NEEDS[kind]) if NEEDS[kind] else F.lit(True)
    return may if kind == "email" else may & text.rlike("[0-9]")


def _borders(spans: Column) -> Column:
    return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))


def base_spans(text: Column, kind: str) -> Column:
    """Array of (start, end): the kind's leftmost, non-overlapping matches that count."""
    found = _borders(F.filter(match_spans(text, BASE[kind]), lambda m: valid(kind, m["token"])))
    return F.when(_may(text, kind), found).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def _patterns(before: Column, near: Column, after: Column) -> Column:
    """The patterns of a slot, null where a side is empty: the two words to its left, and the words on both sides."""
    return F.array(F.when((before != "") & (near != ""), F.concat(F.lit("L "), F.lower(F.concat(before, F.lit(" "), near)))),
                   F.when((near != "") & (after != ""), F.concat(F.lit("B "), F.lower(F.concat(near, F.lit(" _ "), after)))))


def _joined(left: Column) -> Column:
    """What is joined to a slot's left without white space, from the last INNER run on."""
    return F.regexp_extract(left, rf"(?:(?<![{INNER}])[{INNER}]++|(?<!\S))[^\s{INNER}]++\z|(?<![{INNER}])[{INNER}]++\z", 0)


def _joined_after(right: Column) -> Column:
    """What is joined to a slot's right without white space, up to the next letter or digit."""
    return F.regexp_extract(right, rf"^[^\s{ALNUM}]+", 0)


def _around(left: Column, right: Column) -> Column:
    """Patterns of a slot from the text on its sides."""
    joined = left.rlike(r"\S\z")
    near = F.when(joined, _joined(left)).otherwise(F.regexp_extract(left, r"(?<!\S)(\S++)\s++\z", 1))
    before = F.regexp_extract(left, r"(?<!\S)(\S++)\s++\S++\s*+\z", 1)
    after = F.when(right.rlike(r"^\S"), _joined_after(right)).otherwise(F.regexp_extract(right, r"^\s+(\S+)", 1))
    return F.filter(_patterns(before, near, after), lambda p: p.isNotNull())


INSTANCES = "array<struct<start:bigint,end:bigint,token:string,kind:string,patterns:array<string>>>"


def _instances(text: Column, base: str) -> Column:
    """Array of (start, end, token, kind, patterns): the valid base spans, and with null for a kind the LONG tokens clear of them."""
    def of(kind):
        return lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["token"].alias("token"),
                                  F.lit(kind).cast("string").alias("kind"), _around(m["left"], m["right"]).alias("patterns"))

    def seeds(kind):
        found = F.filter(match_spans(text, BASE[kind], around=True), lambda m: valid(kind, m["token"]))
        return F.when(F.size(f"{base}.{kind}") > 0, F.transform(found, of(kind))).otherwise(none)

    none = F.array().cast(INSTANCES)
    every = F.concat(*[F.col(f"{base}.{k}") for k in KINDS])
    other = F.filter(match_spans(text, LONG, around=True), lambda m: ~F.exists(every, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return F.concat(*map(seeds, KINDS), F.when(text.rlike("[0-9]"), F.transform(other, of(None))).otherwise(none))


def _near_seeded(said: DataFrame, seeded: DataFrame, also: Column) -> DataFrame:
    """The rows of `said` that meet a condition and, while patterns are few enough for every task, have the near word of one of `seeded`."""
    if seeded.count() > BROADCAST_PATTERNS:
        return said.where(also)
    near = F.when(F.col("pattern").startswith("L "), F.substring_index("pattern", " ", -1)).otherwise(
        F.substring_index(F.expr("substr(pattern, 3)"), " ", 1))
    nears = seeded.groupBy(F.xxhash64(near).alias("number")).agg(F.count("*").alias("met"))
    met = said.withColumn("number", F.xxhash64(F.lower("near"))).join(F.broadcast(nears), "number")
    return met.where(F.when(F.col("met") > 0, also)).drop("number", "met")  # the cheaper look first


def _units(rows: DataFrame, seeded: DataFrame | None = None) -> DataFrame:
    """(row, word, start, end, token, pattern) of the texts' UNITs, with `seeded` at least of those in the slots of its patterns.

    word is the number of the word, start and end are places inside it; the words around are whole.  A word that begins with
    its only unit, as nearly all do, needs no search for units, and only if the word before it is a near word.
    """
    words = F.col("w")
    zipped = F.arrays_zip(F.concat(F.array(F.lit(""), F.lit("")), words).alias("before"), F.concat(F.array(F.lit("")), words).alias("near"),
                          words.alias("text"), F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))).alias("after"))
    text = F.col("text")

    def said(rows):
        words = rows.select("row", F.regexp_extract_all("text", F.lit(WORD), 0).alias("w"))
        return words.select("row", F.posexplode(zipped).alias("word", "x")).select("row", "word", "x.*").where(text.isNotNull())

    some, headed = text.rlike(rf"[{ALNUM}]"), text.rlike(rf"^[{INNER}]++[^{ALNUM}]*+\z")
    one = said(rows).where(some & headed) if seeded is None else _near_seeded(said(rows), seeded, some & headed)
    right = F.when(text.rlike(rf"[{ALNUM}]\z"), F.lit("")).otherwise(F.regexp_extract(text, rf"(?<=[{ALNUM}])[^{ALNUM}]++\z", 0))
    one = one.withColumn("right", right).withColumn("end", (F.length("text") - F.length("right")).cast("long"))
    one = one.select("row", "word", F.lit(0).cast("long").alias("start"), "end", F.left("text", F.col("end").cast("int")).alias("token"),
                     "before", "near", F.when(F.col("right") != "", F.col("right")).otherwise(F.coalesce("after", F.lit(""))).alias("after"))
    others = rows.where(text.rlike(rf"(?<!\S)[{INNER}]*+[^\s{INNER}]\S*?[{ALNUM}]"))  # texts with a word of another build
    more = said(others).where(some & ~headed).select("row", "word", "before", "near", "after", F.inline(match_spans(text, UNIT, around=True)))
    joined = F.col("left") != ""
    near = F.when(joined, _joined(F.col("left"))).otherwise(F.col("near"))
    before = F.when(joined, F.col("near")).otherwise(F.col("before"))
    after = F.when(F.col("right") != "", _joined_after(F.col("right"))).otherwise(F.coalesce("after", F.lit("")))
    more = more.select("row", "word", "start", "end", "token", before.alias("before"), near.alias("near"), after.alias("after"))
    slots = _patterns(F.col("before"), F.col("near"), F.col("after"))
    both = one.unionByName(more)
    return both.select("row", "word", "start", "end", "token", F.explode(slots).alias("pattern")).where("pattern IS NOT NULL")


def _word_starts(text: Column) -> Column:
    """Array of where each word of a text starts."""
    return F.transform(match_spans(text, WORD), lambda m: m["start"])


def _in_slots(said: DataFrame, seeded: DataFrame) -> DataFrame:
    """The rows of `said` (one per pattern) whose pattern is one of `seeded`.

    The patterns' numbers pick the rows first, from every task's own copy while
    the patterns are few enough, else by a join; equal patterns decide.
    """
    numbers = seeded.select(F.xxhash64("pattern").alias("number")).distinct()
    if seeded.count() <= BROADCAST_PATTERNS:
        numbers = F.broadcast(numbers)
    maybe = said.withColumn("number", F.xxhash64("pattern")).join(numbers, "number", "left_semi").drop("number")
    return stored(maybe, "maybe").join(seeded.select("pattern"), "pattern", "left_semi")


def seeded_patterns(seeds: DataFrame, pattern_seeds: int = PATTERN_SEEDS) -> DataFrame:
    """(pattern, seeds, n_<kind>): counts of the different seed tokens of each pattern with `pattern_seeds` of one kind.

    seeds: (token, pattern, kind), repeats allowed.  Other patterns could never mark a token, and stay out of the graph.
    """
    seeds = seeds.select("token", "pattern", "kind").distinct()
    counts = seeds.groupBy("pattern").agg(F.count("*").alias("seeds"), *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS])
    return stored(counts.where(F.greatest(*[F.col(f"n_{k}") for k in KINDS]) >= pattern_seeds), "patterns")


def able_patterns(seeded: DataFrame, pattern_score: float = PATTERN_SCORE, token_score: float = TOKEN_SCORE, **_) -> DataFrame:
    """`seeded`, or none of them while no kind makes up enough of the seeds of any.

    A pattern's score is the mean of its seeds (1 or 0 for a kind) and of its unknown tokens, a token's the mean of its patterns.
    So no score of a kind, in any round, is above the largest share that the kind has in the seeds of one pattern, and with all
    shares below a threshold `bootstrap` marks nothing, whatever stands in the slots.  One able pattern keeps them all, as
    patterns that share tokens with it count in its tokens' means.
    """
    most = F.greatest(*[F.col(f"n_{k}") for k in KINDS]) / F.col("seeds")
    able = seeded.where(most >= max(pattern_score, token_score) - 1e-6)  # sums of fractions may be off by so much
    return seeded.limit(0) if able.isEmpty() else seeded


def bootstrap(seeds: DataFrame, unknown: DataFrame, rounds: int = ROUNDS, pattern_score: float = PATTERN_SCORE,
              pattern_seeds: int = PATTERN_SEEDS, token_score: float = TOKEN_SCORE) -> DataFrame:
    """(token, pattern, kind): unknown tokens and the patterns that mark them as a kind.

    seeds: from `seeded_patterns`; unknown: (token, pattern) of tokens in the slots of those, repeats allowed.
    Edges count once, so copies of a text give no evidence, and hot patterns are combined before shuffling.
    Rounds end with the first in which no pattern and no token crosses its threshold, at the latest after `rounds`.
    """
    unknown = stored(unknown.select("token", "pattern").distinct(), "graph")
    seeds = seeds.join(unknown.groupBy("pattern").agg(F.count("*").alias("others")), "pattern", "left")
    seeds = stored(seeds.withColumn("tokens", F.col("seeds") + F.coalesce("others", F.lit(0))), "patterns")

    def sure(prefix, needed, also):
        """The kinds that are over a threshold."""
        return F.array_compact(F.array(*[F.when((F.col(f"{prefix}_{k}") >= needed) & also(k), F.lit(k)) for k in KINDS]))

    enough = lambda k: F.col(f"n_{k}") >= pattern_seeds
    none = F.array().cast("array<string>")
    score = seeds.select("pattern", *[(F.col(f"n_{k}") / F.col("tokens")).alias(f"s_{k}") for k in KINDS], none.alias("over"), F.lit(True).alias("crossed"))
    token = unknown.select("token", none.alias("over")).distinct()
    for _ in range(rounds):
        means = unknown.join(score, "pattern").groupBy("token").agg(*[F.avg(f"s_{k}").alias(f"t_{k}") for k in KINDS])
        over = sure("t", token_score, lambda k: F.lit(True))
        token = stored(means.join(token.select("token", F.col("over").alias("was")), "token").select(
            "token", *[f"t_{k}" for k in KINDS], over.alias("over"), (over != F.col("was")).alias("crossed")), "tokens")
        gained = unknown.join(token, "token").groupBy("pattern").agg(*[F.sum(f"t_{k}").alias(f"g_{k}") for k in KINDS])
        shares = seeds.join(gained, "pattern", "left").select("pattern", *[f"n_{k}" for k in KINDS], *[
            ((F.col(f"n_{k}") + F.coalesce(f"g_{k}", F.lit(0.0))) / F.col("tokens")).alias(f"s_{k}") for k in KINDS])
        over = sure("s", pattern_score, enough)
        score = stored(shares.join(score.select("pattern", F.col("over").alias("was")), "pattern").select(
            "pattern", *[f"s_{k}" for k in KINDS], over.alias("over"), (over != F.col("was")).alias("crossed")), "scores")
        if score.where("crossed").unionByName(token.where("crossed"), allowMissingColumns=True).isEmpty():
            break
    # A pattern marks as the first kind, in the order of KINDS, that it is sure of.
    patterns = score.where("size(over) > 0").select("pattern", F.get("over", F.lit(0)).alias("kind"))
    marks = unknown.join(patterns, "pattern").join(token.select("token", "over"), "token")
    return marks.where(F.array_contains("over", F.col("kind"))).select("token", "pattern", "kind")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Rows (doc_id, base, found), one per document.

    base and found: a struct with an array of (start, end) for each kind;
    found also holds what the bootstrap adds, which never overlaps a base span.
    Positions are code points, ends exclusive.  A null text counts as empty;
    repeated rows and null identifiers are rows like others; empty input gives
    an empty result.  Whole texts are read, once, and stored for the later steps.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.struct(*[base_spans(text, k).alias(k) for k in KINDS]).alias("base"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "pii")
    # Texts with instances take the places of their words along: what overlaps an instance is no unknown token.
    spans = rows.select("row", "text", _instances(F.col("text"), "base").alias("instances")).where("size(instances) > 0")
    spans = stored(spans.select("row", "instances", _word_starts(F.col("text")).alias("starts")), "spans")
    listed = spans.select("row", F.inline("instances")).select("row", "start", "end", "token", "kind", F.explode("patterns").alias("pattern"))
    seeded = able_patterns(seeded_patterns(listed.where("kind IS NOT NULL"), settings.get("pattern_seeds", PATTERN_SEEDS)), **settings)
    taken = spans.select("row", "starts", _borders(F.col("instances")).alias("taken"))
    said = _in_slots(_units(rows, seeded), seeded).join(taken, "row", "left").withColumn("at", F.get("starts", F.col("word"))).where(
        "taken IS NULL OR NOT exists(taken, b -> b.start < at + end AND at + start < b.end)")
    word = F.lit(None).cast("int").alias("word")  # instances have their places in the text already
    columns = ["row", "word", "start", "end", "token", "pattern"]
    said = stored(said.select(columns).unionByName(
        listed.where("kind IS NULL").join(seeded.select("pattern"), "pattern", "left_semi").select("row", word, "start", "end", "token", "pattern")), "said")
    marks = stored(bootstrap(seeded, said.select("token", "pattern"), **settings), "marks")
    if (marks.agg(F.sum(F.octet_length("token") + F.octet_length("pattern"))).first()[0] or 0) <= BROADCAST_BYTES:
        marks = F.broadcast(marks)
    marked = stored(said.join(marks, ["token", "pattern"]).select("row", "word", "start", "end", "kind").distinct(), "marked")
    held = stored(marked.where("word IS NOT NULL").select("row").distinct(), "held")
    if held.count() <= BROADCAST_PATTERNS:
        held = F.broadcast(held)
    starts = rows.join(held, "row", "left_semi").select("row", _word_starts(F.col("text")).alias("starts"))
    at = F.coalesce(F.get("starts", F.col("word")), F.lit(0).cast("long"))
    added = (marked.join(starts, "row", "left").groupBy("row", "kind").agg(
        F.collect_set(F.struct((at + F.col("start")).alias("start"), (at + F.col("end")).alias("end"))).alias("spans")))  # of one document and kind
    added = added.groupBy("row").agg(*[F.first(F.when(F.col("kind") == k, F.col("spans")), ignorenulls=True).alias(f"a_{k}") for k in KINDS])
    out = rows.select("row", "doc_id", "base").join(added, "row", "left")
    every = F.concat(*[F.col(f"base.{k}") for k in KINDS])

    def merged(k):
        extra = F.coalesce(F.col(f"a_{k}"), F.array().cast("array<struct<start:bigint,end:bigint>>"))
        free = F.filter(extra, lambda a: ~F.exists(every, lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])))
        return F.when(F.size(extra) > 0, F.array_sort(F.concat(F.col(f"base.{k}"), free))).otherwise(F.col(f"base.{k}"))

    return out.select("doc_id", "base", F.struct(*[merged(k).alias(k) for k in KINDS]).alias("found"))


def joined_spans(spans: str) -> Column:
    """kind:start:end of a struct column of `find_pii`, by kind as listed, then start, comma-joined."""
    def of(kind):
        return F.transform(F.col(f"{spans}.{kind}"),
                           lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(F.concat(*map(of, KINDS)), ",")
