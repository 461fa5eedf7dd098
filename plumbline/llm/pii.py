"""Personal data: fixed patterns, and identifiers found by contexts that bootstrap from them; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.core import BROADCAST_ROWS, materialize

KINDS = ("email", "ip", "card", "phone", "context")
#: Fixed patterns. Each attempt starts where a run of its characters starts (or where the last match ended), as attempts inside a run fail alike; so long runs cost linear time. A card's digits are counted in the pattern.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What may be an identifier: a token (letters and digits, parted by single or repeated ._/- at most) that holds a digit, of any length, or a run of such with number groups.
_APART = r"(?<![\p{L}\p{N}@.+]|[\p{L}\p{N}][._/-]{1,3})"
_NUMBERS = r"\p{N}++(?:[._/-]++\p{N}++)*+"
_BRACKET = r"\(\p{N}++\)"
_ONE = r"(?=[\p{L}._/-]*+\p{N})[\p{L}\p{N}]++(?:[._/-]++[\p{L}\p{N}]++)*+"
TOKEN = _APART + _ONE + r"(?![\p{L}\p{N}@])"
RUN = rf"{_APART}(?:{_BRACKET}|{_ONE})(?:[\x20._/-]?{_BRACKET}|(?:[\x20._/-]|(?<=\))){_NUMBERS})++(?![\p{{L}}\p{{N}}@])"
#: Entries of an array that are added up one by one; blocks of them are added up in turn, so that a text with very many matches takes little more than linear time.
BLOCK = 256
_SPANS = "array<struct<start:bigint,end:bigint,value:string,pattern:string>>"
_FAR = 1 << 62


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, merge: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each entry of an array of longs what all entries before it come to."""
    start = F.struct(F.lit(zero).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda a, x: F.struct(merge(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    cut = lambda v: F.transform(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(BLOCK)), lambda i: F.slice(v, i, BLOCK))
    within = lambda blocks: F.transform(blocks, lambda b: F.aggregate(b, start, step))
    shifted = lambda x, before: F.transform(x["out"], lambda y: merge(before, y))
    together = lambda each: F.flatten(F.zip_with(each, F.aggregate(each, start, lambda a, x: step(a, x["at"]))["out"], shifted))
    return let(values, lambda v: let(within(cut(v)), together))


def spans(text: Column, pattern: str, may: Column) -> Column:
    """All matches with their places in code points and their lexical patterns, from the matches and what lies between them. may: whether there can be any."""
    gaps = F.split(text, pattern, -1)
    pieces = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), gaps, lambda m, g: F.struct(m.alias("m"), F.length(m).cast("long").alias("size"), F.length(g).cast("long").alias("gap"), _pattern(g).alias("pattern")))

    def place(x: Column, before: Column) -> Column:
        start = before + x["gap"]
        return F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["m"].alias("value"), x["pattern"].alias("pattern"))

    placed = lambda p: F.zip_with(p, running(F.transform(p, lambda x: x["gap"] + x["size"]), lambda a, b: a + b, 0), place)
    return F.when(may, let(F.filter(pieces, lambda x: x["m"].isNotNull()), placed)).otherwise(F.array().cast(_SPANS))


def apart(some: Column, others: Column) -> Column:
    """Those of some spans that meet none of the others, in order: both sorted together, the furthest end of the others before a span and their next
    start behind it tell."""
    row = lambda x, flag: F.struct(x["start"].alias("start"), F.lit(flag).alias("flag"), x["end"].alias("end"), x["value"].alias("value"), x["pattern"].alias("pattern"))
    every = F.array_sort(F.concat(F.transform(others, lambda x: row(x, 0)), F.transform(some, lambda x: row(x, 1))))

    def free(x: Column) -> Column:
        ends = running(F.transform(x, lambda y: F.when(y["flag"] == 0, y["end"]).otherwise(-1)), F.greatest, -1)
        starts = F.reverse(running(F.transform(F.reverse(x), lambda y: F.when(y["flag"] == 0, y["start"]).otherwise(_FAR)), F.least, _FAR))
        near = F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("ended"), s.alias("next")))
        told = F.zip_with(
            x,
            near,
            lambda y, n: F.when((y["flag"] == 1) & (n["ended"] <= y["start"]) & (n["next"] >= y["end"]), F.struct(y["start"].alias("start"), y["end"].alias("end"), y["value"].alias("value"), y["pattern"].alias("pattern"))),
        )
        return F.array_compact(told)

    return F.when((F.size(some) == 0) | (F.size(others) == 0), some).otherwise(let(every, free))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right counts twice, and its digits are added."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        x = digits.substr(n - i + 1, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Of each kind the matches of its fixed pattern that hold."""
    digit = text.rlike("[0-9]")
    ip = F.filter(spans(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda x: F.forall(F.split(x["value"], r"\."), lambda p: p.cast("double") <= 255))
    card = F.filter(spans(text, CARD, digit), lambda x: F.when(F.length(_digits(x["value"])).between(12, 19), _luhn(_digits(x["value"]))).otherwise(F.lit(False)))
    phone = F.filter(spans(text, PHONE, F.contains(text, F.lit("+"))), lambda x: F.length(_digits(x["value"])).between(9, 15))
    return {"email": spans(text, EMAIL, F.contains(text, F.lit("@"))), "ip": ip, "card": card, "phone": phone}


def _pattern(gap: Column) -> Column:
    """The lexical pattern of an entity behind a gap: the word before it, however long, and whether they touch. Empty at a text's start and behind
    another match. The gap is read from its end, so it costs its length once."""
    back = F.reverse(gap)
    word = F.lower(F.reverse(F.regexp_extract(back, r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]*+)", 1)))
    return F.concat(F.when(back.rlike(r"^[\x20\x09-\x0D]"), F.lit("_")).otherwise(F.lit("")), word)


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, tie, base array of (kind, start, end, value, pattern), others array of (start, end, value, pattern)): the fixed matches, and
    identifier-like strings that meet none."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    found = base_spans(text)
    digit = text.rlike(r"\p{N}")
    d = d.select("id", F.xxhash64("text").alias("tie"), *[c.alias(k) for k, c in found.items()], spans(text, RUN, digit).alias("runs"), spans(text, TOKEN, digit).alias("tokens"))
    d = d.withColumn("fixed", F.concat(*found))
    # a run that meets a fixed match gives way to its tokens
    d = d.withColumn("runs", apart(F.col("runs"), F.col("fixed")))
    others = F.concat("runs", apart(F.col("tokens"), F.concat("fixed", "runs")))

    def named(c: str, k: int) -> Column:
        return F.transform(c, lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["pattern"].alias("pattern")))

    return d.select("id", "tie", F.concat(*[named(c, k) for k, c in enumerate(found)]).alias("base"), others.alias("others"))


def occurrences(docs: DataFrame, patterns: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (pattern, occurrences): how often the word of each pattern stands in the texts, whatever follows it (over all documents). A pattern that
    touches its entity is no word of its own and has no row."""
    spaced = materialize(patterns.where(F.startswith("pattern", F.lit("_"))).select("pattern"), "spaced")
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[\x20\x09-\x0D]+")).alias("word")).select(F.concat(F.lit("_"), "word").alias("pattern"))
    if spaced.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return words.join(F.broadcast(spaced), "pattern").groupBy("pattern").agg(F.count("*").alias("occurrences"))
    return words.groupBy("pattern").agg(F.count("*").alias("occurrences")).join(spaced, "pattern")


def confident_patterns(found: DataFrame, docs: DataFrame, text_col: str = "text", rounds: int = 3, least_seeds: int = 3, confidence: float = 0.5, prior: float = 2.0) -> DataFrame:
    """Rows (pattern, score) of the patterns that are sure enough.

    A bipartite graph joins each pattern to the instances (values) it was seen with. Instances that a fixed pattern found are sure (1), and others
    count as soon as patterns say so. In each round a pattern with at least least_seeds different instances of a score of at least confidence scores
    the sum of its instances' scores over the number of times that its word occurs at all (and prior more), so a frequent word that happens to precede
    an entity now and then has none; other patterns score 0, as yet. An instance's score is the chance that not all its patterns are wrong, less as it
    stands more than prior times elsewhere than behind patterns that score at least confidence, so a common number that stood behind a sure pattern
    once makes no others sure. So identifiers found in one round make new patterns sure in the next. Scores pass to and fro rounds times, each round a
    table in the shared folder. Patterns with fewer than least_seeds different instances of any kind can never score and are left out. Sums are
    partial before each exchange, so one pattern in a third of all rows is no burden."""
    seeds = found.select(F.explode("base").alias("x")).select("x.pattern", "x.value", F.lit(1).alias("seed"))
    rest = found.select(F.explode("others").alias("x")).select("x.pattern", "x.value", F.lit(0).alias("seed"))
    every = materialize(seeds.unionByName(rest).groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.count("*").alias("times")), "every")
    graph = every.where("pattern <> '' and pattern <> '_'")
    known = graph.groupBy("pattern").agg(F.count("*").alias("instances"), F.sum("times").alias("seen")).where(F.col("instances") >= least_seeds)
    known = materialize(known, "known")
    total = known.join(materialize(occurrences(docs, known, text_col), "occurrences"), "pattern", "left").select("pattern", F.greatest("seen", F.coalesce("occurrences", F.lit(0))).alias("total"))
    stands = every.groupBy("value").agg(F.sum("times").alias("stands"), F.max("seed").alias("fixed"))
    graph = materialize(graph.select("pattern", "value", "times").join(total, "pattern").join(stands, "value"), "graph")
    values = graph.groupBy("value").agg(F.max("fixed").cast("double").alias("score"))
    patterns = None
    for _ in range(rounds):
        scored = graph.join(values, "value")
        ready = F.count(F.when(F.col("score") >= confidence, 1)) >= least_seeds
        patterns = materialize(scored.groupBy("pattern").agg(F.when(ready, F.sum(F.col("score") * F.col("times")) / (F.max("total") + prior)).otherwise(0.0).alias("score")), "patterns")
        chance = F.exp(F.sum(F.log(1 - F.least(F.col("score"), F.lit(0.999)))))
        sure = F.sum(F.when(F.col("score") >= confidence, F.col("times")).otherwise(0))
        share = F.least(F.lit(1.0), (sure + prior) / F.max("stands"))
        values = materialize(graph.join(patterns, "pattern").groupBy("value").agg(F.when(F.max("fixed") == 1, 1.0).otherwise((1 - chance) * share).alias("score")), "values")
    return patterns.where(F.col("score") >= confidence).select("pattern", "score")


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """One row per row of docs: id, n_email, n_ip, n_card, n_phone, n_context, n_spans (of all kinds), base_sha256, spans (kind:start:end by start,
    comma-joined, code points, end exclusive).

    context spans are identifier-like strings behind a confident pattern (see confident_patterns, to which options go). Null texts are empty and have
    no spans; rows that repeat id and text share their result; null ids are kept; extra columns are left out; an empty table gives no rows."""
    found = materialize(extract(docs, id_col, text_col), "personal")
    sure = confident_patterns(found, docs, text_col, **options)
    seen = found.select("id", "tie", F.explode("others").alias("x")).select("id", "tie", "x.start", "x.end", "x.pattern")
    new = seen.join(sure, "pattern").groupBy("id", "tie").agg(F.collect_set(F.struct("start", F.lit(4).alias("kind"), "end")).alias("new"))
    new = new.select(F.col("id").alias("id_"), F.col("tie").alias("tie_"), "new")
    f = found.join(new, found["id"].eqNullSafe(new["id_"]) & (found["tie"] == new["tie_"]), "left").withColumn("new", F.coalesce("new", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))
    base = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {i})) as bigint)").alias(f"n_{kind}") for i, kind in enumerate(KINDS[:4])]
    return f.select(
        F.col("id").alias(id_col),
        *counts,
        F.size("new").cast("long").alias("n_context"),
        (F.size("base") + F.size("new")).cast("long").alias("n_spans"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat(base, F.col("new"))).alias("spans"),
    )
