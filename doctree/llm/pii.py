"""Personal data: pattern matches seed a graph of contexts and identifiers, whose sure contexts find more identifiers.

All of it is DataFrame functions. Expressions are possessive where that changes no match, so that each scan takes
time in proportion to the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import cut, fresh, let, pieces_of, running

KINDS = ("email", "ip", "card", "phone")
#: What each kind looks like. A run that is too long for a card is no match at all, so its parts are none either.
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"
#: An identifier of no known kind: two to eight groups of digits with spaces, brackets, dots or hyphens between them, no more on
#: either side, or else a run without spaces or quotes that holds a digit or an at sign.
_GROUPS = r"""(?<![^\s=:"'<>,;|])(?<![0-9][ ().-])(?<![0-9][ ().-]{2})[+(]?[0-9]{1,19}+(?:[ ().-]{1,2}+[0-9]{1,19}+){1,7}+(?![ ().-]{0,2}[0-9])(?![\p{L}@_/%-])"""
_LOOSE = _GROUPS + r"""|(?<![^\s=:"'<>,;|])[^\s=:"'<>,;|0-9@]*+[0-9@][^\s=:"'<>,;|]*+"""
_CONTEXT = 64
_ONE = r"(\p{L}+)[^\p{L}\s]*\s*$"
_TWO = r"(\p{L}+[^\p{L}]{1,8}\p{L}+)[^\p{L}\s]*\s*$"
_AFTER = r"^[^\p{L}]*(\p{L}+)"
#: Distinct seeds that a context needs before it counts, the least confidence to pass on a score, and to find by.
LEAST_SEEDS = 3
PASS_ON = 0.3
SURE = 0.8
ROUNDS = 4
#: What an identifier that may or may not be of a kind counts against a context, next to one that is not.
UNSURE = 0.2


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))
    twice = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    figures = F.transform(F.filter(F.split(digits, ""), lambda x: x != ""), lambda x, i: twice(x.cast("int"), i))
    return F.aggregate(figures, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_IP)
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _validity(kind: str) -> Callable[[Column], Column]:
    return lambda x: _valid(kind, x["value"])


def _fits(kind: str, value: Column) -> Column:
    """What an identifier that no pattern knows must look like to be of a kind."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    letters = value.rlike(r"\p{L}")
    if kind == "email":
        return letters & value.contains("@")
    if kind == "ip":
        return ~letters & value.rlike(r"^[^ ]*[0-9]\.[0-9][^ ]*$") & (digits >= 6)
    if kind == "card":
        return ~letters & digits.between(12, 20)
    return ~letters & digits.between(7, 16)


def _places(ends: Column, pieces: Column, matches: Column, kind: Column) -> Column:
    """(kind, start, end, value, one, two, after) of matches from the pieces between them, one more than these, and the running ends."""
    before = lambda i: F.right(F.get(pieces, i), F.lit(_CONTEXT))
    return F.transform(
        matches,
        lambda m, i: F.struct(
            kind.alias("kind"),
            (F.get(ends, i) - F.length(m)).alias("start"),
            F.get(ends, i).alias("end"),
            m.alias("value"),
            F.lower(F.regexp_extract(before(i), _ONE, 1)).alias("one"),
            F.lower(F.regexp_replace(F.regexp_extract(before(i), _TWO, 1), r"[^\p{L}]+", " ")).alias("two"),
            F.lower(F.regexp_extract(F.left(F.get(pieces, i + 1), F.lit(_CONTEXT)), _AFTER, 1)).alias("after"),
        ),
    )


def _hint(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    return {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))


def _scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, base, loose): matches of the patterns by kind and start, and other identifiers."""
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<string>")
    named = {**_PATTERNS, "loose": _LOOSE}
    out = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), text.alias("_t"))
    cheap = {k: _hint(k, F.col("_t")) if k != "loose" else F.col("_t").rlike("[0-9@]") for k in named}
    out = out.withColumns({f"_m_{k}": F.when(cheap[k], F.regexp_extract_all("_t", F.lit(rx), F.lit(0))).otherwise(none) for k, rx in named.items()})
    out = out.withColumns({f"_p_{k}": F.when(F.size(f"_m_{k}") > 0, F.split("_t", rx, -1)).otherwise(none) for k, rx in named.items()})
    widths = lambda k: F.transform(F.arrays_zip(F.col(f"_m_{k}").alias("m"), F.slice(f"_p_{k}", F.lit(1), F.size(f"_m_{k}")).alias("p")), lambda x: F.length(x["m"]) + F.length(x["p"]))
    out = out.withColumns({f"_e_{k}": let(widths(k), lambda w: running(w, lambda x, y: x + y)) for k in named})
    kinds = {}
    for i, k in enumerate((*KINDS, "loose")):
        found = _places(*(F.col(f"_{c}_{k}") for c in "epm"), F.lit(i if k in KINDS else None).cast("int"))
        kinds[f"_f_{k}"] = F.filter(found, _validity(k)) if k in KINDS else found
    out = out.select("doc_id", "text_key", *[v.alias(k) for k, v in kinds.items()])
    out = out.select("doc_id", "text_key", F.concat(*[f"_f_{k}" for k in KINDS]).alias("base"), F.col("_f_loose").alias("_loose"))
    # A loose identifier ends before closing punctuation, is no part of a match, and fits some kind.
    ending = lambda x: F.regexp_replace(x["value"], r"(?<![.!?)\]])[.!?)\]]++$", "")
    cut_off = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), (x["start"] + F.length(ending(x))).alias("end"), ending(x).alias("value"), x["one"].alias("one"), x["two"].alias("two"), x["after"].alias("after"))
    shaped = lambda x: _fits("email", x["value"]) | _fits("ip", x["value"]) | _fits("card", x["value"]) | _fits("phone", x["value"])
    return _apart(out.withColumn("_loose", F.filter(F.transform("_loose", cut_off), shaped)))


def _apart(found: DataFrame) -> DataFrame:
    """(doc_id, text_key, base, loose) with the _loose spans that no base span overlaps.

    Starts of base spans and ends of loose ones are put in order once; a loose span that ends there is apart if no
    base span that starts before has ended later than it starts.
    """
    none = F.lit(-1)
    event = lambda at, rank, end, j: F.struct(at.alias("at"), rank.alias("rank"), end.alias("end"), j.alias("j"))
    starts = F.transform("base", lambda b: event(b["start"], F.lit(1), b["end"], none))
    ends = F.transform("_loose", lambda x, j: event(x["end"], F.lit(0), none, j))
    some = F.sort_array(F.concat(starts, ends))

    def kept(events, reach, loose):
        placed = F.transform(events, lambda e, i: F.struct(e["j"].alias("j"), F.get(reach, i).alias("reach")))
        clear = F.filter(placed, lambda e: (e["j"] >= 0) & (e["reach"] <= F.get(loose, e["j"])["start"]))
        return F.transform(clear, lambda e: F.get(loose, e["j"]))

    # What a lambda looks up is bound first: a column named once in it would be worked out for each element.
    apart = let(some, lambda events: let(running(F.transform(events, lambda e: e["end"]), F.greatest), lambda reach: let(F.col("_loose"), lambda loose: kept(events, reach, loose))))
    return found.select("doc_id", "text_key", "base", F.when((F.size("_loose") > 0) & (F.size("base") > 0), apart).otherwise(F.col("_loose")).alias("loose"))


def _contexts(x: Column | str) -> Column:
    """The word before, the two words before, the word after, and the words on both sides."""
    x = F.col(x) if isinstance(x, str) else x
    some = {"1:": x["one"], "2:": x["two"], "3:": x["after"]}
    around = F.when((x["one"] != "") & (x["after"] != ""), F.concat(F.lit("4:"), x["one"], F.lit(" "), x["after"]))
    return F.filter(F.array(*[F.when(c != "", F.concat(F.lit(k), c)) for k, c in some.items()], around), lambda c: c.isNotNull())


def _possible(value: Column) -> Column:
    """The kinds that an identifier may be of."""
    return F.filter(F.array(*[F.when(_fits(k, value), F.lit(i)) for i, k in enumerate(KINDS)]), lambda k: k.isNotNull())


def _confidence(scores: DataFrame, sizes: DataFrame) -> DataFrame:
    """(context, kind, confidence) from (context, kind, value, score, seed): see discover."""
    held = scores.groupBy("context", "kind").agg(F.sum("score").alias("held"), F.sum(F.col("seed").cast("int")).alias("seeds"), F.sum((~F.col("seed")).cast("int") - F.when(F.col("seed"), 0.0).otherwise(F.col("score"))).alias("open"))
    held = held.filter(F.col("seeds") >= LEAST_SEEDS)
    # What is not of this kind for certain: the seeds of others, and identifiers that do not fit.
    against = F.col("instances") - F.col("seeds") - F.col("fitting") + UNSURE * F.col("open")
    out = held.join(sizes, ["context", "kind"]).select("context", "kind", (F.col("held") / (F.col("held") + against + 1)).alias("confidence"))
    return out.filter(F.col("confidence") >= PASS_ON)


def discover(scanned: DataFrame) -> DataFrame:
    """(doc_id, text_key, added): identifiers found by sure contexts, as (kind, start, end) by kind and start.

    The graph has an edge for each distinct pair of a context (the word before, the two words before, the word after, the
    words on both sides) and an identifier. Matches of the patterns score 1 for their kind. In each round a
    context's confidence is held / (held + against + 1), given LEAST_SEEDS seeds: held is the sum of its
    identifiers' scores, against the number of those that are of another kind or fit it by no means, and UNSURE
    of what those that fit lack to a score of 1. An identifier's score is the chance that not all of its
    contexts err. A context that ends with a confidence of SURE marks every identifier beside it that fits the kind;
    one that several kinds claim goes to the surest.
    """
    seeds = scanned.select(F.explode("base").alias("x")).select(F.explode(_contexts("x")).alias("context"), "x.kind", "x.value").distinct().withColumns({"score": F.lit(1.0), "seed": F.lit(True)})
    loose = scanned.select(F.explode("loose").alias("x")).select(F.explode(_contexts("x")).alias("context"), "x.value").distinct()
    seeds, loose = cut(seeds), cut(loose)
    seeded = cut(seeds.groupBy("context", "kind").agg(F.count("*").alias("n")))
    counted = seeded.select("context", "n").unionAll(loose.groupBy("context").agg(F.count("*").alias("n"))).groupBy("context").agg(F.sum("n").alias("instances"))
    strong = seeded.filter(F.col("n") >= LEAST_SEEDS).select("context", "kind")
    wanted = cut(loose.join(strong.select("context").distinct(), "context").withColumn("kind", F.explode(_possible(F.col("value")))).join(strong, ["context", "kind"]).withColumns({"score": F.lit(0.0), "seed": F.lit(False)}))
    fitting = wanted.groupBy("context", "kind").agg(F.count("*").alias("fitting"))
    sizes = cut(strong.join(counted, "context").join(fitting, ["context", "kind"], "left").select("context", "kind", "instances", F.coalesce("fitting", F.lit(0)).alias("fitting")))
    sure = _confidence(seeds.unionByName(wanted), sizes)
    for _ in range(ROUNDS - 1):
        doubt = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6))))
        scored = wanted.join(sure, ["context", "kind"]).groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("_score"))
        passed = wanted.join(scored, ["value", "kind"], "left").select("context", "kind", "value", F.coalesce("_score", "score").alias("score"), "seed")
        sure = cut(_confidence(seeds.unionByName(passed), sizes))
    sure = sure.filter(F.col("confidence") >= SURE)
    places = (
        scanned.select("doc_id", "text_key", F.explode("loose").alias("x"))
        .select("doc_id", "text_key", "x.start", "x.end", _possible(F.col("x.value")).alias("kinds"), F.explode(_contexts("x")).alias("context"))
        .select("doc_id", "text_key", "start", "end", "context", F.explode("kinds").alias("kind"))
    )
    best = places.join(sure, ["context", "kind"]).groupBy("doc_id", "text_key", "start", "end").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("best"))
    return best.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct((-F.col("best.k")).alias("kind"), "start", "end"))).alias("added"))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, base, spans) for each row of docs: (kind, start, end) by kind and start, in code points.

    kind counts KINDS from 0. base holds what the patterns match, spans the identifiers that contexts find too.
    Null and empty texts have none; equal rows get equal results and count once as evidence; a null doc_id is
    treated like any other; further columns play no part.
    """
    scanned = cut(_scanned(docs.select("doc_id", "text")))
    added = discover(scanned).withColumnRenamed("doc_id", "_id").withColumnRenamed("text_key", "_key")
    plain = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    both = scanned.select("doc_id", "text_key", plain.alias("base")).join(added, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "added")))
    return both.select("doc_id", "text_key", "base", spans.alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """docs with each span of `find` replaced by its kind in angle brackets; overlapping spans become one, named after the first.

    Columns and rows stay; texts without spans, null ones too, are as they were.
    """
    i, k, at = fresh(docs, "_id"), fresh(docs, "_key"), fresh(docs, "_spans")
    spans = F.sort_array(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    found = find(docs.select("doc_id", "text")).filter(F.size("spans") > 0).select(F.col("doc_id").alias(i), F.col("text_key").alias(k), spans.alias(at)).distinct()
    joined = docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(k)), "left")
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def over(spans, reach):
        # Spans that start where none before reaches open a piece of their own; it ends as far as those up to the next reach.
        placed = F.transform(spans, lambda x, j: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), j.alias("j"), F.get(reach, j - 1).alias("before")))
        return let(F.filter(placed, lambda x: x["before"].isNull() | (x["start"] >= x["before"])), lambda opens: pieces(opens, reach))

    def pieces(opens, reach):
        # The last span of each piece stands before the next piece's first.
        ends = F.transform(opens, lambda x, i: F.get(reach, F.coalesce(F.get(opens, i + 1)["j"], F.size(reach)) - 1))
        labels = F.transform(opens, lambda x: F.element_at(names, x["kind"] + 1))
        return pieces_of(F.col("text"), F.concat(F.array(F.lit(0)), ends), F.concat(F.transform(opens, lambda x: x["start"]), F.array(F.length("text"))), labels)

    masked = let(F.col(at), lambda spans: let(running(F.transform(spans, lambda x: x["end"]), F.greatest), lambda reach: over(spans, reach)))
    return joined.withColumn("text", F.when(F.col(at).isNull(), F.col("text")).otherwise(masked)).select(*docs.columns)


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
