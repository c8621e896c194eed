"""Personal data by patterns of characters, and by bootstrapped patterns of context; DataFrame functions only.

**Base.** Emails, IPv4 addresses, card numbers (Luhn) and phone numbers, by one regular expression each: leftmost, not overlapping within a kind, places in code points.

**Bootstrapping.** Instances are tokens with a digit or an @, and runs of such tokens without letters, so that a phone or card number of several tokens is one. An instance's patterns are the word before it, the word after it (each with a coarse class of the instance) and both words. Instances that hold a base span are the seeds. In turns, as a graph in Spark, a pattern is scored by the share of its distinct instances that are known or found of a kind (the lower end of Wilson's interval, so that few instances prove little), and patterns of high score and enough of these name further instances, which then support patterns without any seed, until the scores settle. Identifiers that have neither a digit nor an @ are no instances.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free, fresh, rows_fit

# The kinds in the order of the output, and their expressions. Possessive repeats and anchored starts match
# the same as the plain forms, in time linear in the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))
_NUMERIC = r"[^\s0-9A-Za-z@]*+[0-9][^\sA-Za-z@]*+(?!\S)"
MENTION = rf"(?<!\S)(?:{_NUMERIC}(?:\x20{_NUMERIC})*+|[^\s0-9@]*+[0-9@]\S*+)"

#: Turns end when the scores settle: when what is found, and its scores in all, are as in the turn before. They always end after so many.
LEAST_SEEDS = 3
LEAST_SCORE = 0.6
_BLOCK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often it is named, inner functions included."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _matches(text: Column, pattern: str) -> Column:
    """Matches with their places: array of (start, end, value, gap), gap being the text before. Lengths are summed in blocks, then within them."""
    empty = F.expr("cast(array() as array<struct<start:int,end:int,value:string,gap:string>>)")

    def step(acc: Column, r: Column) -> Column:
        start = acc["at"] + F.length(r["gap"])
        end = start + F.length(r["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), r["value"].alias("value"), r["gap"].alias("gap")))).alias("out"))

    def sized(acc: Column, part: Column) -> Column:
        return F.struct((acc["at"] + F.aggregate(part, F.lit(0), lambda n, r: n + F.length(r["gap"]) + F.length(r["value"]))).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def placed(rows: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / _BLOCK).cast("int")), lambda k: F.slice(rows, k * _BLOCK + 1, F.lit(_BLOCK)))
        return F.when(F.size(rows) > 0, _let(parts, lambda parts: F.flatten(F.zip_with(parts, F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")), sized)["out"], lambda part, at: F.aggregate(part, F.struct(at.alias("at"), empty.alias("out")), step)["out"])))).otherwise(empty)

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return _let(_let(both, lambda x: F.zip_with(x["found"], F.slice(x["gaps"], F.lit(1), F.size(x["found"])), lambda m, g: F.struct(m.alias("value"), g.alias("gap")))), placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is divisible by 10."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), term), F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(_digits(value)).between(13, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _listed(spans: Column) -> Column:
    """kind:start:end of spans, in order, comma-joined."""
    order = {k: i for i, (k, _) in enumerate(KINDS)}
    number = F.create_map(*(x for k, i in order.items() for x in (F.lit(k), F.lit(i))))
    sorted_ = F.array_sort(F.transform(spans, lambda s: F.struct(number[s["kind"]].alias("order"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(sorted_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _class(token: Column) -> Column:
    """@ if it holds one, 0 without letters, else a: hardly more than what makes a token an instance, so that patterns reach beyond the base expressions."""
    return F.when(F.contains(token, F.lit("@")), "@").when(token.rlike("[A-Za-z]"), "a").otherwise("0")


def _kind_of(token: Column) -> Column:
    """The first kind whose expression a token holds, or null: a token is looked at alone, so that a text of many costs no more than their lengths."""
    needs = {"email": F.contains(token, F.lit("@")), "phone": F.contains(token, F.lit("+"))}
    kind = F.lit(None).cast("string")

    def held(name: str, pattern: str) -> Column:
        return F.exists(F.regexp_extract_all(token, F.lit(pattern), F.lit(0)), lambda m: _holds(name, m))

    for name, pattern in reversed(KINDS):
        kind = F.when(needs.get(name, F.lit(True)) & held(name, pattern), F.lit(name)).otherwise(kind)
    return kind


def base_spans(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """`docs` with arrays of base spans (kind, start, end) and of mentions (start, end, token, contexts, kind of the base that they hold), and these columns' names."""
    names = dict(zip(("spans", "mentions"), fresh(docs, "spans", "mentions"), strict=True))
    t = F.coalesce(F.col(text), F.lit(""))
    needs = {"email": F.contains(t, F.lit("@")), "phone": F.contains(t, F.lit("+"))}
    digit = t.rlike("[0-9]")
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")

    def own(kind: str, pattern: str) -> Column:
        good = F.filter(_matches(t, pattern), lambda m: _holds(kind, m["value"]))
        spans = F.transform(good, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
        return F.when(needs.get(kind, digit), spans).otherwise(none)

    out = docs.withColumn(names["spans"], F.concat(*(own(k, p) for k, p in KINDS)))

    blank = lambda x: F.trim(F.translate(x, "\n\t\r", "   "))

    def word(x: Column, at: int) -> Column:
        """The first (1) or last (-1) word of some text, in small letters, digits alike, without marks at its ends."""
        own = F.regexp_replace(F.lower(F.substring_index(blank(x), " ", at)), r"^[.,;:!?()\[\]{}'\"]+|[.,;:!?()\[\]{}'\"]+$", "")
        own = F.regexp_replace(own, "[0-9]+", "0")
        return F.when(F.length(own) > 32, F.md5(own.cast("binary"))).otherwise(own)  # a long word goes by its hash

    def mention(m: Column, near: Column) -> Column:
        token = F.regexp_replace(m["value"], r"[.,;:!?)\]}'\"]+$", "")
        end = m["start"] + F.length(token)
        left, right = word(F.concat_ws(" ", near["before"], m["gap"]), -1), word(near["after"], 1)
        sides = (left != "") & (right != "")
        own = F.array(F.when(left != "", F.concat_ws(" ", F.lit("<"), left, _class(token))), F.when(right != "", F.concat_ws(" ", F.lit(">"), right, _class(token))), F.when(sides, F.concat_ws(" ", F.lit("<>"), left, right)))
        own = F.filter(own, lambda c: c.isNotNull())
        return F.struct(m["start"].alias("start"), end.alias("end"), token.alias("token"), own.alias("contexts"), _kind_of(token).alias("kind"))

    def mentions(x: Column) -> Column:
        # for each mention the one before it, and the text up to the one after it with that one
        values = F.transform(x["found"], lambda m: m["value"])
        after = F.zip_with(F.slice(x["gaps"], F.lit(2), F.size(x["found"])), F.slice(values, F.lit(2), F.size(x["found"])), lambda g, v: F.concat_ws(" ", g, v))
        near = F.zip_with(F.slice(F.concat(F.array(F.lit("")), values), F.lit(1), F.size(x["found"])), after, lambda b, a: F.struct(b.alias("before"), a.alias("after")))
        return F.zip_with(x["found"], near, mention)

    listed = _let(F.struct(_matches(t, MENTION).alias("found"), F.split(t, MENTION, -1).alias("gaps")), mentions)
    nothing = F.expr("cast(array() as array<struct<start:int,end:int,token:string,contexts:array<string>,kind:string>>)")
    return out.withColumn(names["mentions"], F.when(digit | needs["email"], listed).otherwise(nothing)), names


def _lower(hits: Column, n: Column) -> Column:
    """The lower end of Wilson's interval of a share, one standard deviation wide."""
    p = hits / n
    return (p + 1 / (2 * n) - F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / n + 1 / (4 * n * n))) / (1 + 1 / n)


def contexts(mentions: DataFrame) -> DataFrame:
    """(context, kind, score, seeds) from rows (token, context, kind), kind null if unknown. In turns the instances of good contexts are found, and count for other contexts, with seeds or without, until the scores settle."""
    graph = cut(mentions.groupBy("context", "token").agg(F.max("kind").alias("known")))
    size = cut(graph.groupBy("context").agg(F.count("*").alias("n")))
    known = cut(graph.where("known is not null").groupBy("token").agg(F.max("known").alias("kind")).withColumn("token_score", F.lit(1.0)))
    pairs = graph.select("context", "token")
    have, seen, context = known, set(), None
    start = known.count()
    while True:
        sums = pairs.join(have, "token").groupBy("context", "kind").agg(F.sum("token_score").alias("total"), F.count("*").alias("seeds"))
        last, context = context, cut(sums.join(size, "context").select("context", "kind", _lower(F.col("total"), F.col("n")).alias("score"), "seeds"))
        free(*filter(None, [last]))
        found = pairs.join(good_contexts(context), "context").groupBy("token").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("token_score"))
        old, have = have, cut(known.unionByName(found.join(known, "token", "left_anti")))
        if old is not known:
            free(old)
        now = tuple(have.agg(F.count("*"), F.round(F.sum("token_score"), 2)).first())
        # settled, or back at what was had before: there are only so many
        if now in seen or (not seen and now[0] == start):
            break
        seen.add(now)
    free(graph, size, known, have)
    return context


def good_contexts(context: DataFrame) -> DataFrame:
    """(context, kind, score) of the contexts that name instances, with the best kind of each."""
    good = context.where((F.col("score") >= LEAST_SCORE) & (F.col("seeds") >= LEAST_SEEDS))
    return good.groupBy("context").agg(F.max_by("kind", F.struct("score", "seeds", "kind")).alias("kind"), F.max("score").alias("score"))


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found) of every row of `docs`.

    Counts and base_sha256 are of the base spans; spans lists those and the n_found ones that contexts gave, as kind:start:end in code points. A null text counts as empty and has none; rows without an id are kept; repeated rows have equal results. Other columns are ignored.
    """
    own = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("k"), F.col(text).alias("text"))
    based, names = base_spans(own)
    base = cut(based.select("id", "k", F.col(names["spans"]).alias("spans"), F.col(names["mentions"]).alias("mentions")))
    mentions = base.select("k", F.inline("mentions"))
    each = mentions.select("k", "start", "end", "token", "kind", F.explode("contexts").alias("context"))
    best = good_contexts(contexts(each.select("token", "context", "kind")))
    best = F.broadcast(best) if rows_fit(best, 50_000) else best
    # a place that several contexts name has one kind
    named = each.where("kind is null").drop("kind").join(best, "context").groupBy("k", "start", "end").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    more = named.groupBy("k").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    more = F.broadcast(more) if (named.count() <= 200_000) else more  # each some 30 bytes of an array
    out = base.join(more, "k", "left")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.concat("spans", "more"))
    found = F.when(F.col("more").isNull(), 0).otherwise(F.size("more"))
    return out.select(F.col("id").alias(doc_id), *(count(k) for k, _ in KINDS), F.sha2(_listed(F.col("spans")).cast("binary"), 256).alias("base_sha256"), _listed(every).alias("spans"), found.cast("long").alias("n_found"))
