"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Four kinds have shapes of their own (e-mail and IP addresses, card and phone numbers). What these shapes find are the seeds. Every
seed and every other token with a digit is a mention that stands in lexical patterns: the words before it, or the words around it.
Patterns and instances (the distinct strings of the mentions) make a graph, and scores go through it in rounds: a pattern counts as
sure as the share of its distinct instances that are of one kind, an instance as sure as the patterns it stands in make it. In the end
the sure patterns tell the kind of mentions that have no shape of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm._common import discard, quoted, stored

# The kinds in the order of the output, and the shape of each. The shapes match what plain greedy ones do, but in linear
# time: loops are over one class of characters, never over a group, so that no length of text makes them deep.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
SHAPES = {
    # the local part begins a run of its characters, or where the last address has ended within one
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@(?={_LABEL}++\.{_LABEL})[A-Za-z0-9.-]*?(?<={_LABEL})(?!{_LABEL}|\.{_LABEL})",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?(?<=[0-9])(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(SHAPES)
#: What must stand in a text for a shape to match at all.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_TOKEN = r"[\p{L}\p{N}._%+@/-]"
#: Every mention: one of the shapes, or a run of token characters with a digit.
_MENTION = "|".join([SHAPES["email"].replace(r"\G|", ""), SHAPES["phone"], SHAPES["ip"], SHAPES["card"] + rf"(?!{_TOKEN})", rf"(?<!{_TOKEN}){_TOKEN}*?[0-9]{_TOKEN}*+"])
#: Context words of more characters count as one unknown word.
LONGEST_WORD = 40


@dataclass(frozen=True)
class Bootstrap:
    """rounds of scoring; a pattern is sure from least_sure on if at least least_seeds distinct instances vouch for it; a mention
    without a shape has shortest to longest characters."""

    rounds: int = 3
    least_sure: float = 0.8
    least_seeds: int = 5
    shortest: int = 5
    longest: int = 64


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body looks at it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(sizes: Column, block: int = 256) -> Column:
    """For each number of an array the sum of those before it. Sums run within blocks, which are then raised by what stands before
    them, so that the work for n numbers is far below n * n."""
    none = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<bigint>").alias("list"))

    def along(x: Column) -> Column:
        return F.aggregate(x, none, lambda a, n: F.struct((a["total"] + n).alias("total"), F.concat(a["list"], F.array(a["total"])).alias("list")))

    def raised(x: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(x), F.lit(block))
        inside = F.transform(starts, lambda at: along(F.slice(x, at, F.lit(block))))
        return _let(inside, lambda b: F.flatten(F.zip_with(b, along(F.transform(b, lambda r: r["total"]))["list"], lambda r, o: F.transform(r["list"], lambda v: v + o))))

    return _let(sizes, lambda x: F.when(F.size(x) > 0, raised(x)).otherwise(F.array().cast("array<bigint>")))


def _matches(text: Column, pattern: str, needs: str | None = None) -> Column:
    """The matches of a pattern in a text, in order: start, end (code points, exclusive), match, before and after (the texts up to its
    neighbours), first and last (whether there is none). The lengths of the matches and of the pieces between them give the places."""

    def placed(found: Column, pieces: Column) -> Column:
        sizes = F.transform(found, lambda m, i: (F.char_length(F.get(pieces, i)) + F.char_length(m)).cast("long"))
        of = F.transform(found, lambda m, i: F.struct(m.alias("m"), F.get(pieces, i).alias("p"), F.get(pieces, i + 1).alias("q"), (i == 0).alias("first"), (i + 1 == F.size(found)).alias("last")))
        start = lambda x, b: (b + F.char_length(x["p"])).cast("int")
        return F.zip_with(of, _running(sizes), lambda x, b: F.struct(start(x, b).alias("start"), (start(x, b) + F.char_length(x["m"])).cast("int").alias("end"), x["m"].alias("match"), x["p"].alias("before"), x["q"].alias("after"), x["first"].alias("first"), x["last"].alias("last")))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if needs is not None:
        found = F.when(F.contains(text, F.lit(needs)), found).otherwise(F.array().cast("array<string>"))
    pieces = lambda m: F.when(F.size(m) > 0, F.split(text, pattern, -1))
    return _let(found, lambda m: _let(pieces(m), lambda p: placed(m, p)))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a number is right."""

    def counted(d: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    backwards = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    return F.aggregate(F.transform(backwards, counted), F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """Whether a match of a kind's shape is one."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return match.rlike(rf"\A{part}\.{part}\.{part}\.{part}\z")
    if kind == "card":
        return _let(_digits(match), lambda d: F.when(F.char_length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.char_length(_digits(match)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """What the shapes find in a text, as an array of (start, k, end) with the kind's number k, sorted."""

    def of(k: int, kind: str) -> Column:
        fine = F.filter(_matches(text, SHAPES[kind], _NEEDS.get(kind)), lambda x: valid(kind, x["match"]))
        return F.transform(fine, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end")))

    return F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)]))


def _kind_of(match: Column) -> Column:
    """The number of the kind whose shape a whole mention has; null for none."""
    out = F.lit(None).cast("int")
    for k, kind in reversed(list(enumerate(KINDS))):
        out = F.when(match.rlike(rf"\A(?:{SHAPES[kind]})\z") & valid(kind, match), F.lit(k)).otherwise(out)
    return out


def _word(text: Column, pattern: str, group: int, none: Column) -> Column:
    """A context word in lower case with digits as 0."""
    word = F.regexp_replace(F.lower(F.regexp_extract(text, pattern, group)), r"\p{N}", "0")
    return F.when(word == "", none).when(F.char_length(word) > LONGEST_WORD, F.lit("\u2026")).otherwise(word)


def _patterns(x: Column) -> Column:
    """The lexical patterns of a mention: the word before it, the two words before it, the words around it. ^ and $ are the ends of
    the text, # stands for a neighbouring mention; neither alone is a pattern."""
    edge = F.when(x["first"], F.lit("^")).otherwise(F.lit("#"))
    back = r"\A\s*+(\S++)(?:\s++(\S++))?"
    # from the end, so that a long text before a mention is not searched for its last words
    one, two = (lambda b: F.reverse(_word(b, back, 1, F.reverse(edge)))), (lambda b: F.reverse(_word(b, back, 2, F.reverse(edge))))
    after = _word(x["after"], r"\A\s*+(\S++)", 1, F.when(x["last"], F.lit("$")).otherwise(F.lit("#")))

    def made(b: Column) -> Column:
        return F.filter(F.array(F.when(~one(b).isin("^", "#"), F.concat(one(b), F.lit(" _"))), F.concat(two(b), F.lit(" "), one(b), F.lit(" _")), F.concat(one(b), F.lit(" _ "), after)), lambda p: p.isNotNull())

    return _let(F.reverse(x["before"]), made)


def mentions(text: Column) -> Column:
    """Every mention of a text: start, end, kind (the number of a shape's kind, or null), size, instance (a hash of the mention in
    lower case), patterns."""

    def told(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), _kind_of(x["match"]).alias("kind"), F.char_length(x["match"]).alias("size"), F.xxhash64(F.lower(x["match"])).alias("instance"), _patterns(x).alias("patterns"))

    return F.transform(_matches(text, _MENTION), told)


def _sure_patterns(edges: DataFrame, scores: DataFrame | None, how: Bootstrap) -> DataFrame:
    """pattern, k, sure: the patterns most of whose distinct instances are of one kind, by the scores so far."""
    held = edges.select("pattern", "instance", "kind", F.col("kind").alias("k"), F.lit(1.0).alias("score"))
    if scores is not None:
        own = scores.select(F.col("instance").alias("of"), F.col("k").alias("told"), F.col("score").alias("sure"))
        joined = edges.filter("kind IS NULL").join(own, F.col("instance") == F.col("of"), "left")
        held = held.filter("kind IS NOT NULL").unionByName(joined.select("pattern", "instance", "kind", F.col("told").alias("k"), F.coalesce("sure", F.lit(0.0)).alias("score")))
    hits = [F.sum(F.when(F.col("k") == k, F.col("score")).otherwise(0.0)).alias(f"h{k}") for k in range(len(KINDS))]
    seen = held.groupBy("pattern").agg(F.count("*").alias("n"), F.count_if(F.col("kind").isNull()).alias("open"), *hits)
    best = F.greatest(*[F.col(f"h{k}") for k in range(len(KINDS))])
    which = F.coalesce(*[F.when(F.col(f"h{k}") == best, F.lit(k)) for k in range(len(KINDS))])
    # a pattern without an open instance tells nothing new
    return seen.filter((best >= how.least_seeds) & (best >= how.least_sure * F.col("n")) & (F.col("open") > 0)).select("pattern", which.alias("k"), F.round(best / F.col("n"), 9).alias("sure"))


def _scores(edges: DataFrame, sure: DataFrame) -> DataFrame:
    """instance, k, score of the instances without a shape that stand in sure patterns: several patterns that agree make it surer."""
    of = edges.filter("kind IS NULL").join(sure, "pattern").groupBy("instance", "k").agg((1 - F.exp(F.sum(F.log(1 - F.least("sure", F.lit(0.99)))))).alias("score"))
    return of.groupBy("instance").agg(F.max_by(F.struct("k", "score"), F.struct("score", -F.col("k"))).alias("x")).select("instance", "x.k", F.round("x.score", 9).alias("score"))


@dataclass
class Extraction:
    """rows: each row's id, hash of its text and base spans (stored); patterns: pattern, k, sure (stored); found: the spans that the
    patterns tell, by hash of the text (stored)."""

    rows: DataFrame
    patterns: DataFrame
    found: DataFrame

    def spans(self) -> DataFrame:
        """doc_id, base (start, k, end) and found of each row, both sorted. The spans of a text stand for all its copies."""
        lists = self.found.groupBy(F.col("k1").alias("f1"), F.col("k2").alias("f2")).agg(F.array_sort(F.collect_list(F.struct("start", "k", "end"))).alias("found"))
        none = F.array().cast("array<struct<start:int,k:int,end:int>>")
        return self.rows.join(lists, (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")), "left").select("doc_id", "base", F.coalesce("found", none).alias("found"))


def extract(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Bootstrap = Bootstrap()) -> Extraction:
    """The personal data of df's texts: what has a shape, and what stands where such things stand.

    A null text counts as empty and has no spans. Texts are searched whole. Repeated rows get equal spans; equal texts teach once, and
    an instance counts once in a pattern however often it stands there, so copies make no pattern surer. A span that the patterns tell
    never overlaps one of the shapes. An empty df gives an empty result; other columns are not used.

    Texts are read once and do not move. What moves are the mentions' patterns and instances, which are counted before they move; the
    rounds run over stored edges, and a count and a checksum of the sure patterns reach the driver in each."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    read = df.select(quoted(id_col).alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), base_spans(text).alias("base"), mentions(text).alias("mentions"))
    whole = stored(read, "pii-mentions")
    several = whole.filter(F.size("mentions") > 0).select("k1", "k2", F.inline("mentions"))
    edges = stored(several.select(F.explode("patterns").alias("pattern"), "instance", "kind").distinct(), "pii-edges")
    scores, sure, last = None, None, None
    for _ in range(how.rounds):
        before, sure = sure, stored(_sure_patterns(edges, scores, how), "pii-patterns")
        sign = sure.agg(F.count("*"), F.sum(F.xxhash64("pattern", "k", "sure").cast("decimal(38,0)"))).first()
        if before is not None:
            discard(before, scores)
        if sign == last or not sign[0]:
            scores = None
            break
        last, scores = sign, stored(_scores(edges, sure), "pii-scores")
    discard(edges, *([] if scores is None else [scores]))
    open_ = several.filter(F.col("kind").isNull() & F.col("size").between(how.shortest, how.longest)).select("k1", "k2", "start", "end", F.explode("patterns").alias("pattern"))
    told = open_.join(sure, "pattern").groupBy("k1", "k2", "start", "end").agg(F.max_by("k", F.struct("sure", -F.col("k"))).alias("k"))
    found = stored(told.select("k1", "k2", "start", "k", "end"), "pii-told")
    clear = stored(_clear(found, whole), "pii-found")
    discard(found)
    return Extraction(whole.select("doc_id", "k1", "k2", "base"), sure, clear)


def _clear(found: DataFrame, whole: DataFrame) -> DataFrame:
    """The spans of found that overlap no base span of their text."""
    of = whole.join(found.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", F.inline("base")).distinct()
    both = found.withColumn("ours", F.lit(True)).unionByName(of.withColumn("ours", F.lit(False)))
    in_text = Window.partitionBy("k1", "k2").orderBy("start", "ours")
    reach = F.max(F.when(~F.col("ours"), F.col("end"))).over(in_text.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(~F.col("ours"), F.col("start"))).over(in_text.rowsBetween(0, Window.unboundedFollowing))
    free = F.coalesce(reach <= F.col("start"), F.lit(True)) & F.coalesce(ahead >= F.col("end"), F.lit(True))
    return both.withColumns({"free": free}).filter("ours AND free").select("k1", "k2", "start", "k", "end")
