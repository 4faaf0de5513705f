"""Personal data against plain versions: the shapes by greedy regexes, the rounds by hand."""

import hashlib
import math
import random
import re
import time
from collections import defaultdict

import pytest
import regex

from lexweave.llm import pii, queries


# The shapes as greedy regexes.
SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def shaped(kind, match):
    return bool(re.fullmatch(SHAPES[kind], match)) and good(kind, match)


def plain_spans(text):
    """(start, kind's number, end), sorted."""
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(SHAPES) for m in re.finditer(SHAPES[kind], text) if good(kind, m[0]))


def plain_matches(text):
    """(start, end, match, before, after, first, last) of every mention, by the engine's own pattern."""
    pattern = regex.compile(pii._MENTION)
    found = list(pattern.finditer(text))
    for i, m in enumerate(found):
        before = text[found[i - 1].end() if i else 0 : m.start()]
        after = text[m.end() : found[i + 1].start() if i + 1 < len(found) else len(text)]
        yield m.start(), m.end(), m[0], before, after, i == 0, i + 1 == len(found)


def plain_patterns(before, after, first, last):
    def word(w, none):
        w = re.sub(r"\d", "0", w.lower())
        return none if not w else "…" if len(w) > pii.LONGEST_WORD else w

    words = before.split()
    edge = "^" if first else "#"
    one, two = word(words[-1] if words else "", edge), word(words[-2] if len(words) > 1 else "", edge)
    right = word(after.split()[0] if after.split() else "", "$" if last else "#")
    return ([f"{one} _"] if one not in "^#" else []) + [f"{two} {one} _", f"{one} _ {right}"]


def plain_extract(texts, how=pii.Bootstrap()):
    """For each text the spans that the patterns tell."""
    every = []
    for text in set(texts):
        for start, end, match, before, after, first, last in plain_matches(text):
            kind = next((k for k, name in enumerate(pii.KINDS) if shaped(name, match)), None)
            every.append((text, start, end, match.lower(), kind, plain_patterns(before, after, first, last), len(match)))
    stands = defaultdict(dict)
    for _, _, _, instance, kind, patterns, _ in every:
        for p in patterns:
            stands[p][instance] = kind
    scores, sure = {}, {}
    for _ in range(how.rounds):
        before, sure = sure, {}
        for p, own in stands.items():
            hits = [sum(1.0 if kind == k else scores.get(i, (None, 0))[1] if kind is None and scores.get(i, (None, 0))[0] == k else 0.0 for i, kind in own.items()) for k in range(4)]
            if max(hits) >= how.least_seeds and max(hits) >= how.least_sure * len(own) and None in own.values():
                sure[p] = (hits.index(max(hits)), round(max(hits) / len(own), 9))
        if sure == before or not sure:
            break
        votes = defaultdict(lambda: [0.0] * 4)
        for p, (k, s) in sure.items():
            for i, kind in stands[p].items():
                if kind is None:
                    votes[i][k] += math.log(1 - min(s, 0.99))
        scores = {i: (min(range(4), key=lambda k: (v[k], k)), round(1 - math.exp(min(v)), 9)) for i, v in votes.items()}
    out = defaultdict(dict)
    for text, start, end, _, kind, patterns, size in every:
        told = [(sure[p][1], -sure[p][0]) for p in patterns if p in sure]
        if kind is None and told and how.shortest <= size <= how.longest and not any(a < end and start < b for a, _, b in plain_spans(text)):
            out[text][start, end] = -max(told)[1]
    return {text: sorted((a, k, b) for (a, b), k in found.items()) for text, found in out.items()}


def spans_of(spark, texts, how=pii.Bootstrap()):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string").repartition(5)
    out = {}
    for r in pii.extract(df, how=how).spans().collect():
        out[r["doc_id"]] = ([tuple(s) for s in r["base"]], [tuple(s) for s in r["found"]])
    return out


HARD = [
    "a@b.c..d@e.f", "a@b", "a@b.", "x@y.z@w.v", "..@a-b.c-", "a@b.c-d.e_f@g.h", "é@b.c", "me@x.org,you@y.org", "a@.b", "@a.b",
    "1.2.3.4.5.6.7.8", "256.1.1.1", "0255.1.01.000", "1.2.3", "1.2.3.4a", "99999999999999999999.1.1.1", "1..2.3.4.5",
    "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111  1111 1111 1111", "0000000000000", "1 2 3 4 5 6 7 8 9 0 1 2", "4111111111111111 4111111111111111", "x4111111111111111x",
    "+1 (743) 555-3824, +49 30 123456", "+1", "+12", "+1 ", "+1 2", "++1 234 567 890", "+1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6", "+1234567890\t+1", "+1 (", "+1.2.3.4.5.6.7.8.9",
    "😀 a@b.c 😀 1.2.3.4", "\x00a@b.c\x00", "a +1 743 555 3824", "",
]


def test_shapes_equal_the_greedy_regexes(spark):
    rnd = random.Random(3)
    texts = [*HARD, None, *("".join(rnd.choice("aB9 0.@-+1_%()é\n") for _ in range(rnd.randrange(1, 60))) for _ in range(600)), *("".join(rnd.choice("0123456789 -.+") for _ in range(40)) for _ in range(300))]
    got = spans_of(spark, texts)
    for i, t in enumerate(texts):
        assert got[i][0] == plain_spans(t or ""), t


def told_texts(rnd, n=30):
    """Texts in which customer numbers stand where card numbers do, and logins where addresses do; other numbers stand elsewhere."""
    def card():
        d = [4, *(rnd.randrange(10) for _ in range(14))]
        for c in range(10):
            if shaped("card", "".join(map(str, [*d, c]))):
                return "".join(map(str, [*d, c]))

    words = ["alpha", "beta", "gamma", "delta", "of", "the"]
    some = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 6)))
    texts = [f"{some()} card number: {card()} {some()}" for _ in range(n)] + [f"{some()} write to u{i}@mail{i % 3}.example.org {some()}" for i in range(n)]
    texts += [f"{some()} card number: KD-{rnd.randrange(10000)} {some()}" for _ in range(3)] + [f"{some()} write to user{rnd.randrange(1000)} {some()}" for _ in range(2)]
    return texts + [f"{some()} in {rnd.randrange(1900, 2000)} of {some()} {rnd.randrange(10**6)}" for _ in range(n)]


def test_patterns_discover_what_has_no_shape(spark):
    texts = told_texts(random.Random(8))
    got = spans_of(spark, texts)
    want = plain_extract(texts)
    for i, t in enumerate(texts):
        assert got[i] == (plain_spans(t), want.get(t, [])), t
        assert bool(got[i][1]) == ("KD-" in t or " user" in t), t
        for a, k, b in got[i][1]:
            assert (pii.KINDS[k], t[a:b][:2]) in {("card", "KD"), ("email", "us")}


def test_later_rounds_learn_from_what_was_found(spark):
    texts = [f"pay with card {c}" for c in ("4111111111111111", "5500005555555559", "340000000000009", "30000000000004", "6011000000000004", "3530111333300000")]
    texts += [f"pay with card {t} now" for t in ("CX-10001",)] + [f"kept under {t} here" for t in ("CX-10001",)]
    how = pii.Bootstrap(rounds=4, least_sure=0.8, least_seeds=5)
    got = spans_of(spark, texts, how)
    assert [bool(f) for _, f in got.values()].count(True) == 1
    assert {i: f for i, (_, f) in got.items() if f} == {6: [(14, 2, 22)]}
    many = texts + [f"pay with card CX-1000{i}" for i in range(2, 9)] + [f"{w} kept under CX-1000{i} here" for i in range(2, 9) for w in ("a", "b")] + ["a kept under ZZ-99999 here"] + [f"pay with card {c}" for c in shaped_cards(40)]
    got, want = spans_of(spark, many, how), plain_extract(many, how)
    assert all(got[i][1] == want.get(t, []) for i, t in enumerate(many))
    assert got[many.index("a kept under ZZ-99999 here")][1] == [(13, 2, 21)]  # told by a pattern without any seed of its own


def shaped_cards(n):
    return [next(f"{411111000000 + i}000{c}" for c in range(10) if shaped("card", f"{411111000000 + i}000{c}")) for i in range(n)]


def test_copies_make_no_pattern_sure(spark):
    texts = ["the account 4111111111111111 is"] * 50 + ["the account AB-12345 is"] * 50
    assert all(not found for _, found in spans_of(spark, texts).values())


def test_found_spans_stay_clear_of_shapes(spark):
    texts = [f"card no {c}" for c in shaped_cards(20)] + ["card no x1.2.3.4y and", "card no 1.2.3.4z", "card no 4111 1111 1111 1111abc"]
    got, want = spans_of(spark, texts), plain_extract(texts)
    for i, t in enumerate(texts):
        assert got[i] == (plain_spans(t), want.get(t, []))
        assert not any(a < d and c < b for a, _, b in got[i][0] for c, _, d in got[i][1])


def test_long_texts_take_linear_time(spark):
    n = 400_000
    texts = ["a" * n, "a@" + "b." * n, "1" * n, "1 " * n, "1.2.3.4 " * (n // 8), "+1 " + " " * n, "+" * n, "a@b.c " * (n // 6), "x1 " * (n // 3), ". " * n]
    began = time.time()
    got = spans_of(spark, texts)
    assert time.time() - began < 120
    for i in (0, 1, 2, 3, 5, 6, 9):
        assert not got[i][0] or i == 1
    assert len(got[4][0]) == n // 8 and got[4][0][-1] == (n - 8, 1, n - 1) and len(got[7][0]) == n // 6


def test_odd_rows(spark, odd, empty):
    assert pii.extract(empty).spans().count() == 0
    got = pii.extract(odd).spans().collect()
    rows = odd.select("doc_id", "text").collect()
    assert sorted(repr((r["doc_id"], [tuple(s) for s in r["base"]])) for r in got) == sorted(repr((r["doc_id"], plain_spans(r["text"] or ""))) for r in rows)


def test_the_query_over_the_whole_table(spark, sf_dir):
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = plain_extract(list(rows.values()))
    told = lambda spans: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    got = queries.op13_personal_data(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r["doc_id"]]
        base = plain_spans(text)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x == k for _, x, _ in base) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(told(base).encode()).hexdigest()
        assert r["spans"] == told(sorted([*base, *found.get(text, [])]))


def test_the_plan_has_no_python(spark, sf_dir, capsys):
    queries.op13_personal_data(spark, sf_dir).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_sums(spark, n):
    from pyspark.sql import functions as F

    values = [(i * 7) % 11 for i in range(n)]
    got = spark.createDataFrame([(values,)], "v array<bigint>").select(pii._running(F.col("v"))).first()[0]
    assert got == [sum(values[:i]) for i in range(n)]
