"""Languages: the lattice, the fit and the answers against plain versions."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from lexweave.llm import _common, langid, queries

PIECES = langid.public_pieces(queries.vocabulary("piece_bpe_32k.model"))
NUMBER = {p: i for i, p in enumerate(PIECES, 1)}


def cuts(word, numbers, longest):
    """(begin, end, piece number) of all pieces and single characters of a word."""
    for end in range(1, len(word) + 1):
        for n in range(1, min(end, longest) + 1):
            i = numbers.get(word[end - n : end], 0)
            if i or n == 1:
                yield end - n, end, i


def plain_forward(word, numbers, prob, longest=16):
    """The logarithm of the sum over all segmentations, node by node, with scaling."""
    sums, scale = [1.0], 0.0
    by_end = defaultdict(list)
    for begin, end, i in cuts(word, numbers, longest):
        by_end[end].append((begin, prob[i] if i else langid.UNKNOWN))
    for end in range(1, len(word) + 1):
        sums.append(sum(sums[b] * p for b, p in by_end[end]))
        if sums[-1] < 1e-100:
            sums = [0.0] * (len(sums) - longest) + [x * 1e100 for x in sums[-longest:]]
            scale -= 100 * math.log(10)
    return math.log(sums[-1]) + scale


@lru_cache(maxsize=None)
def segmentations(word):
    """Every way to cut a word into parts."""
    return [[]] if not word else [[word[:n], *rest] for n in range(1, len(word) + 1) for rest in segmentations(word[n:])]


def random_model(pieces, languages, seed):
    rnd = np.random.default_rng(seed)
    probs = np.vstack((np.zeros(languages), rnd.random((len(pieces), languages))))
    return langid.LanguageModel([f"l{i}" for i in range(languages)], pieces, probs / probs.sum(0))


def test_forward_sums_all_segmentations():
    pieces = sorted(["▁", "▁a", "ab", "b", "abc", "c", "▁ab", "bc"])
    model = random_model(pieces, 2, 7)
    tried = ["▁abc", "▁", "▁zab", "▁abcabcab", "▁é"]
    for row, w in zip(model.scorer().log_probs(tried), tried, strict=True):
        for g in range(2):
            prob = {p: model.probs[i + 1, g] for i, p in enumerate(pieces)}
            want = sum(math.prod(prob.get(x, langid.UNKNOWN if len(x) == 1 else 0.0) for x in cut) for cut in segmentations(w))
            assert row[g] == pytest.approx(np.log(want))


@pytest.mark.parametrize("window", [langid.WINDOW, 60, 17])
def test_words_of_any_length_are_summed_whole(window):
    """Long words, unspaced scripts and long pieces, whatever the window that is held at a time."""
    model = random_model(PIECES, 2, 1)
    rnd = random.Random(2)
    words = ["▁" + "".join(rnd.choice("etaoinshrdluab") for _ in range(n)) for n in (500, 0, 1, 33, 34, 2000)]
    words += ["▁これは日本語の文です。" * 40, "▁zażółć", max(PIECES, key=len) * 30, "▁" + max((p for p in PIECES if p.isascii()), key=len) * 3]
    got = model.scorer().log_probs(words, window)
    for row, w in zip(got, words, strict=True):
        for g in range(2):
            assert row[g] == pytest.approx(plain_forward(w, NUMBER, model.probs[:, g]), rel=1e-9)


def test_known_words_give_the_same_results(monkeypatch):
    monkeypatch.setattr(langid, "KNOWN_NUMBERS", 18 * 30)  # room for 30 words
    scorer = langid.WordScorer(random_model(PIECES, 2, 6))
    rnd = random.Random(7)
    pool = ["".join(rnd.choice("etaon") for _ in range(rnd.randrange(0, 25))) for _ in range(80)]
    for _ in range(20):
        words = [rnd.choice(pool) for _ in range(40)]
        want = scorer.log_probs(["▁" + w for w in words])
        want[[not w for w in words]] = 0
        assert scorer.of_words(words) == pytest.approx(want)
    assert len(scorer.known) == 30 == len(set(scorer.known.values()))


def test_long_words_take_linear_time():
    scorer = random_model(PIECES, 4, 3).scorer()
    rnd = random.Random(4)
    for word in ("▁" + "".join(rnd.choice("etaoinshrdluab") for _ in range(400_000)), "▁" + "the" * 130_000, "▁" + "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(400_000))):
        began = time.time()
        assert np.isfinite(scorer.log_probs([word])).all()
        assert time.time() - began < 60


def test_the_trie_finds_only_pieces():
    table = langid.piece_table(tuple(PIECES))
    words = [*random.Random(8).sample(PIECES, 500), "▁qzqzx", "zzzzzzz", "a▁b"]
    codes, bounds = langid.coded(words)
    found = set(zip(*(x.tolist() for x in table.edges(codes, np.repeat(bounds[1:], np.diff(bounds)), 0, len(codes))), strict=True))
    assert found == {(int(a) + b, int(a) + e, i) for a, w in zip(bounds, words, strict=False) for b, e, i in cuts(w, NUMBER, table.longest)}
    assert table.longest == max(map(len, PIECES)) and set(range(1, len(PIECES) + 1)) == set(table.piece_of.tolist()) - {0}


def plain_counts(words, prob):
    """Expected counts of the pieces by a forward and a backward pass over each word; words: word to count."""
    out = Counter()
    for w, n in words.items():
        edges = list(cuts(w, NUMBER, 16))
        if prob is None:
            out.update({i: 0 for _, _, i in edges})
            for _, _, i in edges:
                out[i] += n
            continue
        p = [prob[i] if i else langid.UNKNOWN for _, _, i in edges]
        forth, back = [1.0] + [0.0] * len(w), [0.0] * len(w) + [1.0]
        for (b, e, _), x in zip(edges, p, strict=True):
            forth[e] += forth[b] * x
        for (b, e, _), x in sorted(zip(edges, p, strict=True), key=lambda y: -y[0][0]):
            back[b] += back[e] * x
        for (b, e, i), x in zip(edges, p, strict=True):
            out[i] += n * forth[b] * x * back[e] / forth[-1]
    return out


@pytest.mark.parametrize("window", [langid.WINDOW, 40])
def test_expected_counts(window):
    model = random_model(PIECES, 1, 5)
    words = {"▁the": 3, "▁international": 2, "▁qzx": 1, "▁これは日本語": 4, "▁nationinternationalnations": 1}
    for logp, prob in ((None, None), (langid._logs(model.probs)[:, 0], model.probs[:, 0])):
        got = langid.expected_counts(langid.piece_table(tuple(PIECES)), list(words), np.array(list(words.values())), logp, window) / langid.PARTS
        want = plain_counts(words, prob)
        assert got == pytest.approx(np.array([want[i] for i in range(len(PIECES) + 1)]), abs=1e-4)


def plain_words(text):
    return ["▁" + w.lower() for w in re.findall(r"[A-Za-z\x80-\U0010ffff]+", text or "")]


def test_languages_equal_a_plain_model_on_all_documents(spark, sf_dir):
    """The whole query against expectation-maximisation and forward sums in plain Python."""
    docs = queries.table(spark, sf_dir, "documents").collect()
    held = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1
    learned = defaultdict(Counter)
    for r in docs:
        if r["lang"] is not None and not held(r):
            learned[r["lang"]].update(plain_words(r["text"]))
    assert max(Counter(r["lang"] for r in docs).values()) <= 1500  # so the sample is everything
    prob = {}
    for lang, words in learned.items():
        p = None
        for _ in range(4):
            counts = plain_counts(words, p)
            total = sum(0.01 + counts[i] for i in range(1, len(PIECES) + 1))
            p = [0.0, *((0.01 + counts[i]) / total for i in range(1, len(PIECES) + 1))]
        prob[lang] = p
    of_word = {}
    rows = {r["doc_id"]: r for r in queries.op9_language(spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    for r in docs:
        got = rows[r["doc_id"]]
        assert got["held_out"] == held(r)
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (got["lang_pred"], got["score"]) == ("und", 0.0)
            continue
        logs = Counter({lang: 0.0 for lang in prob})
        for w in plain_words(r["text"]):
            if w not in of_word:
                of_word[w] = {lang: plain_forward(w, NUMBER, p) for lang, p in prob.items()}
            for lang, x in of_word[w].items():
                logs[lang] += x
        best = max(sorted(logs), key=logs.get)
        assert got["score"] == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs.values()), abs=1e-3)
        if got["score"] > 0.51:
            assert got["lang_pred"] == best


def test_the_sample_never_runs_dry():
    for count in (1, 1500, 1501, 10**6, 10**10, 10**15):
        share = (langid.hash_bound(1500, count) - langid.LOWEST + 1) / 2**64
        assert share == pytest.approx(min(1, 1500 / count), rel=1e-3)


def test_languages_of_held_out_documents(spark, sf_dir):
    labels = {r["doc_id"]: r["lang"] for r in queries.table(spark, sf_dir, "documents").collect()}
    out = [r for r in queries.op9_language(spark, sf_dir).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == labels[r["doc_id"]] for r in out) >= 0.97 * len(out)


def test_a_bounded_sample_answers_alike_on_every_run(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    few = langid.fit(docs, PIECES, per_language=20)
    again = langid.fit(docs.repartition(7), PIECES, per_language=20)
    assert few.languages == again.languages and (few.probs == again.probs).all()
    rows = langid.identify(docs, few).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.9 * len(rows)


def test_rows_of_one_id_give_a_bounded_sample(spark):
    rnd = random.Random(2)
    english, german = "the house of water and the road".split(), "das haus und die straße mit wasser".split()

    def some(words, n=12):
        return " ".join(rnd.choice(words) for _ in range(n))

    for one in (1, 7, None):
        rows = [(one, some(english), "en") for _ in range(5000)] + [(i, some(german), "de") for i in range(1000)]
        rows += [(None, None, "xx")] * 50 + [(3, "12 34", "yy")] * 50
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        with pytest.warns(UserWarning, match="yy"):
            model = langid.fit(df, PIECES, per_language=300)
        assert model.languages == ["de", "en"]
        mark = model.pieces.index(langid.MARK + "the") + 1
        assert model.probs[mark, 1] > 100 * model.probs[mark, 0]
        told = langid.identify(df, model).filter("text IS NOT NULL AND lang <> 'yy'").collect()
        assert sum(r["lang_pred"] == r["lang"] for r in told) > 0.99 * len(told)


def test_repeated_rows_teach_once(spark):
    rows = [(1, "the water of the house", "en")] * 3000 + [(i, f"a road in the land {'x' * (i % 5)}", "en") for i in range(2, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert (langid.fit(df.repartition(5), PIECES).probs == langid.fit(df.distinct(), PIECES).probs).all()


def test_a_worker_drops_what_other_tasks_kept():
    scorer = random_model(PIECES, 2, 6).scorer()
    assert scorer is random_model(PIECES, 2, 6).scorer() and langid._SCORERS
    _common.take_worker(langid.__name__)
    assert langid._SCORERS
    _common.take_worker("another")
    assert not langid._SCORERS and not _common._KEPT and langid.piece_table.cache_info().currsize == 0


def test_languages_of_odd_texts(odd, empty):
    model = langid.fit(odd, PIECES)
    assert model.languages == ["en", "fr"]
    rows = langid.identify(odd, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] != "und") == lettered and (r["lang_score"] > 0) == lettered
    nothing = langid.fit(empty, PIECES)
    assert nothing.languages == [] and {r["lang_pred"] for r in langid.identify(odd, nothing).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_unspaced_scripts_teach_and_are_told_apart(spark):
    chinese, japanese = "中国的人民在大学里学习语言和历史", "これはとても面白い日本語の文章ですね"
    rows = [(i, (chinese if i % 2 else japanese)[i % 3 :] * (20 + i), "zh" if i % 2 else "ja") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = langid.identify(df, langid.fit(df, PIECES)).collect()
    assert all(r["lang_pred"] == r["lang"] and r["lang_score"] > 0.9 for r in told)
