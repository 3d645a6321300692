import math
import random
from collections import Counter

from vitaframe.llm import langid


def docs_of(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")


def letters(i):
    return "".join(chr(97 + int(c)) for c in str(i))


def test_large_languages_do_not_push_small_ones_out(spark):
    large = [(" ".join(f"k{letters(i * 40 + k)}" for k in range(40)) + " kk" * 50, "aa") for i in range(60)]
    small = [("zu zo zuzo zozu", "zz")] * 6
    model = langid.train(docs_of(spark, large + small))
    assert model.languages == ["aa", "zz"] and model.words.find(langid.hashes(["zu", "zo", "zuzo", "zozu", "zuzozu"]))[0].tolist() == [True] * 4 + [False]
    assert all((table.languages == 1).any() for table in model.by_length)  # every length has n-grams of the small one
    got = {r._row.text: r.lang_pred for r in langid.with_language(docs_of(spark, [("zozuzo", "?"), ("kk kabcd", "?")]), model).collect()}
    assert got == {"zozuzo": "zz", "kk kabcd": "aa"}


def test_junk_goes_and_nothing_is_lost_without_labels(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rng = random.Random(5)
    noise = lambda signs: " ".join("".join(rng.choice(signs) for _ in range(rng.randint(6, 12))) for _ in range(60))
    junk = [noise("abcdefghijklmnopqrstuvwxyz"), noise("qxzjkvwbfg"), noise("abcdef0123456789"), noise("абвгдежзиклмноп")]
    clean = [r.text for r in docs.where("length(text) > 200").limit(5).collect()]
    df = docs_of(spark, [(t, None) for t in [*junk, *clean, "zqx jkw", None, "12 !"]])
    kept = [r.doc_id for r in langid.of_known_language(df, langid.train(docs)).collect()]
    assert sorted(kept) == [4, 5, 6, 7, 8, 9]
    unlabelled = langid.of_known_language(df, langid.train(df))
    assert sorted(r.doc_id for r in unlabelled.collect()) == list(range(10))


def by_hand(learned, texts):
    """The word-first score, a second time: log frequencies with half a count added, means of the longest known n-grams."""
    names = sorted({lang for _, lang in learned})
    tables = [dict() for _ in range(6)]  # words, then n-grams by length
    for text, lang in learned:
        for word, n in langid.words(text).items():
            tables[0].setdefault(word, Counter())[lang] += n
            for k in range(1, 6):
                for at in range(len(word) + 3 - k):
                    tables[k].setdefault(f"<{word}>"[at : at + k], Counter())[lang] += n
    total = [{name: sum(c[name] for c in t.values()) for name in names} for t in tables]

    def log(k, token, name):
        return math.log(tables[k][token][name] + 0.5) - math.log(total[k][name] + 0.5 * (len(tables[k]) + 1))

    def of_word(word, name):
        if word in tables[0]:
            return log(0, word, name)
        for k in range(5, 0, -1):
            known = [g for at in range(len(word) + 3 - k) if (g := f"<{word}>"[at : at + k]) in tables[k]]
            if known:
                return sum(log(k, g, name) for g in known) / len(known)
        return 0.0

    out = []
    for text in texts:
        sums = {name: sum(n * of_word(word, name) for word, n in langid.words(text).items()) for name in names}
        best = max(names, key=sums.__getitem__)
        out.append((best, 1 / sum(math.exp(v - sums[best]) for v in sums.values())))
    return out


def test_scores_as_by_hand(spark):
    rng = random.Random(9)
    word = lambda signs: "".join(rng.choice(signs) for _ in range(rng.randint(1, 7)))
    of = {"de": "abcdeüß", "en": "abcdefg", "zz": "efgxyz"}
    learned = [(" ".join(word(of[lang]) for _ in range(12)), lang) for lang in of for _ in range(8)]
    texts = [" ".join(word(rng.choice(list(of.values()))) for _ in range(rng.randint(1, 6))) for _ in range(80)] + ["qqq", "ööö ppp"]
    docs = docs_of(spark, learned)
    free = [r.doc_id for r in docs.where(~langid.held_out(docs.doc_id)).collect()]
    model = langid.train(docs)
    got = langid.with_language(docs_of(spark, [(t, None) for t in texts]), model).orderBy("_row.doc_id").collect()
    want = by_hand([learned[i] for i in free], texts)
    assert [r.lang_pred for r in got] == [w[0] for w in want]
    assert all(abs(r.score - w[1]) < 1e-3 for r, w in zip(got, want, strict=True))


def test_memory_of_words_may_overflow(spark, monkeypatch):
    rng = random.Random(10)
    texts = [" ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(rng.choice([3, 400]))) for _ in range(60)]
    docs = docs_of(spark, [(t, "ab"[i % 2]) for i, t in enumerate(texts)])
    model = langid.train(docs)
    large, small = langid.Judge(model), langid.Judge(model)
    small.PART, small.room = 50, 100
    assert [large.judge_all([t])[0] for t in texts] == small.judge_all(texts)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "ab cd", "x", "r", "j"), (1, None, "x", "r", "j"), (2, "ab", None, "r", "j")], "doc_id long, text string, lang string, _row string, _j string")
    model = langid.train(docs)
    assert model.languages == []
    assert [r.lang_pred for r in langid.with_language(docs, model).collect()] == ["und"] * 3
    assert langid.with_language(docs.limit(0), model).count() == 0
