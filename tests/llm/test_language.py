"""Language ID against a plain implementation, and its edges."""

import math
import random
import unicodedata
from collections import Counter

from fluvispark.llm import language_id

SYLLABLES = {"aa": ["ka", "lo", "mi"], "bb": ["thr", "esh", "ou"], "cc": ["szy", "czo", "wy"], "dd": ["ka", "thr", "wy"]}


def words(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if unicodedata.category(c)[0] in "LM":
            word += c
        else:
            if any(unicodedata.category(x)[0] == "L" for x in word):
                out.append(word)
            word = ""
    return out


def units(word, order):
    return [word] if not order else [word[i : i + order] for i in range(len(word) - order + 1)]


def plain(training, texts, min_count=2, sharpness=4.0):
    langs = sorted({x for _, x in training})
    seen = {o: Counter((u, x) for t, x in training for w in words(t) for u in units(w, o)) for o in (0, 4, 3, 2, 1)}
    out = []
    for t in texts:
        scores = dict.fromkeys(langs, 0.0)
        own = words(t)
        for w in own:
            for o in (0, 4, 3, 2, 1):
                table = seen[o]
                size = len({u for (u, _) in table if sum(table[u, x] for x in langs) >= min_count})
                known = [u for u in units(w, o) if sum(table[u, x] for x in langs) >= min_count]
                if known:
                    for x in langs:
                        total = sum(n for (_, y), n in table.items() if y == x) + 0.1 * max(1, size)
                        scores[x] += sum(math.log((table[u, x] + 0.1) / total) for u in known) / len(known)
                    break
        if not own:
            out.append(("und", 0.0))
            continue
        top = max(scores.values())
        best = min(x for x in langs if abs(scores[x] - top) < 1e-9)
        out.append((best, 1 / sum(math.exp(sharpness * (v - top) / len(own)) for v in scores.values())))
    return out


def text(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_same_as_plain_counting(spark):
    r = random.Random(1)
    training = [(text(r, x, r.randint(1, 12)), x) for x in SYLLABLES for _ in range(8)]
    texts = [text(r, x, r.randint(1, 6)) + " " + text(r, y, 1) for x in SYLLABLES for y in SYLLABLES] + ["", None, "12 ?", "zzz", "KALOMI"]
    model = language_id.fit(spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(training)], "doc_id long, text string, lang string"))
    got = {g.doc_id: g for g in language_id.identify(frame(spark, texts), model).collect()}
    for i, (lang, score) in enumerate(plain(training, texts)):
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-4, texts[i]


def test_marks_and_planes(spark):
    rows = [(0, "ein haus", "de"), (1, "ein haus", "de"), (2, "\U00031000\U00031001", "zh"), (3, "\U00031000\U00031001", "zh")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = [(g.lang_pred, g.score > 0) for g in language_id.identify(frame(spark, ["́̂", "\U00031000\U00031001", "éin", "\U000323af", "²١"]), model).orderBy("doc_id").collect()]
    assert got == [("und", False), ("zh", True), ("de", True), ("de", True), ("und", False)]


def test_three_hundred_languages_and_ties(spark):
    rows = [(10 * k + j, f"{chr(0x4E00 + k)}{chr(0x5E00 + k)} both", f"l{k:03d}") for k in range(300) for j in range(2)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 300
    texts = [f"{chr(0x4E00 + k)}{chr(0x5E00 + k)}" for k in range(300)] + ["both"]
    got = [g.lang_pred for g in language_id.identify(frame(spark, texts), model).orderBy("doc_id").collect()]
    assert got == [f"l{k:03d}" for k in range(300)] + ["l000"]


def test_a_large_language_is_sampled_and_a_rare_one_kept(spark):
    r = random.Random(2)
    rows = [(k, text(r, "aa", 3), "aa") for k in range(2000)] + [(5000 + k, text(r, "cc", 3), "cc") for k in range(2)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_docs_per_language=100)
    assert model.languages == ["aa", "cc"]
    assert [g.lang_pred for g in language_id.identify(frame(spark, [rows[-1][1], rows[0][1]]), model).orderBy("doc_id").collect()] == ["cc", "aa"]
