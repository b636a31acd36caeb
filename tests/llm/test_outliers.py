import random
import re

import pytest

from quorumlens.llm import outliers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        len(lines), len(lines) - len(set(lines)), len(covered),
    )


TEXTS = [
    None, "", " \n\t ", "one", "a b", "a b c", "a b c a b c", "a a a a", "a a a b a a a", "x\n\nx\n \n \nx y\n",
    "\x0b\x0cé \U0001f600#$   z y <|>&*%", "a b c d a b c e a b d a b c " * 50,
]


def test_statistics(spark):
    rnd = random.Random(3)
    texts = TEXTS + ["".join(rnd.choice("ab c\n#") for _ in range(n)) for n in range(0, 400, 7)]
    texts.append(" ".join(rnd.choice("abcdefghijklmnop") + rnd.choice("xyz") for _ in range(30_000)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    found = {r.doc_id: tuple(r[n] for n in names) for r in outliers.described(df).collect()}
    for i, text in enumerate(texts):
        assert found[i] == brute(text), text


def prose(rnd, n, junk=False):
    words = ["".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 9))) for _ in range(n)]
    return " ".join(w + "###" for w in words) if junk else " ".join(words)


def test_junk_goes_and_prose_stays(spark):
    rnd = random.Random(5)
    rows = [(i, prose(rnd, rnd.randint(60, 900), i % 10 == 0), "en" if i % 3 else None, "s%d" % (i % 2), i) for i in range(400)]
    rows += [(1000, None, None, None, 0), (1001, "few words", "xx", "rare", 0), (None, rows[1][1], "en", "s1", 0)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string, kept int")
    found = {r.doc_id: r.kept for r in outliers.judged(df).collect()}
    assert len(found) == len(rows)
    for i, *_ in rows[:400]:
        assert found[i] == bool(i % 10)
    assert found[None] and not found[1000] and not found[1001]


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s")], "doc_id int, text string, lang string, source string")
    plan = outliers.judged(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id int, text string, lang string, source string")
    assert outliers.judged(df).count() == 0


@pytest.mark.parametrize("n", [1, 3])
def test_few_rows(spark, n):
    df = spark.createDataFrame([(i, "word " * 30 + prose(random.Random(i), 90), "en", "s") for i in range(n)], "doc_id int, text string, lang string, source string")
    assert outliers.judged(df).count() == n
