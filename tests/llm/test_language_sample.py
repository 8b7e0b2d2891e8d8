"""op5: the sample of six languages of very unequal size, one of them mostly copies."""

from collections import Counter

from cliplens.llm.language import sample, train

SIZES = {"aa": 12000, "bb": 5000, "cc": 2000, "dd": 900, "ee": 150, "ff": 40}


def test_every_language_gets_its_share(spark):
    rows = [(lang, f"{lang * 3} text {i}") for lang, n in SIZES.items() for i in range(n)]
    rows += [("bb", "one text that stands very often")] * 20000 + [("ff", f"{i}") for i in range(3000)]
    learn = spark.createDataFrame(rows, "lang string, text string").repartition(8)
    taken = [(r["lang"], r["text"]) for r in sample(learn, 1200).collect()]
    assert len(set(taken)) == len(taken)
    assert Counter(lang for lang, _ in taken) == {lang: min(200, n) for lang, n in SIZES.items()}
    model = train(learn, 1200)
    names, _ = model.predict([f"{lang * 3} text 7" for lang in SIZES])
    assert names == list(SIZES)
