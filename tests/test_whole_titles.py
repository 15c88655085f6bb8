"""Titles are compared whole and in all scripts."""

from citetrace.operators import seeds


def test_title_keys(spark):
    long = "a word " * 40
    titles = [long + "one", long + "two", "Война и мир!", "война  и МИР", "源氏物語", "हिन्दी", "हन्द", " -- ", None, "The Title: 2nd"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string")
    got = {r.i: r.k for r in df.select("i", seeds.title_key(df.t).alias("k")).collect()}
    assert got[0] != got[1] and got[2] == got[3] == "война и мир" and got[4] == "源氏物語" and got[5] != got[6]
    assert got[7] is None and got[8] is None and got[9] == "the title 2nd"
