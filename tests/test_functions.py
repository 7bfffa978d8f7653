"""Golden values, edge cases and properties of the scalar functions."""

import random

import pytest
from pyspark.sql import functions as F

from linkspark.functions import keys, similarity, text, typed, units
from linkspark.functions.registry import SIMILARITIES, Comparison, ComparisonSpec, register

GOLDEN = [
    ("jones", "johnson", 0.272727, 0.428571, 0.790476, 0.832381, 0.571429, 0.428571),
    ("michelle", "michael", 0.416667, 0.588235, 0.869048, 0.921429, 0.750000, 0.625000),
    ("shackleford", "shackelford", 0.600000, 0.750000, 0.969697, 0.981818, 1.000000, 0.818182),
    ("mohamed", "demahom", 0.000000, 0.000000, 0.630952, 0.630952, 1.000000, 0.142857),
    ("abc", "abcd", 0.500000, 0.666667, 0.916667, 0.933333, 0.750000, 0.750000),
    ("ab", "abc", 0.400000, 0.571429, 0.888889, 0.900000, 0.666667, 0.666667),
    ("a", "b", 0, 0, 0, 0, 0, 0),
    ("martha", "marhta", 0.400000, 0.571429, 0.944444, 0.961111, 1.000000, 0.666667),
    ("cdbcacb", "abadbab", 0.166667, 0.285714, 0.589286, 0.589286, 0.571429, 0.285714),
    ("any", "", 0, 0, 0, 0, 0, 0),
    ("x", "x", 1, 1, 1, 1, 1, 1),
]
FNS = ("jaccard", "dice", "jaro", "jaro_winkler", "bag", "edit")


def one(spark, *cols, rows=None, schema="a string, b string"):
    df = spark.createDataFrame(rows, schema) if rows else spark.range(1)
    return df.select(*cols).collect()


def test_golden_similarities(spark):
    rows = one(spark, *(SIMILARITIES[f](F.col("a"), F.col("b")).alias(f) for f in FNS), rows=[g[:2] for g in GOLDEN])
    for g, r in zip(GOLDEN, rows, strict=True):
        assert [round(r[f], 6) for f in FNS] == [round(float(x), 6) for x in g[2:]], g[:2]


def brute_jaro(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1

    def assigned(x, y):
        y, out = list(y), []
        for i, c in enumerate(x):
            for j in range(max(0, i - reach), min(i + reach + 1, len(y))):
                if y[j] == c:
                    out.append(c)
                    y[j] = None
                    break
        return out

    p, q = assigned(a, b), assigned(b, a)
    m = (len(p) + len(q)) / 2
    if not m:
        return 0.0
    t = sum(x != y for x, y in zip(p, q)) / 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def test_jaro_against_brute_force_and_properties(spark):
    rnd = random.Random(1)
    rows = [("".join(rnd.choices("abcdé", k=rnd.randint(0, 9))), "".join(rnd.choices("abcdé", k=rnd.randint(0, 9)))) for _ in range(1500)]
    got = one(spark, "a", "b", *(SIMILARITIES[f](F.col("a"), F.col("b")).alias(f) for f in FNS), *(SIMILARITIES[f](F.col("b"), F.col("a")).alias(f"{f}_r") for f in FNS), rows=rows)
    for r in got:
        assert abs(r.jaro - brute_jaro(r.a, r.b)) < 1e-9
        for f in FNS:
            assert 0 <= r[f] <= 1 and abs(r[f] - r[f"{f}_r"]) < 1e-9
        assert r.jaccard <= r.dice + 1e-12 and r.jaro_winkler >= r.jaro - 1e-12
        if r.a and r.a == r.b:
            assert all(r[f] == 1 for f in FNS)


def test_nulls_give_zero(spark):
    rows = one(spark, *(SIMILARITIES[f](F.col("a"), F.col("b")).alias(f) for f in (*FNS, "exact")), rows=[(None, "x"), ("x", None), (None, None), ("", "")])
    assert all(v == 0 for r in rows for v in r)
    r = one(spark, *(similarity.ratio(F.lit(a).cast("double"), F.lit(b).cast("double")) for a, b in ((0, 0), (0, 5), (-2, 2), (2, 4), (-2, -4), (None, 1))))[0]
    assert list(r) == [1, 0, 0, 0.5, 0.5, 0]


def test_qgram_paddings(spark):
    r = one(spark, text.qgrams(F.lit("ab")).alias("s"), text.qgrams(F.lit("")).alias("e"), text.qgrams(F.lit(""), 2, "reference").alias("r"), text.qgrams(F.lit(None).cast("string")).alias("n"), text.qgrams(F.lit("abcab"), 3, "none").alias("p"), text.qgrams(F.lit("a"), 3, "none").alias("q"))[0]
    assert r.s == ["#a", "ab", "b#"] and r.e == [] and r.n == [] and len(r.r) == 2 and r.p == ["abc", "bca", "cab"] and r.q == []


def test_typed_features(spark):
    c = lambda v: F.lit(v).cast("string")
    r = one(
        spark, typed.num_equal(c("1.0"), c("1")), typed.num_equal(c("x"), c("1")), typed.abs_diff(c("3"), c("5")), typed.abs_diff(c("nan"), c("5")),
        typed.norm_sim(c("3"), c("5"), F.lit(0.0), F.lit(10.0)), typed.word_jaccard(c("a b"), c("b  c")), typed.letter_jaccard(c("ab"), c("bc")),
        typed.relaxed_jaccard(c("color red"), c("colour blue")), typed.containment(c("a b"), c("a b c")), typed.containment(c("ab"), c("abc d")),
        typed.levenshtein_sim(c("ab"), c("ac")), typed.missing_flag(c(""), c("a")), typed.overlap(c("a"), c("a")), typed.overlap(c(None), c("a")),
    )[0]
    want = [1, -1, 2, -1, 0.8, 1 / 3, 1 / 3, 1 / 3, 1, 1, 0.5, 1, 1, -1]
    assert [round(x, 6) for x in r] == [round(x, 6) for x in want]


@pytest.mark.parametrize("word,key", [("tymczak", "t520"), ("robert", "r163"), ("rupert", "r163"), ("ashcraft", "a261"), ("pfister", "p123"), ("lee", "l000"), ("peter", "p360"), ("smith", "s530"), ("smyth", "s530"), ("a", "a000"), ("", "")])
def test_phonetic(spark, word, key):
    assert one(spark, keys.phonetic(F.lit(word)))[0][0] == key


def test_slk_and_compound_keys(spark):
    r = one(spark, keys.slk(F.lit("smith-jones"), F.lit("anna"), F.lit("3/11/1990"), F.lit("f")), keys.slk(F.lit(""), F.lit(""), F.lit("13/1/1990"), F.lit("x")), keys.slk(F.lit("li"), F.lit("a"), F.lit("1/1/2000"), F.lit("m")), keys.conjunctive(F.lit("ab"), F.lit("c")), keys.disjunctive(F.lit("x"), F.lit(None)))[0]
    assert r[0] == "mihnn031119902" and r[1] == "99999130119909" and r[2] == "i22010120001" and r[3] == "abc" and r[4] == ["0x", "1"]


def test_units(spark):
    c = F.lit
    r = one(spark, units.pounds(c("8 oz")), units.pounds(c("3 lbs")), units.pounds(c("3 kg")), units.grams(c("2 lb")), units.grams(c("12gr")), units.dimension_part(c("10x20x30 mm"), 1), units.dimension_part(c("10x20 mm"), 1), units.dimension_part(c("10x20"), 1), units.mm_to_cm(c("about 55 mm")), units.mm_to_cm(c("none")), units.to_cm(c("2 in")), units.to_cm(c("7 cm")), units.to_cm(c("w 3.5")), units.sensor(c("CMOS")), units.sensor(c("x")), units.seconds(c("3:05")), units.seconds(c("3m 05sec")), units.seconds(c("215000")), units.seconds(c("2.5")), units.seconds(c("x")))[0]
    assert list(r) == ["0.50", "3", "Invalid", 907.184, 12.0, "20 mm", None, "Invalid", 5.5, 0.0, 5.08, 7.0, 3.5, "CMOS", None, 185.0, 185.0, 215.0, 250.0, None]
    m = one(spark, units.dimensions(c('2.5" d 3 w 4h 9 d')))[0][0]
    assert m == {"d": "9", "w": "3", "h": "4"}
    d = one(spark, *(units.parse_date(c(x)).cast("string") for x in ("2020-01-31", "31/01/2020", "31.01.2020", "January 5, 2020", "nothing")))[0]
    assert list(d) == ["2020-01-31", "2020-01-31", "2020-01-31", "2020-01-05", None]
    v = one(spark, *(units.disagreement(F.array(*(F.lit(x) for x in vs))) for vs in ((1, 1, 1), (0, 1, 1), (1, 0, 1, 1))), units.in_nested(F.array(F.array(F.lit(1)), F.array(F.lit(2))), F.lit(2)))[0]
    assert list(v) == [0.0, 1.0, 0.25, True]


def test_texts(spark):
    r = one(spark, text.flatten_property(F.lit("[Foo-Bar!, x]")), text.flatten_property(F.lit("[null]")), text.flatten_property(F.lit(None).cast("string")), text.url_domain(F.lit("https://a.b/c")), text.url_domain(F.lit("https://a.b?c")), text.url_domain(F.lit("https://a.b")), text.tf_map(F.array(F.lit("a"), F.lit("b"), F.lit("a"))), text.weigh(F.create_map(F.lit("a"), F.lit(2)), F.create_map(F.lit("a"), F.lit(0.5))))[0]
    assert list(r) == ["Foo Bar", "", "", "https://a.b", "https://a.b", None, {"a": 2, "b": 1}, {"a": 1.0}]
    c = one(spark, similarity.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))), similarity.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), similarity.cosine_maps(F.create_map(F.lit("a"), F.lit(1.0)), F.create_map(F.lit("a"), F.lit(2.0))))[0]
    assert abs(c[0] - 0.70710678) < 1e-6 and c[1] == 0 and c[2] == 1


def test_specification(spark):
    register("same_length", lambda a, b: (F.length(a) == F.length(b)).cast("double"))
    spec = ComparisonSpec([Comparison("dice", "name"), Comparison("same_length", "name", "title"), Comparison("exact", "absent")])
    made = spec.prepare(spark.createDataFrame([("ab", "cd")], "name string, title string"))
    assert made.select(spec.features(F.col, F.col).alias("f")).first().f == [1.0, 1.0, 0.0]
