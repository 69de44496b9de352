"""Golden cases of the text rules."""

import pytest
from pyspark.sql import functions as F

from parlance.functions import arrays
from parlance.functions import text as T
from parlance.operators import assembly
from parlance.sources.tables import glossary


def each(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", f(F.col("t")).alias("o")).collect()
    return [r.o for r in sorted(rows, key=lambda r: r.i)]


CASES = [
    ("I want to", True), ("The way", True), ("I was thinking about", True), ("This really matters.", False), ("This really matters", False),
    ("", True), (None, True), ("I think...", True), ("well,", True), ("because it was late", True), ("No", False), ("123", True), ("Tengo una idea", False), ("está", True),
]


def test_incomplete(spark):
    got = each(spark, [c for c, _ in CASES], T.likely_incomplete)
    assert got == [w for _, w in CASES]
    assert [assembly.incomplete(c) for c, _ in CASES] == got


def test_completion_score(spark):
    cases = [("Hello.", 800, False, 0.8, 0.7551), ("I think...", 700, False, 1.0, 0.2721), ("This clause is complete", 300, False, 0.8, 0.3897), ("This clause is complete", 1000, False, 0.8, 0.6157)]
    cases += [("Exactly.", 700, False, 0.5, 0.7285), ("I want to", 0, True, 0.1, 0.1753), ("It works.", 0, False, 1.0, 0.4613), ("It works.", 250, False, 1.0, 0.5413), ("It works", 650, False, 1.0, 0.5523), ("It works", 899, False, 0.0, 0.6127)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, p int, c boolean, s double, want double")
    for r in df.withColumn("got", T.completion_score(F.col("t"), F.col("p"), F.col("c"), F.col("s"))).collect():
        assert r.got == pytest.approx(r.want, abs=1e-4)
        assert assembly.score(r.t, r.p, r.c, r.s) == pytest.approx(r.want, abs=1e-4)


def test_repairs(spark):
    texts = ["I think the the the person was right.", "I wanna see what is gonna happen.", ", hello world -", "plain", "bare in mind, a peace of cake", None, "looking outside for fresh air", "of of course"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.repaired.text for r in T.with_repairs(df, "t").orderBy("i").collect()] == ["I think the person was right.", "I want to see what is going to happen.", "hello world", "plain", "bear in mind, a piece of cake", "", "walking outside for fresh air", "of course"]
    assert each(spark, ["hola hola hola cómo estás estás bien", "we go there we go there now"], T.drop_repetitions) == ["hola cómo estás bien", "we go there now"]
    assert each(spark, ["I am kind of just trying to be helpful", "Well, it is, like, fine", "So, he is sort of running"], T.spoken) == ["I am just trying to be helpful", "It is, fine", "He is running"]


def test_glossary(spark):
    terms = glossary('{"cat": "gato", "server": "servidor", "server room": "sala", "__note": "x", "c++": "cpp$"}')
    texts = ["The cat saw a caterpillar, Cat CAT", "SERVER Server server sErver", "the server room", "c++ and xc++", "gátcat"]
    assert each(spark, texts, lambda c: T.apply_glossary(c, terms)) == ["The gato saw a caterpillar, Gato GATO", "SERVIDOR Servidor servidor servidor", "the sala", "cpp$ and xc++", "gátcat"]
    assert glossary("broken") == {} and "__note" not in terms
    rows = spark.createDataFrame([("SERVER", "servidor"), ("Server", "servidor"), ("server", "Servidor"), ("sERVER", "serVidor")], "a string, b string")
    assert [r.o for r in rows.select(T.keep_case(F.col("a"), F.col("b")).alias("o")).collect()] == ["SERVIDOR", "Servidor", "servidor", "serVidor"]


def test_small_functions(spark):
    assert each(spark, ["59.9996", "3661.5", "-1", "360000"], lambda c: T.timestamp(c.cast("double"))) == ["00:01:00,000", "01:01:01,500", "00:00:00,000", "100:00:00,000"]
    assert each(spark, ["a & <b> \"c\" 'd'"], T.html_escape) == ["a &amp; &lt;b&gt; &quot;c&quot; &#x27;d&#x27;"]
    assert each(spark, ["en", "es", "auto", None, "Es "], lambda c: T.model_for_language(F.lit("small.en"), c)) == ["small.en", "small", "small", "small", "small"]
    checks = [("ok words here", 0.9, -0.2, 0.1, "ok"), ("", 0.1, -3.0, 0.9, "empty"), ("x", 0.9, -0.2, 0.7, "no_speech"), ("x", 0.9, -1.3, 0.1, "logprob"), ("x", 0.4, 0.0, 0.1, "confidence"), ("xkcdqwrt now", 0.9, 0.0, 0.0, "unpronounceable"), ("rhythm", 0.9, 0.0, 0.0, "ok")]
    df = spark.createDataFrame(checks, "t string, c double, l double, n double, want string")
    assert all(r.got == r.want for r in df.withColumn("got", T.anomaly(F.col("t"), F.col("c"), F.col("l"), F.col("n"))).collect())


def test_arrays(spark):
    df = spark.createDataFrame([([0.6, 0.8], [0.6, 0.8]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0], [1.0, 0.0]), ([], [])], "a array<double>, b array<double>")
    got = df.select(arrays.similarity(F.col("a"), F.col("b")).alias("s"), arrays.energy(F.col("a")).alias("e"), arrays.mixed(F.col("a"), F.col("b")).alias("m")).collect()
    assert [r.s for r in got] == pytest.approx([1.0, 0.0, 0.0, 0.0]) and got[0].e == pytest.approx(0.5**0.5) and got[3].e == 0
    assert got[0].m == pytest.approx([1.0, 1.0]) and got[2].m == pytest.approx([1.0])


def test_all_white_space_is_cut(spark):
    from parlance.functions.text import strip

    rows = [("\n a\tb  \n", "a\tb"), ("", ""), (None, None), (" \n", "")]
    assert [r.got for r in spark.createDataFrame(rows, "t string, want string").select(strip(F.col("t")).alias("got")).collect()] == [w for _, w in rows]
