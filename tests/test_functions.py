import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import text as X


def one(spark, column, *values, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in frame.orderBy("i").select(column).collect()]


def test_masks_numbers_like_a_callback(spark):
    texts = ["price 12,345 or $9,999 or 500 dollars", "F-150 911 299 300 300000 300001 1234567", "x123 123x 1.234 12,34 (4500)", "", None, "año 2020, ６５４ 1,000,000"]
    bare = re.compile(X.BARE_NUMBER.removeprefix("(?U)"))
    money = re.compile(r"(?:[$＄]\s?[\d][\d,.]*)|(?:\b[\d][\d,.]*\s?(?:dollars?|usd|万円|円)\b)", re.I)

    def want(t):
        if t is None:
            return None
        put = lambda m: "<NUMBER>" if X.MASK_LOW <= int(m[1].replace(",", "")) <= X.MASK_HIGH else m[0]
        return bare.sub(put, money.sub("<AMOUNT>", t))

    assert one(spark, X.mask_amounts(F.col("x")), *texts[:5]) == [want(t) for t in texts[:5]]


def test_text_helpers(spark):
    x = F.col("x")
    assert one(spark, X.tokens(x), "a/b・c,d、e|f｜g  h", None, " / ") == [list("abcdefgh"), [], []]
    assert one(spark, X.truncated(x, 3), "abc", "abcd", None) == ["abc", "abc... (1 more characters omitted)", None]
    assert one(spark, X.normalised(x), "  A  b\tC ", None) == ["a b c", ""]
    assert one(spark, X.composite_key(x, F.lit("Z")), "A b", "", None) == ["a b | z", "", ""]
    assert one(spark, X.parsed_number(x), "28,500", " 1.5 ", "nan", "inf", "x", None) == [28500.0, 1.5, None, None, None, None]
    assert one(spark, X.boolean_number(x), " Yes", "F", "?", None) == [1.0, 0.0, None, None]
    assert one(spark, X.char_ngrams(x, 2, 3), "ab", "", None) == [[" a", "ab", "b ", " ab", "ab "], [], []]
    assert len(set(one(spark, X.fingerprint(x, F.lit("k")), "a", None, "", "~"))) == 4
    assert one(spark, X.looks_like_date(x), "2020-01-31", "31/01/2020", "1-2-x", "20200131") == [True, True, False, False]


def test_arrays(spark):
    row = spark.range(1).select(
        A.repaired(F.array(F.lit(-1.0), F.lit(0.0)), 2, F.lit(1)).alias("hot"), A.repaired(F.array(F.lit(1.0), F.lit(3.0)), 2, F.lit(0)).alias("scaled"),
        A.argmax(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4))).alias("best"), A.total_variation(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.5), F.lit(0.5))).alias("tv"),
        A.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("zero"), A.weighted_average([F.lit(2.0), F.lit(4.0)], [F.lit(-1.0), F.lit(0.0)]).alias("first"),
    ).first()
    assert (row.hot, row.scaled, row.best, row.tv, row.zero, row.first) == ([0.0, 1.0], [0.25, 0.75], 1, 0.5, 0.0, 2.0)
    with pytest.raises(TypeError):
        A.weighted_average()
