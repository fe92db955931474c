import math
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tessera.functions import stats, text as X


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'bigint'}" for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("kind", "raw", "want"),
    [
        ("common", "  Đặt  báo\tthức ", "dat bao thuc"), ("student", "Đặt báo thức 6 giờ!", "t bo thc 6 gi"), ("leak", " Gọi, mẹ! ", "goi me"),
        ("split", "Gọi...mẹ--nhé", "goi me nhe"), ("bench", " Gọi  mẹ! ", "goi me!"), ("fresh", "a@b.vn; 09-12", "a@b.vn  09-12"), ("kfd", "Đường", "Đuong"), ("common", "", ""),
    ],
)
def test_normalizers(spark, kind, raw, want):
    assert one(spark, X.normalize(F.col("t"), kind), t=raw) == want


def test_ngrams_and_jaccard(spark):
    assert one(spark, X.char_ngrams(F.col("t")), t="abab") == ["aba", "bab"]
    assert one(spark, X.char_ngrams(F.col("t")), t="ab") == ["ab"]
    assert one(spark, X.char_ngrams(F.col("t")), t="a\nb😀") == ["a\nb", "\nb😀"]
    empty = F.array().cast("array<string>")
    assert one(spark, X.jaccard(empty, empty), t="") == 1.0
    assert one(spark, X.jaccard(empty, F.array(F.lit("a"))), t="") == 0.0
    assert one(spark, X.jaccard(X.token_set(F.col("t")), X.token_set(F.lit("a c"))), t=" a  b ") == pytest.approx(1 / 3)


def test_seq_ratio_keeps_order(spark):
    a, b = "tide", "diet"
    assert one(spark, X.seq_ratio(F.col("a"), F.col("b")), a=a, b=b) == SequenceMatcher(None, a, b).ratio()
    assert one(spark, X.seq_ratio(F.col("b"), F.col("a")), a=a, b=b) == SequenceMatcher(None, b, a).ratio()
    assert one(spark, X.seq_ratio_bound(F.col("a"), F.col("b")), a="abcd", b="ab") == pytest.approx(2 / 3)


def test_json(spark):
    get = lambda t, path="$.tool": one(spark, F.try_variant_get(X.extract_json(F.col("t")), path, "string"), t=t)
    assert get('so: {"tool": "call"} then') == "call"
    assert get("nothing", "$.status") == "rejected"
    assert get('{"tool": "a"} }', "$.status") == "rejected"
    assert one(spark, F.to_json(X.strict_json(F.col("t"))), t="5") == "5"
    assert one(spark, X.strict_json(F.col("t")).isNull(), t="1], [2")
    assert one(spark, X.strict_json(F.col("t")).isNull(), t="")


def test_times_and_durations(spark):
    assert tuple(one(spark, X.parse_time(F.col("t")), t="2 giờ chiều")) == (14, 0)
    assert tuple(one(spark, X.parse_time(F.col("t")), t="tôi dậy 5 giờ")) == (5, 0)
    assert one(spark, X.parse_time(F.col("t")), t="mai") is None
    assert tuple(one(spark, X.parse_duration(F.col("t")), t="hẹn 15 phút")) == (15, "minutes")


def test_names(spark):
    assert one(spark, X.contact_name(F.col("t")), t="anh_Minh") == "Minh"
    assert one(spark, X.contact_name(F.col("t")), t="anh") == "anh"
    assert one(spark, X.phone_digits(F.col("t")), t="+84 9-1") == "8491"


@pytest.mark.parametrize(("b", "c", "p"), [(16, 8, 0.15158963), (43, 12, 3.30538e-05), (0, 0, 1.0), (5, 5, 1.0), (0, 3, 0.25)])
def test_mcnemar(spark, b, c, p):
    assert one(spark, stats.mcnemar_exact(F.col("b"), F.col("c")), b=b, c=c) == pytest.approx(p, rel=1e-5)


def test_mcnemar_is_stable_for_large_counts(spark):
    assert one(spark, stats.mcnemar_exact(F.col("b"), F.col("c")), b=3000, c=3050) == pytest.approx(0.5286, abs=5e-3)


def test_wilson(spark):
    assert one(spark, stats.wilson_text(F.col("k"), F.col("n")), k=71, n=126) == "[0.476, 0.647]"
    assert one(spark, stats.wilson_text(F.col("k"), F.col("n")), k=0, n=0) == "N/A"
    assert one(spark, stats.wilson_array(F.col("k"), F.col("n")), k=0, n=0) == [0.0, 0.0]
    low, high = (one(spark, c, k=3, n=7) for c in stats.wilson(F.col("k"), F.col("n")))
    assert 0 <= low <= 3 / 7 <= high <= 1


def test_normal_p(spark):
    assert one(spark, stats.normal_p(F.col("z")), z=1.96) == pytest.approx(math.erfc(1.96 / math.sqrt(2)))


def test_sql_functions(spark):
    from tessera.sql import register

    register(spark)
    r = spark.sql("SELECT norm('  Đặt  BÁO ') n, mcnemar_exact(16L, 8L) p, wilson_lo(71D, 126D) lo, wilson_hi(71D, 126D) hi, jaccard3('abcd', 'bcde') j, seq_ratio('abcd', 'bcde') s, tokens('a b@c') t").first()
    assert (r.n, r.t, r.s, r.j) == ("dat bao", ["a", "b@c"], 0.75, pytest.approx(1 / 3))
    assert (r.p, r.lo, r.hi) == (pytest.approx(0.15158963, rel=1e-6), pytest.approx(0.476, abs=5e-4), pytest.approx(0.647, abs=5e-4))
