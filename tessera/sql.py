"""SQL functions of the library: ``register(spark)`` makes them available by name."""

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions import stats, text


def register(spark: SparkSession) -> list[str]:
    """Temporary SQL functions; all but seq_ratio expand to built-in expressions."""
    from tessera.functions.text import _BARE, _MARKED

    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    fold = f"regexp_replace(translate(s, {quote(_MARKED + 'đĐ')}, {quote(_BARE + 'dD')}), r'\\p{{Mn}}+', '')"
    z = stats.Z95
    wilson = f"greatest(0D, least(1D, ((k / n + {z * z}D / (2 * n)) {{sign}} {z}D * sqrt((k / n * (1 - k / n) + {z * z}D / (4 * n)) / n)) / (1 + {z * z}D / n)))"
    made = {
        "fold_accents(s string)": ("string", fold),
        "norm(s string)": ("string", f"regexp_replace(regexp_replace(lower({fold}), r'^\\s+|\\s+$', ''), r'\\s+', ' ')"),
        "tokens(s string)": ("array<string>", f"regexp_extract_all(norm(s), {quote(text.WORD_CHARS)}, 0)"),
        "trigrams(s string)": ("array<string>", "array_distinct(transform(sequence(1, greatest(length(s) - 2, 1)), i -> substring(s, i, 3)))"),
        "jaccard3(a string, b string)": ("double", "size(array_intersect(trigrams(a), trigrams(b))) / size(array_union(trigrams(a), trigrams(b)))"),
        "wilson_lo(k double, n double)": ("double", wilson.format(sign="-")),
        "wilson_hi(k double, n double)": ("double", wilson.format(sign="+")),
        "mcnemar_exact(b bigint, c bigint)": ("double", "least(1D, 2 * aggregate(transform(sequence(0L, least(b, c)), k -> exp(aggregate(if(k > 0, sequence(1L, greatest(k, 1L)), array()), -(b + c) * ln(2D), (a, i) -> a + ln((b + c - i + 1) / i)))), 0D, (a, x) -> a + x))"),
    }
    for head, (kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    import pandas as pd

    def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    spark.udf.register("seq_ratio", F.pandas_udf(seq_ratio, "double"))
    return [*(h.split("(")[0] for h in made), "seq_ratio"]
