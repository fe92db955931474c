"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.phrases import SQL as PHRASES
from tessera.llm.spelling import SQL as SPELLING


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm._fit import remainder
    from tessera.llm.toxicity import fit_lexicon, score_toxicity

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    part = remainder(F.col("doc_id"), 5)
    scored = score_toxicity(docs, fit_lexicon(docs, labels, usable=part != 0), least=0.5)
    return scored.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "score", "predicted", "hits")


TOKENIZER = "byte_bpe_50k.json"


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), limit=512)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.minhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.line_dedup import dedup_lines

    kept = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import plan_mix

    return plan_mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm._fit import remainder
    from tessera.llm.quality_crf import fit_quality, score_quality

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    part = remainder(F.col("doc_id"), 4)
    scored = score_quality(docs, fit_quality(docs, labels, usable=part != 2), least=0.7)
    return scored.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.license_scan import scan_licenses

    found = scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op9_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.bpe import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_chroma_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips found among recordings.  No table holds audio, so turns of conversations are rendered as tones.

    Recordings: all turns.  Queries: of every twentieth conversation each turn
    recorded again, with noise, without its first words: 3 words and a 32nd part
    of the fourth are missing, so a right match starts 3 frames late.
    """
    from tessera.llm.chroma import align, clipped, fingerprints, spoken

    turns = _table(spark, sf_dir, "conversations")
    keys = ("conv_id", "turn")
    asked = fingerprints(turns.filter("conv_id % 20 = 0"), F.col("text"), clipped, keys)
    return align(asked, fingerprints(turns, F.col("text"), spoken, keys), keys, k=1, own=True)


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.phrases import collocations

    return collocations(_table(spark, sf_dir, "documents"), longest=3, least=10, percent=50, top=2000)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import KINDS, find_personal, fit_tagger, listed

    docs = _table(spark, sf_dir, "documents")
    found = find_personal(docs, fit_tagger(docs), least=0.9)
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = {k})) as long)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.spelling import spelling_groups

    return spelling_groups(_table(spark, sf_dir, "documents"), least_letters=6, least_count=5, ratio=5, every=199)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_topk_search": op4_topk_search,
    "op5_line_dedup": op5_line_dedup,
    "op6_source_mixing": op6_source_mixing,
    "op7_quality_crf": op7_quality_crf,
    "op8_license_scan": op8_license_scan,
    "op9_bpe_coding": op9_bpe_coding,
    "op10_chroma_align": op10_chroma_align,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_personal_data": op12_personal_data,
    "op13_spelling_groups": op13_spelling_groups,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _license_sql() -> str:
    from tessera.llm.license_scan import BASE, TEMPLATES, needed, words_of

    rows = []
    for number, (phrase, label, base) in enumerate([(p, v, "true") for p, v in BASE.items()] + [(p, v, "false") for p, v in TEMPLATES.items()]):
        words = words_of(phrase)
        n = len(words) - 1
        rows += [f"('{a} {b}', {number}, {i}, {n}, {n if base == 'true' else needed(n, 0.85)}, '{label}', {base})" for i, (a, b) in enumerate(zip(words, words[1:]))]
    return f"""WITH t(pair, template, t_pos, n_pairs, needed, label, is_base) AS (VALUES {", ".join(rows)}),
      w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
      g AS (SELECT r, ws, unnest(generate_series(1, len(ws) - 1)) AS i FROM w),
      h AS (SELECT r, i - 1 AS pos, t.* FROM g JOIN t ON t.pair = ws[i] || ' ' || ws[i + 1]),
      v AS (SELECT DISTINCT r, template, is_base, pos - t_pos AS diagonal FROM h),
      o AS (SELECT *, CASE WHEN is_base OR lag(diagonal) OVER q IS NULL OR diagonal - lag(diagonal) OVER q > 2 THEN 1 ELSE 0 END AS opens FROM v WINDOW q AS (PARTITION BY r, template ORDER BY diagonal)),
      s AS (SELECT *, sum(opens) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM o),
      m AS (SELECT h.r, h.template, span, min(h.pos - h.t_pos) AS start, any_value(h.label) AS label, any_value(h.is_base) AS is_base, count(DISTINCT h.t_pos) AS n_seen, any_value(needed) AS needed, count(DISTINCT h.t_pos)::DOUBLE / any_value(n_pairs) AS coverage,
        bool_or(h.t_pos = n_pairs - 1) AND bool_or(h.t_pos = greatest(n_pairs - 2, 0)) AS ends FROM h JOIN s ON h.r = s.r AND h.template = s.template AND h.pos - h.t_pos = s.diagonal GROUP BY ALL),
      f AS (SELECT * FROM m WHERE n_seen >= needed AND ends)
      SELECT doc_id, len(any_value(ws))::BIGINT AS n_words, count(*) FILTER (is_base) AS n_base, min(start) FILTER (is_base) AS first_word, max(start) FILTER (is_base) AS last_word,
      coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(coverage), 0)::DOUBLE AS score
      FROM w LEFT JOIN f USING (r) GROUP BY r, doc_id"""


ORACLE: dict[str, str] = {
    "op3_minhash_dedup": rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
      s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM d),
      u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
      l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id != b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
      r(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON r.other = l.a),
      c AS (SELECT id, min(other) AS component_id FROM r GROUP BY id)
      SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON doc_id = id""",
    "op4_topk_search": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id != c.vec_id),
      r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s) SELECT * FROM r WHERE rank <= 20""",
    "op5_line_dedup": f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
      k AS (SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
      f AS (SELECT k, max(doc_id) AS top FROM k WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
      m AS (SELECT doc_id, i, line, top IS NOT NULL AND doc_id != top AS gone FROM k LEFT JOIN f USING (k))
      SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op6_source_mixing": r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
      s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source),
      w AS (SELECT *, [5, 2, 1][n % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s), f AS (SELECT *, cap / w AS "full" FROM w),
      b AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS rest_w FROM f WINDOW o AS (ORDER BY "full", source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      v AS (SELECT *, max(CASE WHEN rest / rest_w <= "full" THEN rest / rest_w END) OVER () AS level FROM b),
      t AS (SELECT source, source_size, CASE WHEN level IS NULL OR "full" <= level THEN cap ELSE level * w END AS target FROM v),
      r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, ('0x' || substr(md5('17:' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS draw FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
      SELECT doc_id, size, source_size, target, ((floor(rate) + (draw < rate - floor(rate))::INT) * size)::BIGINT AS taken FROM r""",
    "op8_license_scan": _license_sql(),
    "op11_phrase_mining": PHRASES,
    "op13_spelling_groups": SPELLING,
}
