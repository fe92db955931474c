"""Queries on leakage between benchmark items and documents, over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import char_ngrams, normalize, token_set
from tessera.operators import leakage as L
from tessera.operators import sequences as S
from tessera.operators import validate as V
from tessera.plans._tables import table, texts


def _sides(spark: SparkSession, sf_dir: str, kind: str, make) -> tuple[DataFrame, DataFrame]:
    docs = texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), make(normalize(F.col("text"), kind)).alias("tokens"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref"), make(normalize(F.col("text"), kind)).alias("tokens"))
    return docs, items


#: Leaks planted beside the documents, so that there is something to find: every seventh item as a document of its own
#: and as a line of one, and copies of every 50th document with a word behind.
PLANTED = 10_000_000


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, sf_dir, "benchmark")
    whole = items.filter("item_id % 7 = 0").select((F.col("item_id") + PLANTED).alias("id"), F.concat(F.lit(" ("), "text", F.lit(") !")).alias("text"))
    inside = items.filter("item_id % 7 = 1").select((F.col("item_id") + PLANTED).alias("id"), F.concat(F.lit("first line\n"), "text", F.lit("\nlast line")).alias("text"))
    return docs.unionByName(whole).unionByName(inside)


def _near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs.unionByName(docs.filter("id % 50 = 0").select((F.col("id") + PLANTED).alias("id"), F.concat("text", F.lit(" zzplanted")).alias("text")))


def leak_exact(spark, sf_dir):
    key = F.md5(normalize(F.col("text"), "split"))
    docs = _documents(spark, sf_dir).select("id", key.alias("key"))
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("ref"), key.alias("key"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("ref"), key.alias("key"))
    return L.exact_overlap(docs, {"benchmark": items, "conversations": turns}).select("id", "ref", "target")


def leak_sentences(spark, sf_dir):
    """Benchmark items that stand in a document as a line of it."""
    lines = _documents(spark, sf_dir).select("id", F.explode(F.split("text", "\n")).alias("line")).select("id", F.md5(normalize(F.col("line"), "split")).alias("key")).distinct()
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref"), F.md5(normalize(F.col("text"), "split")).alias("key"))
    return L.exact_overlap(lines, {"benchmark": items}).select("id", "ref")


def leak_trigram_best(spark, sf_dir):
    docs, items = _sides(spark, sf_dir, "common", lambda c: char_ngrams(c, 3))
    return L.best_match_of_refs(docs, items).select("ref", "id", F.round("sim", 6).alias("sim"))


def leak_token_best(spark, sf_dir):
    docs, items = _sides(spark, sf_dir, "leak", token_set)
    return L.best_match_of_rows(docs, items).select("id", "ref", F.round("sim", 6).alias("sim"))


def leak_token_thresholds(spark, sf_dir):
    docs, items = _sides(spark, sf_dir, "leak", token_set)
    return L.threshold_counts(L.best_match_of_rows(docs, items), (1.0, 0.5, 0.2, 0.1, 0.05)).select("threshold", "n")


def leak_pairs(spark, sf_dir):
    docs, items = _sides(spark, sf_dir, "split", lambda c: char_ngrams(c, 3))
    return L.similar_pairs(docs, items, 0.25).select("id", "ref", F.round("sim", 6).alias("sim"))


def leak_peer_self(spark, sf_dir):
    """Documents whose normalised text another document has too; ``leak_peers`` finds near copies as well."""
    rows = texts(spark, sf_dir, "documents").select("doc_id", F.md5(normalize(F.col("text"), "leak")).alias("key"))
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    return rows.join(groups.filter("n > 1"), "key").select("doc_id", "n", "first")


def leak_max(spark, sf_dir):
    """The most similar pair of an item and a document."""
    docs, items = _sides(spark, sf_dir, "leak", token_set)
    return L.largest_similarity(docs, items).select("ref", "id", F.round("sim", 6).alias("sim"))


def leak_peers(spark, sf_dir):
    """Each document's most similar other document, from a similarity of 0.9 on."""
    rows = _near_copies(spark, sf_dir).select("id", token_set(normalize(F.col("text"), "leak")).alias("tokens"))
    return L.nearest_peers(rows, 0.9).select("id", "peer", F.round("sim", 6).alias("sim"))


def leak_labelled(spark, sf_dir):
    """L2: items against three targets, best match in each, equal texts labelled."""
    made = lambda t, c: t.select(F.col(c).alias("id"), normalize(F.col("text"), "bench").alias("text")).withColumn("tokens", char_ngrams(F.col("text"), 3))
    items = made(table(spark, sf_dir, "benchmark"), "item_id").withColumnRenamed("id", "ref")
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    own = table(spark, sf_dir, "benchmark").filter("item_id % 7 < 3").select((F.col("item_id") + PLANTED).alias("id"), F.when(F.col("item_id") % 7 < 2, F.concat(F.lit("\t "), "text", F.lit("  "))).otherwise(F.concat("text", F.lit(" zz"))).alias("text"))
    targets = {"documents": made(_documents(spark, sf_dir), "id"), "conversations": made(turns, "id"), "variants": made(own, "id")}
    return L.labelled_matches(items, targets, 0.6).select("ref", "target", "id", F.round("sim", 6).alias("sim"), "label")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("ref"), "role", "text")


def leak_measures_apart(spark, sf_dir):
    """L1: items against all turns of the conversations by both measures, each with its own best match."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return L.measures_apart(items, _turns(spark, sf_dir).select("ref", "text"), (1.0, 0.5, 0.3, 0.1)).select("measure", "threshold", "n")


def leak_sources(spark, sf_dir):
    """Items against the turns of each role."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    turns = _turns(spark, sf_dir)
    out = L.audit_sources(items, {r: turns.filter(F.col("role") == r).select("ref", "text") for r in ("system", "user", "assistant")})
    return out.select("source", "id", "ref", F.round("ratio", 6).alias("ratio"), F.round("gram", 6).alias("gram"), "leaks")


def frozen_audit(spark, sf_dir):
    """users' turns as training rows, items as the held-out set, lengths as classes."""
    kind = F.when(F.length("text") < 120, "short").otherwise("long").alias("kind")
    train = _turns(spark, sf_dir).filter("role = 'user'").select(F.col("ref").alias("id"), "text", kind)
    return L.frozen_audit(train, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text", kind), "kind").select("check", F.round("found", 6).alias("found"), "passed")


def held_out_least_similar(spark, sf_dir):
    """Of the items, three groups, five each that resemble turns of the users and other items least."""
    from tessera.operators.build import hold_out_least_similar

    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text", (F.col("item_id") % 3).alias("kind"))
    turns = _turns(spark, sf_dir).filter("role = 'user'").select(F.col("ref").alias("id"), "text")
    out = hold_out_least_similar(items, turns, "kind", F.lit(5))
    return out.select("id", "kind", F.round("aug_similarity", 6).alias("aug_similarity"), F.round("peer_similarity", 6).alias("peer_similarity"), "near_duplicate", "held_out")


def leak_seq_ratio(spark, sf_dir):
    """Benchmark items against every turn of the conversations by Ratcliff-Obershelp ratio, all pairs that reach 0.8; some items are planted as turns, with a word behind."""
    said = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "text")
    said = said.unionByName(table(spark, sf_dir, "benchmark").filter("item_id % 7 = 2").select(F.concat_ws("/", F.lit("planted"), "item_id").alias("id"), F.concat("text", F.lit(" zz")).alias("text")))
    turns = said.select("id", normalize(F.col("text"), "leak").alias("text"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref"), normalize(F.col("text"), "leak").alias("text"))
    return L.sequence_matches(turns, items, 0.8).select("ref", "id", F.round("ratio", 6).alias("ratio"))


def leak_seq_peers(spark, sf_dir):
    """J9 by sequence ratio: each turn's nearest other turn from 0.9 on; of every fifth conversation the turns are there twice, the second time with a word before."""
    said = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.col("conv_id").alias("c"), "text")
    said = said.unionByName(said.filter("c % 5 = 0").select(F.concat(F.lit("planted/"), "id").alias("id"), "c", F.concat(F.lit("ok "), "text").alias("text")))
    rows = said.select("id", normalize(F.col("text"), "leak").alias("text"))
    return S.nearest_by_sequence(rows, 0.9).select("id", "peer", F.round("ratio", 6).alias("ratio"))


def leak_audit(spark, sf_dir):
    """Each benchmark item's best match among the texts of all documents by sequence ratio, then trigrams."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"), "text")
    return L.audit(items, docs).select("id", "ref", F.round("ratio", 6).alias("ratio"), F.round("gram", 6).alias("gram"), "leaks")


def split_lag_leak(spark, sf_dir):
    """Turns whose text was last said in another role; every tenth conversation is there twice, the second time as the system's."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = said.unionByName(said.filter("conv_id % 10 = 0").withColumns({"conv_id": F.col("conv_id") + PLANTED, "role": F.lit("system")})).select("conv_id", "turn", "role", F.md5(normalize(F.col("text"), "student")).alias("key"))
    return V.split_leaks(rows, "key", "role", ["conv_id", "turn"]).select("conv_id", "turn", "role", "previous")


def split_disjoint(spark, sf_dir):
    """Texts that lie in both halves of the documents."""
    rows = texts(spark, sf_dir, "documents").select("doc_id", F.md5(normalize(F.col("text"), "split")).alias("key"))
    return rows.filter("doc_id % 2 = 0").select("key").intersect(rows.filter("doc_id % 2 = 1").select("key"))


QUERIES = {f.__name__: f for f in (leak_exact, leak_sentences, leak_trigram_best, leak_token_best, leak_token_thresholds, leak_pairs, leak_peer_self, leak_max, leak_peers, leak_labelled, leak_measures_apart, leak_sources, frozen_audit, held_out_least_similar, leak_seq_ratio, leak_seq_peers, leak_audit, split_lag_leak, split_disjoint)}

_FOLD = "lower(strip_accents(replace(replace({c}, 'đ', 'd'), 'Đ', 'D')))"
_COMMON = "regexp_replace(regexp_replace(" + _FOLD + r", '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"
_SPLIT = "trim(regexp_replace(" + _FOLD + ", '[^a-z0-9]+', ' ', 'g'))"
_LEAK = r"regexp_replace(regexp_replace(" + _FOLD + r", '[^a-z0-9\s]', '', 'g'), '^\s+|\s+$', '', 'g')"
_STUDENT = "trim(regexp_replace(lower({c}), '[^a-z0-9 ]', '', 'g'))"
_GRAMS = "list_distinct(list_transform(generate_series(1, greatest(length({c}) - 2, 1)), lambda i: substring({c}, i, 3)))"
_WORDS = r"list_filter(list_distinct(regexp_split_to_array(trim({c}), '\s+')), lambda x: x != '')"


def _sims(norm: str, tokens: str) -> str:
    return f"""dn AS (SELECT doc_id AS id, {norm.format(c='text')} AS t FROM documents), bn AS (SELECT item_id AS ref, {norm.format(c='text')} AS t FROM benchmark),
 dt AS (SELECT id, {tokens.format(c='t')} AS s FROM dn), bt AS (SELECT ref, {tokens.format(c='t')} AS s FROM bn),
 du AS (SELECT id, unnest(s) AS x FROM dt), bu AS (SELECT ref, unnest(s) AS x FROM bt), shared AS (SELECT id, ref, count(*) AS c FROM du JOIN bu USING (x) GROUP BY ALL),
 sim AS (SELECT d.id, b.ref, round(CASE WHEN len(d.s) = 0 AND len(b.s) = 0 THEN 1 ELSE coalesce(c, 0) / (len(d.s) + len(b.s) - coalesce(c, 0))::DOUBLE END, 9) AS sim FROM dt d CROSS JOIN bt b LEFT JOIN shared o ON o.id = d.id AND o.ref = b.ref)"""


_DOCS = f"docs AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id + {PLANTED}, ' (' || text || ') !' FROM benchmark WHERE item_id % 7 = 0 UNION ALL SELECT item_id + {PLANTED}, 'first line' || chr(10) || text || chr(10) || 'last line' FROM benchmark WHERE item_id % 7 = 1)"
_BENCH = r"regexp_replace(regexp_replace(" + _FOLD + r", '\s+', ' ', 'g'), '^ +| +$', '', 'g')"


def _labelled_sql() -> str:
    gram = _GRAMS.format(c="t")
    return f"""WITH {_DOCS}, x AS (SELECT 'documents' AS target, id, {_BENCH.format(c='text')} AS t FROM docs UNION ALL SELECT 'conversations', conv_id * 1000 + turn, {_BENCH.format(c='text')} FROM conversations
      UNION ALL SELECT 'variants', item_id + {PLANTED}, {_BENCH.format(c="CASE WHEN item_id % 7 < 2 THEN chr(9) || ' ' || text || '  ' ELSE text || ' zz' END")} FROM benchmark WHERE item_id % 7 < 3),
      b AS (SELECT item_id AS ref, {_BENCH.format(c='text')} AS t FROM benchmark), xs AS (SELECT *, {gram} AS s FROM x), bs AS (SELECT *, {gram} AS s FROM b), xu AS (SELECT target, id, unnest(s) AS g FROM xs), bu AS (SELECT ref, unnest(s) AS g FROM bs),
      o AS (SELECT ref, target, id, count(*) AS c FROM xu JOIN bu USING (g) GROUP BY ALL), m AS (SELECT o.ref, o.target, o.id, round(c / (len(xs.s) + len(bs.s) - c)::DOUBLE, 9) AS sim, xs.t = bs.t AS same FROM o JOIN xs USING (target, id) JOIN bs USING (ref)),
      r AS (SELECT *, row_number() OVER (PARTITION BY ref, target ORDER BY sim DESC, id) AS n FROM m) SELECT ref, target, id, round(sim, 6) AS sim, CASE WHEN same THEN 'EXACT' ELSE 'SIM' END AS label FROM r WHERE n = 1 AND r.sim >= 0.6"""


ORACLE = {
    "leak_max": f"WITH {_sims(_LEAK, _WORDS)} SELECT ref, id, round(sim, 6) AS sim FROM sim ORDER BY sim.sim DESC, ref, id LIMIT 1",
    "leak_peers": f"""WITH t AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT doc_id + {PLANTED}, text || ' zzplanted' FROM documents WHERE doc_id % 50 = 0), n AS (SELECT id, {_LEAK.format(c='text')} AS t FROM t), s AS (SELECT id, {_WORDS.format(c='t')} AS s FROM n),
      p AS (SELECT a.id, b.id AS peer, len(list_intersect(a.s, b.s)) AS c, len(a.s) AS x, len(b.s) AS y FROM s a JOIN s b ON a.id != b.id AND least(len(a.s), len(b.s)) >= 0.9 * greatest(len(a.s), len(b.s)) - 1e-6 AND len(a.s) > 0),
      q AS (SELECT id, peer, round(c / (x + y - c)::DOUBLE, 9) AS sim FROM p) SELECT id, peer, round(sim, 6) AS sim FROM q WHERE q.sim >= 0.9 QUALIFY row_number() OVER (PARTITION BY id ORDER BY q.sim DESC, peer) = 1""",
    "leak_labelled": _labelled_sql(),
    "leak_exact": f"WITH {_DOCS}, d AS (SELECT id, md5({_SPLIT.format(c='text')}) AS k FROM docs), r AS (SELECT item_id::VARCHAR AS ref, md5({_SPLIT.format(c='text')}) AS k, 'benchmark' AS target FROM benchmark UNION ALL SELECT conv_id::VARCHAR || '/' || turn::VARCHAR, md5({_SPLIT.format(c='text')}), 'conversations' FROM conversations) SELECT id, ref, target FROM d JOIN r USING (k)",
    "leak_sentences": f"WITH {_DOCS}, l AS (SELECT id, unnest(string_split(text, chr(10))) AS line FROM docs), d AS (SELECT DISTINCT id, md5({_SPLIT.format(c='line')}) AS k FROM l), b AS (SELECT item_id AS ref, md5({_SPLIT.format(c='text')}) AS k FROM benchmark) SELECT id, ref FROM d JOIN b USING (k)",
    "leak_trigram_best": f"WITH {_sims(_COMMON, _GRAMS)} SELECT ref, id, round(sim, 6) AS sim FROM sim QUALIFY row_number() OVER (PARTITION BY ref ORDER BY sim.sim DESC, id) = 1",
    "leak_token_best": f"WITH {_sims(_LEAK, _WORDS)} SELECT id, ref, round(sim, 6) AS sim FROM sim QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim.sim DESC, ref) = 1",
    "leak_token_thresholds": f"WITH {_sims(_LEAK, _WORDS)}, m AS (SELECT id, max(sim) AS sim FROM sim GROUP BY id) SELECT threshold, count(*) FILTER (sim >= threshold) AS n FROM m, (SELECT unnest([1.0, 0.5, 0.2, 0.1, 0.05]::DOUBLE[]) AS threshold) GROUP BY threshold",
    "leak_pairs": f"WITH {_sims(_SPLIT, _GRAMS)} SELECT id, ref, round(sim, 6) AS sim FROM sim WHERE sim.sim >= 0.25",
    "leak_peer_self": f"WITH d AS (SELECT doc_id, md5({_LEAK.format(c='text')}) AS k FROM documents), g AS (SELECT k, count(*) AS n, min(doc_id) AS first FROM d GROUP BY k HAVING count(*) > 1) SELECT doc_id, n, first FROM d JOIN g USING (k)",
    "split_lag_leak": f"WITH t AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id + {PLANTED}, turn, 'system', text FROM conversations WHERE conv_id % 10 = 0), c AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY md5({_STUDENT.format(c='text')}) ORDER BY conv_id, turn) AS previous FROM t) SELECT * FROM c WHERE previous != '' AND previous != role",
    "split_disjoint": f"SELECT md5({_SPLIT.format(c='text')}) AS key FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT md5({_SPLIT.format(c='text')}) FROM documents WHERE doc_id % 2 = 1",
}
