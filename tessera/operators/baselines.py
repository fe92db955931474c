"""Baseline predictors: ordered keyword rules, and TF-IDF with logistic regression."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import emails, normalize, parse_duration, parse_time, phones, uris


@dataclass(frozen=True)
class Rule:
    """A call and when it applies, to the folded text.

    One of ``some``, ``starts`` or ``exact`` must hold, if there are any, all of
    ``every``, none of ``no``, and no argument of ``where`` may be empty; else the
    next rule is asked.  Where an argument of ``needs`` is missing, the rule
    applies, but asks for clarification instead.  ``arguments``: name to the name
    of an extractor, or to = and a JSON value.
    """

    tool: str | None
    some: tuple[str, ...] = ()
    every: tuple[str, ...] = ()
    no: tuple[str, ...] = ()
    starts: tuple[str, ...] = ()
    exact: tuple[str, ...] = ()
    status: str | None = None
    confirm: bool = False
    arguments: dict[str, str] = field(default_factory=dict)
    needs: tuple[str, ...] = ()
    where: tuple[str, ...] = ()


def _after(text: Column, pattern: str) -> Column:
    """The first group, trimmed; null without a match."""
    return F.when(text.rlike(pattern), F.trim(F.regexp_extract(text, pattern, 1)))


def _without(text: Column, *patterns: str) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, "")
    return F.trim(text)


def _first_of(text: Column, table: dict[str, tuple[str, ...]], otherwise: str) -> Column:
    """The first name one of whose words the folded text holds."""
    plain, out = normalize(text), None
    for name, words in table.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | plain.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def _clock(text: Column) -> Column:
    t = parse_time(text)
    return F.when(t.isNotNull(), F.concat(F.when(normalize(text).contains("mai"), "tomorrow ").otherwise(""), F.format_string("%02d:%02d", t["hour"], t["minute"])))


#: Words that name a setting, in the order they are looked for.
SETTINGS = {"wifi": ("wifi", "wi-fi"), "bluetooth": ("bluetooth",), "airplane_mode": ("may bay", "airplane"), "location": ("vi tri", "location"), "display": ("man hinh", "display"), "security": ("bao mat", "security")}

#: What rules can take from a text, null if it isn't there. The patterns are fixed values.
EXTRACTORS = {
    "hour": lambda t: parse_time(t)["hour"],
    "minute": lambda t: parse_time(t)["minute"],
    "duration": lambda t: F.concat(parse_duration(t)["amount"].cast("string"), F.lit(" "), parse_duration(t)["unit"]),
    "phone": lambda t: F.try_element_at(phones(t), F.lit(1)),
    "emails": lambda t: F.when(F.size(emails(t)) > 0, emails(t)),
    "uri": lambda t: F.try_element_at(uris(t), F.lit(1)),
    "setting": lambda t: _first_of(t, SETTINGS, "general"),
    "alarm_label": lambda t: _after(t, r"(?iu)(?:nhãn|nhan)\s+(.+)$"),
    "purpose": lambda t: _after(t, r"(?isuU)^.*?\b(?:để|de)\b(.*)$"),
    "event_title": lambda t: _without(t, r"(?iu)^(?:Thêm lịch|Thêm sự kiện)\s+", r"(?isuU)\b(?:lúc|tại)\b.*"),
    "event_place": lambda t: _after(t, r"(?iuU)\btại\s+(.+)$"),
    "event_time": _clock,
    "new_contact": lambda t: F.when(F.size(phones(t)) > 0, F.struct(_without(t, r"(?iu)^.*?thêm liên hệ\s+", r"(?isuU)\bsố\b.*").alias("name"), F.try_element_at(phones(t), F.lit(1)).alias("phone"))),
    "asked_name": lambda t: _without(_without(t, r"(?iuU)^.*?\bcủa\b|\btrong danh bạ.*$"), r"(?iu)^(?:anh|chị|chi|bạn|ban)\s+"),
    "asked_key": lambda t: F.when(normalize(t).contains("email"), "email").otherwise("phone"),
    "picked": lambda t: _first_of(t, {"EMAIL": ("email",), "PHONE": ("so dien thoai",)}, "ADDRESS"),
    "message_subject": lambda t: F.coalesce(_after(t, r"(?iu)tiêu đề\s+([^,]+)"), F.lit("")),
    "message_body": lambda t: F.coalesce(_after(t, r"(?iu)(?:rằng|rang|noi dung|nội dung)\s+(.+)$"), F.lit("")),
    "mail_subject": lambda t: _after(t, r"(?iu)(?:tiêu đề|chủ đề)\s+([^,]+)"),
    "mail_body": lambda t: _after(t, r"(?iu)nội dung\s+(.+)$"),
    "searched": lambda t: _without(t, r"(?iu)^.*?Google\s+|^.*?tìm kiếm\s+"),
    "destination": lambda t: _without(t, r"(?iu)^(?:Chỉ đường tới|chi duong toi)\s+"),
    "place": lambda t: _without(t, r"(?iu)^(?:Tìm|Tim)\s+", r"(?iu)\s+trên bản đồ$|\s+trên ban do$"),
    "file_name": lambda t: _after(t, r"(?iu)tên\s+(\S+)"),
    "text": lambda t: F.trim(t),
}

#: The tools and the words that call them. The order is part of the rules; what none takes is unsupported.
RULES = (
    Rule(None, ("pizza", "chuyen cho", "ngan hang"), status="unsupported"),
    Rule(None, exact=("mo no len", "lam di", "thuc hien no"), status="clarification"),
    Rule("open_settings", ("cai dat", "setting"), arguments={"setting_type": "setting"}),
    Rule("ACTION_SHOW_ALARMS", every=("xem", "bao thuc")),
    Rule("ACTION_SET_ALARM", ("bao thuc", "goi toi day"), arguments={"EXTRA_HOUR": "hour", "EXTRA_MINUTES": "minute", "EXTRA_MESSAGE": "alarm_label"}, needs=("EXTRA_HOUR",)),
    Rule("ACTION_SET_TIMER", ("hen gio",), arguments={"duration": "duration", "EXTRA_MESSAGE": "purpose"}, needs=("duration",)),
    Rule("ACTION_INSERT_EVENT", ("them lich", "them su kien"), confirm=True, arguments={"TITLE": "event_title", "DESCRIPTION": "event_title", "EVENT_LOCATION": "event_place", "EXTRA_EVENT_BEGIN_TIME": "event_time"}),
    Rule("ACTION_INSERT_CONTACT", ("them lien he",), confirm=True, arguments={"contact_info": "new_contact"}, needs=("contact_info",)),
    Rule("get_contact_info", ("tim so dien thoai", "tim email", "tim thong tin"), arguments={"name": "asked_name", "key": "asked_key"}),
    Rule("ACTION_VIEW_CONTACT", every=("thong tin lien he",), arguments={"contact_uri": "uri"}, where=("contact_uri",)),
    Rule("ACTION_PICK", ("email", "dia chi", "so dien thoai"), every=("chon mot",), arguments={"data_type": "picked"}),
    Rule("dial", starts=("goi",), confirm=True, arguments={"phone_number": "phone"}, needs=("phone_number",)),
    Rule("send_message", ("soan tin",), starts=("nhan",), confirm=True, arguments={"phone_number": "phone", "subject": "message_subject", "body": "message_body"}, needs=("phone_number",)),
    Rule("send_email", ("email", "soan thu"), confirm=True, arguments={"to": "emails", "subject": "mail_subject", "body": "mail_body"}, needs=("to", "subject", "body")),
    Rule("web_search", ("tim tren google", "tim kiem"), arguments={"query": "searched", "engine": '="google"'}),
    Rule("search_location", ("chi duong",), arguments={"query": "destination"}, where=("query",)),
    Rule("search_location", ("ban do",), arguments={"query": "place"}, where=("query",)),
    Rule("INTENT_ACTION_STILL_IMAGE_CAMERA", ("mo may anh", "chup hinh")),
    Rule("ACTION_IMAGE_CAPTURE", ("chup mot buc anh",)),
    Rule("INTENT_ACTION_VIDEO_CAMERA", ("che do quay phim", "mo che do quay")),
    Rule("ACTION_VIDEO_CAPTURE", ("quay mot video", "quay video")),
    Rule("ACTION_GET_CONTENT", ("chon mot anh", "chon anh"), arguments={"mime_type": '="image/*"', "allow_multiple": "=false"}),
    Rule("ACTION_OPEN_DOCUMENT", ("mo nhieu tep pdf", "mo tep pdf"), arguments={"mime_types": '=["application/pdf"]', "allow_multiple": "=true"}),
    Rule("ACTION_CREATE_DOCUMENT", ("tao tep van ban", "tao tep"), arguments={"mime_type": '="text/plain"', "initial_name": "file_name"}, needs=("initial_name",)),
)


def _json(value: Column) -> Column:
    """A value as JSON text, null of a null."""
    inside = F.to_json(F.array(value))
    return F.when(value.isNotNull(), F.substring(inside, F.lit(2), F.length(inside) - 2))


def predict_by_rules(rows: DataFrame, text: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """M4, M5: adds tool, status, requires_confirmation and arguments (map of JSON values) of the first rule that applies.

    No rule: a null tool with status unsupported.
    """
    plain = F.coalesce(normalize(F.col(text)), F.lit(""))
    said = F.coalesce(F.col(text), F.lit(""))
    taken = lambda how: F.lit(how[1:]) if how.startswith("=") else _json(EXTRACTORS[how](said))
    number = None
    for i, r in enumerate(rules):
        hit = F.lit(not (r.some or r.starts or r.exact))
        for c in [*(plain.contains(w) for w in r.some), *(plain.startswith(w) for w in r.starts), *(plain == w for w in r.exact)]:
            hit = hit | c
        for w in r.every:
            hit = hit & plain.contains(w)
        for w in r.no:
            hit = hit & ~plain.contains(w)
        for a in r.where:
            hit = hit & ~F.coalesce(taken(r.arguments[a]), F.lit('""')).isin('""', "null")
        number = F.when(hit, i) if number is None else number.when(hit, i)
    out = rows.withColumn("__rule", number.otherwise(len(rules)))
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("__rule") + 1)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    arguments = None
    for i, r in enumerate(rules):
        if r.arguments:
            made = F.map_filter(F.create_map(*[x for name, how in r.arguments.items() for x in (F.lit(name), taken(how))]), lambda _, v: v.isNotNull())
            arguments = F.when(F.col("__rule") == i, made) if arguments is None else arguments.when(F.col("__rule") == i, made)
    out = out.withColumn("__arguments", arguments.otherwise(none) if arguments is not None else none)
    needed = F.element_at(F.array(*[F.array(*[F.lit(n) for n in r.needs]).cast("array<string>") for r in rules], F.array().cast("array<string>")), F.col("__rule") + 1)
    lacking = F.size(F.array_except(needed, F.map_keys("__arguments"))) > 0
    return out.withColumns({
        "tool": F.when(~lacking, pick([r.tool for r in rules] + [None], "string")),
        "status": F.when(lacking, "clarification").otherwise(pick([r.status for r in rules] + ["unsupported"], "string")),
        "requires_confirmation": ~lacking & pick([r.confirm for r in rules] + [False], "boolean"),
        "arguments": F.when(lacking, none).otherwise(F.col("__arguments")),
    }).drop("__rule", "__arguments")


def as_prediction() -> Column:
    """What ``predict_by_rules`` adds, as one call (variant)."""
    entries = F.transform(F.map_entries("arguments"), lambda e: F.concat(_json(e["key"]), F.lit(":"), e["value"]))
    status = F.when(F.col("status").isNotNull(), F.concat(F.lit(',"status":'), _json(F.col("status")))).otherwise("")
    return F.parse_json(F.concat(F.lit('{"tool":'), F.coalesce(_json(F.col("tool")), F.lit("null")), F.lit(',"arguments":{'), F.array_join(entries, ","), F.lit('},"requires_confirmation":'), F.col("requires_confirmation").cast("string"), status, F.lit("}")))


class Predictor(Protocol):
    def __call__(self, rows: DataFrame) -> DataFrame:
        """(id, query, ...) to the rows with ``prediction`` (variant)."""


def rule_predictor(text: str = "query", rules: Sequence[Rule] = RULES) -> Predictor:
    """M5: the rules as a predictor."""
    return lambda rows: predict_by_rules(rows, text, rules).withColumn("prediction", as_prediction()).drop("tool", "status", "requires_confirmation", "arguments")


def batch_predictor(predict: Callable[[list[str]], list[str]], text: str = "query") -> Predictor:
    """A predictor that is given: ``predict`` turns a batch of texts into JSON calls, on the executors; ``latency_ms`` is each row's share of its batch's time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        for batch in batches:
            start = time.perf_counter()
            said = predict([t or "" for t in batch.column(batch.schema.names.index(text)).to_pylist()])
            each = round((time.perf_counter() - start) * 1000 / max(1, batch.num_rows), 4)
            yield batch.append_column("__said", pa.array(said, pa.string())).append_column("latency_ms", pa.array([each] * batch.num_rows, pa.float64()))

    def predictor(rows: DataFrame) -> DataFrame:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(run, f"{schema}, __said string, latency_ms double").withColumn("prediction", F.try_parse_json("__said")).drop("__said")

    return predictor


def edge_ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """M1: character n-grams inside words, each word with a blank at both ends; with repeats."""
    words = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of_size(n: int) -> Column:
        none = F.array().cast("array<string>")
        return F.flatten(F.transform(words, lambda w: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))).otherwise(none)))

    grams = [of_size(n) for n in range(low, high + 1)]
    return F.concat(*grams)


def word_ngrams(text: Column) -> Column:
    """M1: words of two characters or more, and pairs of them."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\b\w\w+\b"), F.lit(0))
    pairs = F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))


def tfidf_model(rows: DataFrame, terms: str, label: str, features: int = 15_000, c: float = 2.0, iterations: int = 200):
    """M1, M2: sublinear tf, smooth idf, unit length, multinomial logistic regression with strength C.

    Returns a function that adds ``label_scores`` (map of class to probability).
    """
    import math

    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, Normalizer, StringIndexer
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.linalg import Vectors

    n = rows.count()
    counter = CountVectorizer(inputCol=terms, outputCol="__tf", vocabSize=features).fit(rows)
    index = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(rows)
    used = rows.select(F.explode(F.array_distinct(F.col(terms))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    known = rows.sparkSession.createDataFrame([(t, i) for i, t in enumerate(counter.vocabulary)], "t string, i int")
    df = {r.i: r.n for r in used.join(F.broadcast(known), "t").collect()}
    idf = [math.log((1 + n) / (1 + df.get(i, 0))) + 1 for i in range(len(counter.vocabulary))]
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="__s", outputCol="__w")
    unit = Normalizer(inputCol="__w", outputCol="features", p=2.0)

    def prepared(d: DataFrame) -> DataFrame:
        sublinear = F.transform(vector_to_array("__tf"), lambda x: F.when(x > 0, 1 + F.log(x)).otherwise(0.0))
        return unit.transform(scaled.transform(counter.transform(d).withColumn("__s", array_to_vector(sublinear))))

    fitted = LogisticRegression(featuresCol="features", labelCol="__y", predictionCol="__c", probabilityCol="__p", rawPredictionCol="__r", maxIter=iterations, regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, family="multinomial").fit(index.transform(prepared(rows)))
    labels = F.array(*[F.lit(x) for x in index.labels])

    def predict(d: DataFrame) -> DataFrame:
        out = fitted.transform(prepared(d)).withColumn("label_scores", F.map_from_arrays(labels, vector_to_array("__p")))
        return out.drop("__tf", "__s", "__w", "features", "__c", "__p", "__r")

    return predict


def tfidf_weights(rows: DataFrame, key: str, terms: str, features: int = 15_000) -> DataFrame:
    """M1, M2: (key, term, weight) of sublinear tf and smooth idf, of unit length for each row, over the ``features`` most frequent terms (ties: the smaller).

    The vocabulary and its frequencies stay a table.
    """
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    counts = rows.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    known = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).orderBy(F.col("total").desc(), "term").limit(features)
    known = known.crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weight = (1 + F.log("tf")) * F.col("idf")
    weighed = counts.join(F.broadcast(known) if features <= 200_000 else known, "term").select(key, "term", weight.alias("w"))
    length = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return weighed.join(length, key).select(key, "term", (F.col("w") / F.col("length")).alias("weight"))


def soft_vote(a: Column, b: Column) -> Column:
    """M3: the label of the largest mean of two maps of class to probability; the first alone if the classes differ."""
    same = F.array_sort(F.map_keys(a)) == F.array_sort(F.map_keys(b))
    mean = F.when(same, F.map_zip_with(a, b, lambda _, x, y: (x + y) / 2)).otherwise(a)
    entries = F.transform(F.map_entries(mean), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))
    return F.array_min(entries)["k"]
