"""Queries on validation, text functions, dataset building, sources and resuming."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import baselines, build, metrics
from tessera.operators import validate as V
from tessera.plans._tables import table, texts
from tessera.sources import io
from tessera.streaming import resume


def dup_ids(spark, sf_dir):
    """Repeated texts; every tenth conversation is there twice."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    rows = said.unionByName(said.filter("conv_id % 10 = 0").withColumn("conv_id", F.col("conv_id") + 10_000_000)).withColumn("key", F.md5("text"))
    return V.duplicates(rows, ["key"], ["conv_id", "turn"]).filter("is_duplicate").select("conv_id", "turn", "occurrence")


def student_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return V.summarize_items(rows, ["lang", "source"], "text").select("dimension", "value", F.round("n", 3).alias("n"))


def required_groups(spark, sf_dir):
    given = F.from_json("props", "map<string,string>")
    e = table(spark, sf_dir, "events").withColumn("g", given)
    missing = F.when(F.col("event_type") == "click", V.required_groups(F.col("g"), [["x", "k"], ["z"]])).when(F.col("event_type") == "view", V.required_groups(F.col("g"), [["k"]])).otherwise(V.required_groups(F.col("g"), [["q", "r"]]))
    return e.select("event_type", F.array_join(missing, ",").alias("missing")).groupBy("event_type", "missing").agg(F.count(F.lit(1)).alias("n"))


def _checked(spark, sf_dir):
    """Events as calls: the tool is the type, the arguments are props."""
    arg = lambda name, kind, required, low=None, high=None, enum=None: (name, kind, required, enum, low, high, None)
    catalog = spark.createDataFrame([
        ("click", False, [arg("k", "integer", True, 10, 60)]), ("view", True, [arg("k", "string", False)]),
        ("error", False, [arg("k", "integer", False, None, 50), arg("code", "string", True)]), ("purchase", False, []),
    ], V.CATALOG_SCHEMA)
    calls = table(spark, sf_dir, "events").select("event_id", "event_type", F.try_parse_json(F.concat(F.lit('{"tool":"'), "event_type", F.lit('","requires_confirmation":false,"arguments":'), "props", F.lit("}"))).alias("prediction"))
    return V.validate_calls(calls, catalog)


def error_list(spark, sf_dir):
    return _checked(spark, sf_dir).select("event_id", F.array_join("errors", "|").alias("errors"))


def json_type_check(spark, sf_dir):
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "variant")
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    e = table(spark, sf_dir, "events").select(V.kind_of(v).alias("kind"), (k.between(10, 60)).alias("in_range"))
    return e.groupBy("kind", "in_range").agg(F.count(F.lit(1)).alias("n"))


def json_extract_value(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


def json_from_noise(spark, sf_dir):
    noisy = F.when(F.col("event_id") % 5 == 0, F.lit("no braces")).when(F.col("event_id") % 5 == 1, F.concat(F.lit("x "), "props", F.lit(" }"))).when(F.col("event_id") % 5 == 2, F.col("props")).otherwise(F.concat(F.lit("x "), "props", F.lit(" y")))
    v = X.extract_json(noisy)
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.status", "string").alias("status"))


def norm_matrix(spark, sf_dir):
    rows = texts(spark, sf_dir, "documents")
    kinds = list(X.NORMALIZERS)
    return rows.select(*[F.md5(X.normalize(F.col("text"), k)).alias(k) for k in kinds]).agg(*[F.count_distinct(k).alias(k) for k in kinds])


def norm_digest(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", F.md5(X.normalize(F.col("text"), "common")).alias("common"), F.md5(X.normalize(F.col("text"), "split")).alias("split"), F.md5(X.normalize(F.col("text"), "student")).alias("student"))


def tokens_per_lang(spark, sf_dir):
    t = texts(spark, sf_dir, "documents").select("lang", F.size(X.tokenize(F.col("text"))).alias("n"))
    return t.groupBy("lang").agg(F.sum("n").alias("tokens"), F.max("n").cast("bigint").alias("longest"))


def entity_extract(spark, sf_dir):
    """Mail addresses and contact URIs of the documents, each with one of the latter behind."""
    t = F.concat(F.coalesce("text", F.lit("")), F.lit(" content://x/"), F.col("doc_id").cast("string"), F.lit("\n"))
    d = texts(spark, sf_dir, "documents").select("doc_id", X.emails(t).alias("e"), X.uris(t).alias("u"))
    return d.select("doc_id", F.array_join("e", ",").alias("emails"), F.array_join("u", ",").alias("uris"))


def phone_extract(spark, sf_dir):
    """Numbers in texts about customers: right ones, too long ones, and such as stand in a word."""
    k = F.lpad(F.col("c_custkey").cast("string"), 9, "1")
    t = F.concat(F.lit("gọi 0"), k, F.lit(" hay 0"), k, F.lit("77, 0"), k, F.lit("éo số0"), k, F.lit(".0"), F.substring(k, 1, 8))
    d = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(X.phones(t)).alias("place", "phone"))
    return d.select("c_custkey", F.col("place").cast("bigint").alias("place"), X.phone_digits(F.col("phone")).alias("digits"))


#: Commands, and what the rules make of them: tool, status, confirmation, arguments.
COMMANDS = (
    ("Chuyển cho Khôi 75k", None, "unsupported", False, {}), ("Làm đi", None, "clarification", False, {}), ("Mở cài đặt Wi-Fi giùm mình", "open_settings", None, False, {"setting_type": "wifi"}),
    ("mở cài đặt", "open_settings", None, False, {"setting_type": "general"}), ("Xem các báo thức của mình", "ACTION_SHOW_ALARMS", None, False, {}),
    ("Đặt báo thức 5 giờ 45 nhãn tưới cây", "ACTION_SET_ALARM", None, False, {"EXTRA_HOUR": 5, "EXTRA_MINUTES": 45, "EXTRA_MESSAGE": "tưới cây"}), ("Đặt báo thức", None, "clarification", False, {}),
    ("Hẹn giờ 35 phút để hầm xương", "ACTION_SET_TIMER", None, False, {"duration": "35 minutes", "EXTRA_MESSAGE": "hầm xương"}), ("Hẹn giờ giúp mình nhé", None, "clarification", False, {}),
    ("Thêm lịch tập kịch lúc 4 giờ chiều mai tại nhà văn hóa", "ACTION_INSERT_EVENT", None, True, {"TITLE": "tập kịch", "DESCRIPTION": "tập kịch", "EVENT_LOCATION": "nhà văn hóa", "EXTRA_EVENT_BEGIN_TIME": "tomorrow 16:00"}),
    ("Hãy thêm liên hệ Bảo Trân số 0935551204", "ACTION_INSERT_CONTACT", None, True, {"contact_info": {"name": "Bảo Trân", "phone": "0935551204"}}), ("thêm liên hệ Khôi", None, "clarification", False, {}),
    ("Tìm email của chị Duyên trong danh bạ", "get_contact_info", None, False, {"name": "Duyên", "key": "email"}), ("Tìm số điện thoại của Quý", "get_contact_info", None, False, {"name": "Quý", "key": "phone"}),
    ("Cho thông tin liên hệ content://contacts/418 nhé", "ACTION_VIEW_CONTACT", None, False, {"contact_uri": "content://contacts/418"}), ("Cho thông tin liên hệ", None, "unsupported", False, {}),
    ("Chọn một địa chỉ", "ACTION_PICK", None, False, {"data_type": "ADDRESS"}), ("Chọn một số điện thoại", "ACTION_PICK", None, False, {"data_type": "PHONE"}), ("Gọi 0935551204 ngay", "dial", None, True, {"phone_number": "0935551204"}), ("Gọi bà ngoại", None, "clarification", False, {}),
    ("Nhắn 0977420316 tiêu đề nhắc, rằng xe vừa hỏng", "send_message", None, True, {"phone_number": "0977420316", "subject": "nhắc", "body": "xe vừa hỏng"}), ("Soạn tin tới 0977420316", "send_message", None, True, {"phone_number": "0977420316", "subject": "", "body": ""}),
    ("Gửi email tới t.q@bep.vn, u@nha.org tiêu đề Thực đơn, nội dung Có bún riêu", "send_email", None, True, {"to": ["t.q@bep.vn", "u@nha.org"], "subject": "Thực đơn", "body": "Có bún riêu"}), ("Gửi email tới t@bep.vn", None, "clarification", False, {}),
    ("Tìm trên Google giá sầu riêng", "web_search", None, False, {"query": "giá sầu riêng", "engine": "google"}), ("Chỉ đường tới bến phà Cát Lái", "search_location", None, False, {"query": "bến phà Cát Lái"}), ("Tìm trạm sạc xe trên bản đồ", "search_location", None, False, {"query": "trạm sạc xe"}),
    ("Mở máy ảnh", "INTENT_ACTION_STILL_IMAGE_CAMERA", None, False, {}), ("Chụp một bức ảnh hoàng hôn", "ACTION_IMAGE_CAPTURE", None, False, {}), ("Mở chế độ quay phim", "INTENT_ACTION_VIDEO_CAMERA", None, False, {}), ("Quay video mèo ngủ", "ACTION_VIDEO_CAPTURE", None, False, {}),
    ("Chọn ảnh con mèo trong máy", "ACTION_GET_CONTENT", None, False, {"mime_type": "image/*", "allow_multiple": False}), ("Mở nhiều tệp PDF công thức", "ACTION_OPEN_DOCUMENT", None, False, {"mime_types": ["application/pdf"], "allow_multiple": True}),
    ("Tạo tệp văn bản tên di-cho.txt", "ACTION_CREATE_DOCUMENT", None, False, {"mime_type": "text/plain", "initial_name": "di-cho.txt"}), ("Tạo tệp", None, "clarification", False, {}), ("Hôm nay trăng tròn không", None, "unsupported", False, {}),
)


def rule_commands(spark, sf_dir):
    """The rules on commands that reach every one of them; as often as there are suppliers of their number's remainder."""
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(COMMANDS)], "number bigint, query string")
    many = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % len(COMMANDS)).alias("number"))
    out = baselines.predict_by_rules(many.join(F.broadcast(rows), "number"), "query")
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys("arguments")), lambda k: F.concat(F.lit('"'), k, F.lit('":'), F.element_at("arguments", k))), ","), F.lit("}"))
    return out.select("s_suppkey", "tool", "status", "requires_confirmation", text.alias("arguments"))


def noise_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark")
    return rows.select("item_id", build.merge_words(F.col("text"), F.col("item_id"), 0.2).alias("noisy"))


def noise_marks(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("Đặt ở quán phở, "), "text").alias("text"))
    return rows.select("item_id", build.drop_marks(F.col("text"), F.col("item_id"), 0.5, 0.25, 0.12).alias("noisy"))


def noise_training(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("query"))
    out = build.training_noise(rows, "query", "id")
    kept = build.training_rows(out.withColumns({"noisy_query": F.col("query"), "group": F.lit(None).cast("string"), "expected": F.lit(1)}), ("light",))
    return out.groupBy("noise_level").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.col("clean_query").isNull()).cast("bigint").alias("clean")).crossJoin(F.broadcast(kept.agg(F.count(F.lit(1)).alias("light"))))


PHRASES = ("6 giờ 30", "bảy giờ", "2 giờ chiều", "tôi dậy lúc 5 giờ", "8 giờ tối", "mười hai giờ", "25 giờ", "không có gì", "7h15", "11 giờ 61", "mười giờ sáng", "12 giờ chiều")
TIMES = ((6, 30), (7, 0), (14, 0), (5, 0), (20, 0), (12, 0), (None, None), (None, None), (7, 15), (None, None), (10, 0), (12, 0))


def time_parse(spark, sf_dir):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(PHRASES)], "id bigint, phrase string")
    t = X.parse_time(F.col("phrase"))
    return rows.select("id", t["hour"].cast("bigint").alias("hour"), t["minute"].cast("bigint").alias("minute"))


def duration_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("hẹn "), (F.col("event_id") % 90).cast("string"), F.when(F.col("event_id") % 3 == 0, " phút").when(F.col("event_id") % 3 == 1, " giờ").otherwise(" giây")).alias("t"))
    d = X.parse_duration(F.col("t"))
    return rows.select("event_id", d["amount"].alias("amount"), d["unit"].alias("unit"))


def contact_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 3 == 0, "Anh_").when(F.col("c_custkey") % 3 == 1, "bác  ").otherwise(""), F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_name"))).alias("raw"))
    return c.select("c_custkey", X.contact_name(F.col("raw")).alias("name"), X.phone_digits(F.col("raw")).alias("digits"))


def setting_map(spark, sf_dir):
    mapped = X.canonical_value(F.col("c_mktsegment"), {"building": "sound", "machinery": "wifi"})
    return table(spark, sf_dir, "customer").select(mapped.alias("setting")).groupBy("setting").agg(F.count(F.lit(1)).alias("n"))


def label_classes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    label = X.label_class(F.when(F.col("quality") == 1, F.col("lang")), F.when(F.col("toxic") == 1, "rejected").when(F.col("toxic") == 0, "unsupported"))
    return d.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def template_fill(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("mở {"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("} size {"), F.col("p_size").cast("string"), F.lit("}")).alias("template"))
    return build.from_templates(t).select("p_partkey", "query")


def canonical_text(spark, sf_dir):
    m = F.from_json(F.concat(F.lit('{"z":'), F.col("event_id").cast("string"), F.lit(',"a":'), "props", F.lit("}")), "map<string,variant>")
    return table(spark, sf_dir, "events").select("event_id", X.canonical_json(m).alias("text"))


def next_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("id"))
    return ids.agg(X.next_id(F.col("id"), "N").alias("next_id"))


def sequence_ids(spark, sf_dir):
    rows = metrics.running_number(table(spark, sf_dir, "customer"), ["c_mktsegment"], ["c_custkey"])
    return rows.select("c_custkey", F.format_string("id_%s_%03d", F.lower("c_mktsegment"), F.col("number")).alias("uid"))


def route_intents(spark, sf_dir):
    routes = {"call": ("goi",), "open": ("mo ", "bat "), "license": ("license",), "table": (" | ",)}
    return table(spark, sf_dir, "documents").groupBy(X.route_intent(F.col("text"), routes).alias("intent")).agg(F.count(F.lit(1)).alias("n"))


def rule_predictions(spark, sf_dir):
    rules = (baselines.Rule("licensed", ("license",), no=("cc by",)), baselines.Rule("cc", ("cc by",), confirm=True), baselines.Rule("contact", ("@",)), baselines.Rule(None, ("!!",), status="clarification"))
    out = baselines.predict_by_rules(table(spark, sf_dir, "documents"), "text", rules)
    return out.groupBy("tool", "status", "requires_confirmation").agg(F.count(F.lit(1)).alias("n"))


def split_stratified(spark, sf_dir):
    out = build.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")
    return out.select("doc_id", "lang", "split")


def split_forced(spark, sf_dir):
    """B1 with rows that must not be tested: they count, but only the others are drawn."""
    out = build.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", forced_train=F.col("doc_id") % 3 == 0)
    return out.select("doc_id", "lang", "split")


def quota_largest_remainder(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = table(spark, sf_dir, "part").select((F.floor(F.count(F.lit(1)) * 0.2)).alias("t")).first()[0]
    return build.quotas(sizes, int(total)).select("class", "n", "quota")


def noise_tone_removal(spark, sf_dir):
    toneless, bare = build.strip_tones_then_shapes(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(bare).alias("bare"), F.length(toneless).cast("bigint").alias("n"))


def noise_levels(spark, sf_dir):
    """Every turn at every level."""
    rows = texts(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    out = build.add_noise(rows, "text", "id", words=build.MISHEARD | {"the": "teh", "and": ("an", "end")})
    return out.select("id", "noise_level", F.md5("text").alias("noisy"), (F.col("text") != F.col("clean_text")).alias("changed"))


def noise_words(spark, sf_dir):
    """Word substitution and tone loss, each drawn by a hash that SQL can compute as well."""
    rows = table(spark, sf_dir, "benchmark")
    return rows.select("item_id", build.substitute_words(F.col("text"), {"the": "teh", "of": "ov", "is": "iz"}, F.col("item_id"), 0.5).alias("noisy"))


def union_lineage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    a, b = d.filter("doc_id % 3 = 0"), d.filter("doc_id % 2 = 0").select("doc_id")
    both = build.union_all([a, b])
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_distinct"), F.count_if(F.col("lang").isNull()).cast("bigint").alias("n_without_lang"))


def blocked_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(X.normalize(F.col("text"), "split")).alias("key"))
    return build.blocked(d.filter("doc_id % 2 = 0"), "key", [d.filter("doc_id % 5 = 1"), d.filter("doc_id % 5 = 3")]).select("doc_id")


def held_out(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    out = build.take_least_similar(rows, "c_mktsegment", F.lit(7), [F.col("c_acctbal") > 0, F.col("c_acctbal"), F.col("c_custkey")])
    return out.select("c_custkey", "held_out")


def semi_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


def full_outer(spark, sf_dir):
    a = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", "toxic")
    b = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id", "quality")
    return a.join(b, "doc_id", "full_outer").select("doc_id", "toxic", "quality")


def group_join_default(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", F.coalesce(F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad"), F.lit("unknown")).alias("group"))


def positional_join(spark, sf_dir):
    """The n-th supplier with the n-th customer."""
    a = table(spark, sf_dir, "supplier").select("s_suppkey")
    b = table(spark, sf_dir, "customer").select("c_custkey")
    return build.zipped(a, b, ["s_suppkey"], ["c_custkey"]).select("s_suppkey", "c_custkey")


def log_parse(spark, sf_dir):
    line = F.format_string("I/app: BENCH_RESULT run=%d ttft_ms=%d tps=%s tool=%s ok=%s", F.col("event_id"), (F.col("event_id") * 7) % 5000, F.lit("1.5"), F.when(F.col("event_type") == "error", "null").otherwise(F.col("event_type")), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"))
    lines = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 11 == 0, "noise").otherwise(line).alias("line"))
    return io.parse_results(lines).groupBy("tool", "ok").agg(F.count(F.lit(1)).alias("n"), F.sum("ttft_ms").alias("ttft_ms"))


def csv_ledger(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(F.col("l_returnflag"))).alias("flags"), (F.max("l_quantity") > 40).alias("large"))
    return io.ledger_columns(o, lists=["flags"]).select("id", "flags", "large")


def resume_pending(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return resume.pending(d, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


def resume_faults(spark, sf_dir):
    examples = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    done = table(spark, sf_dir, "documents").select((F.col("doc_id") - F.col("doc_id") % 2).alias("id"), F.col("lang").alias("protocol_id"))
    return resume.resume_faults(examples, done)


QUERIES = {f.__name__: f for f in (dup_ids, student_summary, required_groups, error_list, json_type_check, json_extract_value, json_from_noise, norm_matrix, norm_digest, tokens_per_lang, entity_extract, phone_extract, time_parse, duration_parse, contact_names, setting_map, label_classes, template_fill, canonical_text, next_ids, sequence_ids, route_intents, rule_predictions, split_stratified, split_forced, quota_largest_remainder, noise_tone_removal, noise_levels, noise_words, noise_merge, noise_marks, noise_training, rule_commands, union_lineage, blocked_rows, held_out, semi_join, full_outer, group_join_default, positional_join, log_parse, csv_ledger, resume_pending, resume_faults)}

_FOLD = "lower(strip_accents(replace(replace({c}, 'đ', 'd'), 'Đ', 'D')))"
_COMMON = "regexp_replace(regexp_replace(" + _FOLD + r", '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"
_SPLIT = "trim(regexp_replace(" + _FOLD + ", '[^a-z0-9]+', ' ', 'g'))"
_LEAK = r"regexp_replace(regexp_replace(" + _FOLD + r", '[^a-z0-9\s]', '', 'g'), '^\s+|\s+$', '', 'g')"
_STUDENT = "trim(regexp_replace(lower({c}), '[^a-z0-9 ]', '', 'g'))"
_FRESH = "trim(regexp_replace(" + _FOLD + ", '[^a-z0-9@.+:/_* -]+', ' ', 'g'))"
_BENCH = r"regexp_replace(regexp_replace(" + _FOLD + r", '\s+', ' ', 'g'), '^ +| +$', '', 'g')"
_DRAW = "('0x' || substr(md5('42:' || {k}), 1, 13))::BIGINT::DOUBLE / 4503599627370496"
_PROPS = "props::JSON"

_TONED = build._tone_tables()[0]


def _commands_sql() -> str:
    import json

    quote = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quote(t)}, {quote(s)}, {str(c).lower()}, {quote(json.dumps(a, ensure_ascii=False, separators=(',', ':'), sort_keys=True))})" for i, (_, t, s, c, a) in enumerate(COMMANDS))
    return f"SELECT s_suppkey, tool, status, requires_confirmation, arguments FROM supplier JOIN (VALUES {rows}) c(number, tool, status, requires_confirmation, arguments) ON s_suppkey % {len(COMMANDS)} = number"


def noisy_sql(key: str, rows: str, tone: float, shape: float, merge: float) -> str:
    """(item_id, noisy) of rows (item_id, t); ``key`` is an expression on item_id, called id where it is given by name."""
    draw = lambda kind: _DRAW.format(k=f"{key.replace('id ||', 'item_id ||')} || ':' || i::VARCHAR || ':{kind}'")
    return f"""WITH t AS ({rows}), c AS (SELECT item_id, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) - 1 AS i FROM t),
      n AS (SELECT item_id, i, CASE WHEN {draw("tone")} < {tone} THEN nfc_normalize(regexp_replace(translate(c, {_TONED[0]!r}, {_TONED[1]!r}), '', '')) ELSE c END AS c FROM c),
      s AS (SELECT item_id, i, CASE WHEN {draw("shape")} < {shape} THEN translate(c, 'ăâêôơưđĂÂÊÔƠƯĐ', 'aaeooudAAEOOUD') ELSE c END AS c FROM n), j AS (SELECT item_id, string_agg(c, '' ORDER BY i) AS t FROM s GROUP BY item_id),
      w AS (SELECT item_id, unnest(string_split(t, ' ')) AS w, generate_subscripts(string_split(t, ' '), 1) - 1 AS i FROM j) SELECT item_id, string_agg(CASE WHEN i > 0 AND {draw("gap")} >= {merge} THEN ' ' ELSE '' END || w, '' ORDER BY i) AS noisy FROM w GROUP BY item_id"""


ORACLE = {
    "dup_ids": "WITH t AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT conv_id + 10000000, turn, text FROM conversations WHERE conv_id % 10 = 0), d AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS occurrence FROM t) SELECT * FROM d WHERE occurrence > 1",
    "student_summary": f"SELECT 'lang' AS dimension, lang AS value, count(*)::DOUBLE AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*)::DOUBLE FROM documents GROUP BY source UNION ALL SELECT 'all', 'n', count(*)::DOUBLE FROM documents UNION ALL SELECT 'all', 'unique_rate', round(count(DISTINCT {_STUDENT.format(c='text')}) / count(*)::DOUBLE, 3) FROM documents",
    "required_groups": f"SELECT event_type, CASE WHEN event_type = 'click' THEN concat_ws(',', CASE WHEN coalesce({_PROPS}->>'$.x', '') = '' AND coalesce({_PROPS}->>'$.k', '') = '' THEN 'x/k' END, CASE WHEN coalesce({_PROPS}->>'$.z', '') = '' THEN 'z' END) WHEN event_type = 'view' THEN CASE WHEN coalesce({_PROPS}->>'$.k', '') = '' THEN 'k' ELSE '' END ELSE CASE WHEN coalesce({_PROPS}->>'$.q', '') = '' AND coalesce({_PROPS}->>'$.r', '') = '' THEN 'q/r' ELSE '' END END AS missing, count(*) AS n FROM events GROUP BY ALL",
    "error_list": f"WITH e AS (SELECT event_id, event_type, ({_PROPS}->>'$.k')::BIGINT AS k, list_sort(json_keys(props)) AS ks FROM events) SELECT event_id, CASE event_type WHEN 'click' THEN concat_ws('|', CASE WHEN len(list_filter(ks, lambda x: x != 'k')) > 0 THEN 'unknown arguments: ' || array_to_string(list_filter(ks, lambda x: x != 'k'), ', ') END, CASE WHEN k IS NULL THEN 'missing required argument: k' END, CASE WHEN k < 10 THEN 'k is below minimum' END, CASE WHEN k > 60 THEN 'k is above maximum' END) WHEN 'view' THEN concat_ws('|', CASE WHEN len(list_filter(ks, lambda x: x != 'k')) > 0 THEN 'unknown arguments: ' || array_to_string(list_filter(ks, lambda x: x != 'k'), ', ') END, CASE WHEN k IS NOT NULL THEN 'k must be string' END, 'requires_confirmation must be true') WHEN 'error' THEN concat_ws('|', CASE WHEN len(list_filter(ks, lambda x: x NOT IN ('k', 'code'))) > 0 THEN 'unknown arguments: ' || array_to_string(list_filter(ks, lambda x: x NOT IN ('k', 'code')), ', ') END, CASE WHEN k > 50 THEN 'k is above maximum' END, CASE WHEN NOT list_contains(ks, 'code') THEN 'missing required argument: code' END) WHEN 'purchase' THEN CASE WHEN len(ks) > 0 THEN 'unknown arguments: ' || array_to_string(ks, ', ') ELSE '' END ELSE 'unknown tool: ' || event_type END AS errors FROM e",
    "json_type_check": "SELECT CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'number' WHEN 'NULL' THEN 'null' END AS kind, try_cast(props->>'$.k' AS BIGINT) BETWEEN 10 AND 60 AS in_range, count(*) AS n FROM events GROUP BY ALL",
    "json_extract_value": "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events",
    "json_from_noise": "SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN NULL ELSE (props->>'$.k')::BIGINT END AS k, CASE WHEN event_id % 5 IN (0, 1) THEN 'rejected' END AS status FROM events",
    "norm_matrix": f"SELECT count(DISTINCT {_COMMON.format(c='text')}) AS common, count(DISTINCT {_STUDENT.format(c='text')}) AS student, count(DISTINCT {_LEAK.format(c='text')}) AS leak, count(DISTINCT {_SPLIT.format(c='text')}) AS split, count(DISTINCT {_BENCH.format(c='text')}) AS bench, count(DISTINCT {_FRESH.format(c='text')}) AS fresh, count(DISTINCT {_COMMON.format(c='text')}) AS t444, count(DISTINCT strip_accents(text)) AS kfd FROM documents",
    "norm_digest": f"SELECT doc_id, md5({_COMMON.format(c='text')}) AS common, md5({_SPLIT.format(c='text')}) AS split, md5({_STUDENT.format(c='text')}) AS student FROM documents",
    "tokens_per_lang": f"WITH t AS (SELECT lang, len(regexp_extract_all({_COMMON.format(c='text')}, '[a-z0-9_@.+/*:-]+')) AS n FROM documents) SELECT lang, sum(n)::BIGINT AS tokens, max(n)::BIGINT AS longest FROM t GROUP BY lang",
    "entity_extract": r"WITH t AS (SELECT doc_id, coalesce(text, '') || ' content://x/' || doc_id::VARCHAR || chr(10) AS t FROM documents), d AS (SELECT doc_id, regexp_extract_all(t, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[a-zA-Z]{2,}') AS e, regexp_extract_all(t, 'content://[^ \t\n\x0B\f\r]+') AS u FROM t) SELECT doc_id, array_to_string(e, ',') AS emails, array_to_string(u, ',') AS uris FROM d",
    "phone_extract": r"WITH k AS (SELECT c_custkey, lpad(c_custkey::VARCHAR, 9, '1') AS k FROM customer), t AS (SELECT c_custkey, 'gọi 0' || k || ' hay 0' || k || '77, 0' || k || 'éo số0' || k || '.0' || k[1:8] AS t FROM k), p AS (SELECT c_custkey, regexp_extract_all(regexp_replace(t, '([^\p{L}\p{N}_])', '\1\1', 'g'), '(?:^|[^\p{L}\p{N}_])(0[0-9]{8,10})(?:$|[^\p{L}\p{N}_])', 1) AS p FROM t) SELECT c_custkey, unnest(p) AS digits, (generate_subscripts(p, 1) - 1)::BIGINT AS place FROM p",
    "noise_merge": f"WITH w AS (SELECT item_id, list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x != '') AS w FROM benchmark), g AS (SELECT item_id, w, unnest(generate_series(1, len(w) - 1)) AS i FROM w WHERE len(w) > 1), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY {_DRAW.format(k="item_id::VARCHAR || ':' || i::VARCHAR || ':merge'")}, i) <= greatest(1, floor(len(w) * 0.2::DOUBLE)) AS closed FROM g) SELECT item_id, any_value(w[1]) || string_agg(CASE WHEN closed THEN '' ELSE ' ' END || w[i + 1], '' ORDER BY i) AS noisy FROM r GROUP BY item_id",
    "noise_marks": noisy_sql("item_id::VARCHAR", "SELECT item_id, 'Đặt ở quán phở, ' || text AS t FROM benchmark", 0.5, 0.25, 0.12),
    "noise_training": "SELECT l AS noise_level, count(*) AS n, count(DISTINCT item_id) AS ids, count(*) FILTER (l IS NULL) AS clean, (SELECT count(*) FROM benchmark) AS light FROM benchmark, (VALUES (NULL), ('light'), ('medium')) v(l) GROUP BY l",
    "rule_commands": _commands_sql(),
    "time_parse": "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {'NULL' if h is None else h}::BIGINT, {'NULL' if m is None else m}::BIGINT)" for i, (h, m) in enumerate(TIMES)) + ") t(id, hour, minute)",
    "duration_parse": "SELECT event_id, event_id % 90 AS amount, CASE event_id % 3 WHEN 0 THEN 'minutes' WHEN 1 THEN 'hours' ELSE 'seconds' END AS unit FROM events",
    "contact_names": "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN CASE c_custkey % 3 WHEN 0 THEN 'Anh' WHEN 1 THEN 'bác' ELSE '' END ELSE c_name END AS name, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE regexp_replace(c_name, '[^0-9]', '', 'g') END AS digits FROM customer",
    "setting_map": "SELECT CASE lower(c_mktsegment) WHEN 'building' THEN 'sound' WHEN 'machinery' THEN 'wifi' ELSE c_mktsegment END AS setting, count(*) AS n FROM customer GROUP BY 1",
    "label_classes": "SELECT coalesce(CASE WHEN quality = 1 THEN lang END, 'NULL:' || coalesce(CASE toxic WHEN 1 THEN 'rejected' WHEN 0 THEN 'unsupported' END, 'None')) AS label, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "template_fill": "SELECT p_partkey, 'mở ' || replace(p_brand, '#', '_') || ' size ' || p_size::VARCHAR AS query FROM part",
    "canonical_text": "SELECT event_id, '{\"a\": ' || replace(props, ' ', '') || ', \"z\": ' || event_id::VARCHAR || '}' AS text FROM events",
    "next_ids": "SELECT 'N' || lpad((max(n_nationkey) + 1)::VARCHAR, 3, '0') AS next_id FROM nation",
    "sequence_ids": "SELECT c_custkey, format('id_{}_{:03d}', lower(c_mktsegment), row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey)) AS uid FROM customer",
    "route_intents": f"WITH t AS (SELECT {_COMMON.format(c='text')} AS t FROM documents) SELECT CASE WHEN contains(t, 'goi') THEN 'call' WHEN contains(t, 'mo ') OR contains(t, 'bat ') THEN 'open' WHEN contains(t, 'license') THEN 'license' WHEN contains(t, ' | ') THEN 'table' ELSE 'unknown' END AS intent, count(*) AS n FROM t GROUP BY 1",
    "rule_predictions": f"WITH t AS (SELECT {_COMMON.format(c='text')} AS t FROM documents), r AS (SELECT CASE WHEN contains(t, 'license') AND NOT contains(t, 'cc by') THEN 0 WHEN contains(t, 'cc by') THEN 1 WHEN contains(t, '@') THEN 2 WHEN contains(t, '!!') THEN 3 ELSE 4 END AS r FROM t) SELECT CASE r WHEN 0 THEN 'licensed' WHEN 1 THEN 'cc' WHEN 2 THEN 'contact' END AS tool, CASE r WHEN 3 THEN 'clarification' WHEN 4 THEN 'unsupported' END AS status, r = 1 AS requires_confirmation, count(*) AS n FROM r GROUP BY ALL",
    "split_stratified": f"WITH d AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY {_DRAW.format(k='doc_id::VARCHAR')}, doc_id) AS r FROM documents) SELECT doc_id, lang, CASE WHEN r <= greatest(4, round_even(0.2::DOUBLE * n, 0)) THEN 'test' ELSE 'train' END AS split FROM d",
    "split_forced": f"WITH d AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang, doc_id % 3 = 0 ORDER BY {_DRAW.format(k='doc_id::VARCHAR')}, doc_id) AS r FROM documents) SELECT doc_id, lang, CASE WHEN doc_id % 3 != 0 AND r <= greatest(4, round_even(0.2::DOUBLE * n, 0)) THEN 'test' ELSE 'train' END AS split FROM d",
    "quota_largest_remainder": "WITH s AS (SELECT p_type AS class, count(*) AS n FROM part GROUP BY 1), t AS (SELECT *, greatest(1, floor(0.2::DOUBLE * n))::BIGINT AS base FROM s), u AS (SELECT *, round(0.2::DOUBLE * n - base, 9) AS rest FROM t), l AS (SELECT (SELECT floor(count(*) * 0.2::DOUBLE) FROM part) - sum(base) AS left_ FROM u), r AS (SELECT u.*, turn FROM u, l, generate_series(0, greatest(left_, 0)::BIGINT) g(turn)), p AS (SELECT *, row_number() OVER (ORDER BY rest - turn DESC, n DESC, class DESC) AS place FROM r), a AS (SELECT class, count(*) AS added FROM p, l WHERE place <= left_ GROUP BY class) SELECT class, n, base + coalesce(added, 0) AS quota FROM u LEFT JOIN a USING (class)",
    "noise_tone_removal": "SELECT doc_id, md5(strip_accents(replace(replace(text, 'đ', 'd'), 'Đ', 'D'))) AS bare, length(text)::BIGINT AS n FROM documents",
    "noise_words": f"WITH t AS (SELECT item_id, list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x != '') AS ws FROM benchmark), w AS (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM t), s AS (SELECT item_id, i, w, CASE lower(w) WHEN 'the' THEN 'teh' WHEN 'of' THEN 'ov' WHEN 'is' THEN 'iz' END AS new, {_DRAW.format(k="item_id::VARCHAR || ':' || i::VARCHAR || ':sub'")} AS u FROM w) SELECT item_id, string_agg(CASE WHEN new IS NOT NULL AND u < 0.5 THEN CASE WHEN w[1] = upper(w[1]) THEN upper(new[1]) || new[2:] ELSE new END ELSE w END, ' ' ORDER BY i) AS noisy FROM s GROUP BY item_id",
    "union_lineage": "WITH u AS (SELECT doc_id, lang FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 2 = 0) SELECT count(*) AS n, count(DISTINCT doc_id) AS n_distinct, count(*) FILTER (lang IS NULL) AS n_without_lang FROM u",
    "blocked_rows": f"WITH d AS (SELECT doc_id, {_SPLIT.format(c='text')} AS k FROM documents) SELECT doc_id FROM d WHERE doc_id % 2 = 0 AND k NOT IN (SELECT k FROM d WHERE doc_id % 5 IN (1, 3))",
    "held_out": "SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal > 0, c_acctbal, c_custkey) <= 7 AS held_out FROM customer",
    "semi_join": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "full_outer": "SELECT doc_id, toxic, quality FROM (SELECT doc_id, toxic FROM labels WHERE toxic = 1) a FULL JOIN (SELECT doc_id, quality FROM labels WHERE quality = 0) b USING (doc_id)",
    "group_join_default": "SELECT doc_id, CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' ELSE 'unknown' END AS \"group\" FROM documents LEFT JOIN labels USING (doc_id)",
    "positional_join": "WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier), b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) SELECT s_suppkey, c_custkey FROM a JOIN b USING (i)",
    "log_parse": "SELECT CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS tool, event_id % 2 = 0 AS ok, count(*) AS n, sum((event_id * 7) % 5000)::BIGINT AS ttft_ms FROM events WHERE event_id % 11 != 0 GROUP BY ALL",
    "csv_ledger": "SELECT l_orderkey AS id, array_to_string(list_sort(list(DISTINCT l_returnflag)), '|') AS flags, CASE WHEN max(l_quantity) > 40 THEN 'True' ELSE 'False' END AS large FROM lineitem GROUP BY l_orderkey",
    "resume_pending": "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "resume_faults": "WITH d AS (SELECT doc_id - doc_id % 2 AS id, lang FROM documents) SELECT 'repeated' AS fault, id::VARCHAR AS key FROM d GROUP BY id HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'unknown', id::VARCHAR FROM d WHERE id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT 'mixed protocol', lang FROM d WHERE lang != (SELECT min(lang) FROM d)",
}
