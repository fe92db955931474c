"""Building datasets: splits, quotas, noise, unions.

Randomness is a hash of (seed, key, purpose), so results don't depend on how
rows are laid out, and reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import _BARE, _MARKED, fill_template
from tessera.operators.layout import evenly, kept


def uniform(*keys: Column, seed: int = 42) -> Column:
    """A number in [0, 1) fixed by the keys: 52 bits of an MD5, so that SQL elsewhere gives the same."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def stratified_split(rows: DataFrame, group: str, key: str, share: float = 0.2, least: int = 4, forced_train: Column | None = None, seed: int = 42) -> DataFrame:
    """B1: adds ``split``: of each group max(least, round half even(share n)) rows go to test, in hash order.

    Rows with ``forced_train`` are counted but never go to test.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    forced = F.coalesce(forced_train, F.lit(False)) if forced_train is not None else F.lit(False)
    w = Window.partitionBy(group, forced).orderBy(uniform(F.col(key), seed=seed), key)
    want = F.greatest(F.lit(least), F.bround(F.lit(share) * F.col("__n")))
    out = rows.join(sizes.withColumnRenamed(group, "__g"), F.col(group).eqNullSafe(F.col("__g")))
    return out.withColumn("split", F.when(~forced & (F.row_number().over(w) <= want), "test").otherwise("train")).drop("__n", "__g")


def quotas(sizes: DataFrame, total: int, share: float = 0.2) -> DataFrame:
    """B2: (class, n) to (class, n, quota): max(1, floor(share n)), then one each by largest remainder, size and name until ``total``.

    In every addition a class's remainder falls by 1.  All remainders lie in one
    interval of length 1 but those of classes raised to 1, which are below it by
    whole numbers; so additions come in rounds over the classes whose remainder
    is still the largest.  Whole rounds are shared out by arithmetic over the
    distinct whole parts; only the last, partial round needs an order, of the
    classes alone.
    """
    base = F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("n")))
    t = sizes.select("class", "n", base.cast("bigint").alias("base")).withColumn("rest", F.round(F.lit(share) * F.col("n") - F.col("base"), 9))
    t = t.withColumn("level", F.floor("rest"))
    left = t.agg(F.greatest(F.lit(total) - F.sum("base"), F.lit(0)).alias("left"))
    # Rounds run over levels from the top: before a class of level l gets its first, those above have got their rounds down to l.
    levels = t.groupBy("level").agg(F.count(F.lit(1)).alias("classes"))
    down = Window.orderBy(F.col("level").desc())
    levels = levels.withColumn("upto", F.sum("classes").over(down)).withColumn("next", F.lead("level").over(down))
    levels = levels.withColumn("whole", F.col("upto") * (F.col("level") - F.col("next")))
    before = F.coalesce(F.sum("whole").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = levels.withColumn("before", before).crossJoin(F.broadcast(left))
    reached = levels.filter(F.col("before") <= F.col("left")).agg(F.max_by(F.struct("level", "upto", "before"), F.col("before") * 1.0 - F.col("level") * 1e-9).alias("r"), F.max("left").alias("left"))
    reached = reached.select(F.col("r.level").alias("lowest"), F.floor((F.col("left") - F.col("r.before")) / F.col("r.upto")).alias("rounds"), F.pmod(F.col("left") - F.col("r.before"), F.col("r.upto")).alias("over"))
    t = t.crossJoin(F.broadcast(reached)).withColumn("taking", F.col("level") >= F.col("lowest"))
    t = t.withColumn("got", F.when(F.col("taking"), F.col("level") - F.col("lowest") + F.col("rounds")).otherwise(0))
    place = F.row_number().over(Window.partitionBy("taking").orderBy((F.col("rest") - F.col("got")).desc(), F.col("n").desc(), F.col("class").desc()))
    extra = (F.col("taking") & (place <= F.col("over"))).cast("bigint")
    return t.select("class", "n", (F.col("base") + F.col("got") + extra).cast("bigint").alias("quota"))


def take_least_similar(rows: DataFrame, group: str, quota: Column, order: Sequence[Column]) -> DataFrame:
    """Adds ``held_out`` to the first ``quota`` rows of each group in the order; B3's similarities and near-duplicate flag must be in the order given."""
    return rows.withColumn("held_out", F.row_number().over(Window.partitionBy(group).orderBy(*order)) <= quota)


def hold_out_least_similar(rows: DataFrame, augmented: DataFrame, group: str, quota: Column, near: float = 0.9, kind: str = "split", seed: int = 42) -> DataFrame:
    """Adds ``near_duplicate``, ``aug_similarity``, ``peer_similarity`` and ``held_out`` to a stated set ``rows`` (id, text, ``group``).

    Similarities are sequence ratios of normalised texts: the largest with any
    of ``augmented`` (id, text), and the largest with any other of ``rows``.
    Of each group the first ``quota`` rows go: those without a near duplicate
    first, then the least similar to augmented ones, to peers, then by hash.
    """
    from tessera.operators.leakage import audit

    plain = rows.select("id", "text")
    aug = audit(plain, evenly(augmented.select(F.col("id").alias("ref"), "text")), kind).select(F.col("id").alias("__a"), F.col("ratio").alias("aug_similarity"))
    peers = audit(plain, plain.withColumnRenamed("id", "ref"), kind, own=False).select(F.col("id").alias("__p"), F.col("ratio").alias("peer_similarity"))
    out = rows.join(aug, F.col("id") == F.col("__a"), "left").join(peers, F.col("id") == F.col("__p"), "left").drop("__a", "__p").fillna(0.0, ["aug_similarity", "peer_similarity"])
    out = out.withColumn("near_duplicate", F.col("peer_similarity") >= near)
    return take_least_similar(out, group, quota, [F.col("near_duplicate"), F.col("aug_similarity"), F.col("peer_similarity"), uniform(F.col("id"), F.lit("hold"), seed=seed), F.col("id")])


def _words(text: Column) -> Column:
    """The words between white space; none of an empty text."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def _one_of(pool: Column, *keys: Column, seed: int) -> Column:
    return F.element_at(pool, (F.floor(uniform(*keys, seed=seed) * F.size(pool)) + 1).cast("int"))


def substitute_words(text: Column, mapping: Mapping[str, str | Sequence[str]], key: Column, rate: float, seed: int = 42) -> Column:
    """Each word that the map has is replaced by one of its alternatives with probability ``rate``; a capital first letter stays one.

    Runs of white space become one blank.
    """
    lists = [(w, [x] if isinstance(x, str) else list(x)) for w, x in mapping.items()]
    table = F.create_map(*[x for w, alternatives in lists for x in (F.lit(w), F.array(*[F.lit(a) for a in alternatives]))])

    def one(word: Column, i: Column) -> Column:
        pool = F.try_element_at(table, F.lower(word))
        new = _one_of(pool, key, i, F.lit("as"), seed=seed)
        cased = F.when(F.substring(word, 1, 1) == F.upper(F.substring(word, 1, 1)), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new)))).otherwise(new)
        return F.when(pool.isNotNull() & (uniform(key, i, F.lit("sub"), seed=seed) < rate), cased).otherwise(word)

    return F.array_join(F.transform(_words(text), one), " ")


def drop_tones(text: Column, key: Column, rate: float, seed: int = 42) -> Column:
    """Each word loses its marks with probability ``rate``; the barred d stays."""
    return F.array_join(F.transform(_words(text), lambda w, i: F.when(uniform(key, i, F.lit("tone"), seed=seed) < rate, F.translate(w, _MARKED, _BARE)).otherwise(w)), " ")


def merge_words(text: Column, key: Column, rate: float, seed: int = 42) -> Column:
    """max(1, floor(words * rate)) of the gaps between words go, drawn without repeats; a text of one word stays.

    Merging neighbours one after the other closes a uniform choice of gaps.
    """
    words = _words(text)

    def merged(w: Column) -> Column:
        gaps = F.array_sort(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.struct(uniform(key, i, F.lit("merge"), seed=seed).alias("u"), i.alias("i"))))
        many = F.greatest(F.lit(1), F.floor(F.size(w) * F.lit(rate)).cast("int"))
        joined = lambda closed: F.array_join(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat(F.when(F.array_contains(closed, i), "").otherwise(" "), F.get(w, i))), "")
        return F.concat(F.get(w, F.lit(0)), _bound(F.slice(gaps, F.lit(1), many)["i"], joined))

    return F.transform(F.array(words), lambda w: F.when(F.size(w) < 2, text).otherwise(merged(w)))[0]


def insert_fillers(text: Column, fillers: Sequence[str], key: Column, rate: float, seed: int = 42) -> Column:
    """max(1, floor(words * rate / 2)) fillers, one after the other, each at a place drawn among all there are then."""
    pool = F.array(*[F.lit(f) for f in fillers])
    words = _words(text)

    def insert(w: Column, turn: Column) -> Column:
        at = F.floor(uniform(key, turn, F.lit("place"), seed=seed) * (F.size(w) + 1)).cast("int")
        return F.concat(F.slice(w, F.lit(1), at), F.array(_one_of(pool, key, turn, F.lit("which"), seed=seed)), F.slice(w, at + 1, F.size(w) + 1))

    many = F.greatest(F.lit(1), F.floor(F.size(words) * F.lit(rate * 0.5)).cast("int"))
    return F.array_join(F.aggregate(F.sequence(F.lit(1), many), words, insert), " ")


#: Letters of neighbouring keys, for ``typos`` with substitution. Fixed values.
NEIGHBOURS = {
    "a": "as", "b": "bn", "c": "cv", "d": "df", "e": "er", "g": "gh", "h": "hj", "i": "io", "k": "kl", "l": "lk", "m": "mn",
    "n": "nm", "o": "op", "p": "po", "q": "qw", "r": "rt", "s": "sd", "t": "ty", "u": "ui", "v": "vb", "x": "xz", "y": "yu",
}


def typos(text: Column, key: Column, rate: float, seed: int = 42, substitute: bool = False) -> Column:
    """Each place, from left to right, with probability ``rate``: its letter moves behind the next one, or is lost.

    A letter that moves is at the next place then, and may be hit again.  With
    ``substitute``, a third kind replaces a letter by one of a neighbouring key.
    Short texts are meant: the text is built letter by letter.
    """
    near = F.create_map(*[x for a, b in NEIGHBOURS.items() for x in (F.lit(a), F.lit(b))])
    kinds = 3 if substitute else 2

    def step(state: Column, i: Column) -> Column:
        return _bound(uniform(key, i, F.lit("typo"), seed=seed) < rate, lambda hit: changed(state, i, hit))

    def changed(state: Column, i: Column, hit: Column) -> Column:
        following = F.substring(text, i + 1, F.lit(1))
        here = state["here"]
        kind = F.floor(uniform(key, i, F.lit("how"), seed=seed) * kinds)
        moved, lost = hit & (kind == 0) & (i < F.char_length(text)), hit & (kind == 1)
        keys = F.try_element_at(near, F.lower(here))
        other = F.substring(keys, (F.floor(uniform(key, i, F.lit("key"), seed=seed) * 2) + 1).cast("int"), F.lit(1))
        letter = F.when(hit & (kind == 2) & keys.isNotNull(), other).otherwise(here)
        done = F.when(moved, F.concat(state["done"], following)).when(lost, state["done"]).otherwise(F.concat(state["done"], letter))
        return F.struct(done.alias("done"), F.when(moved, here).otherwise(following).alias("here"))

    start = F.struct(F.lit("").alias("done"), F.substring(text, 1, 1).alias("here"))
    return F.when(text.isNull() | (F.char_length(text) == 0), text).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1))), start, step, lambda s: s["done"]))


#: Words that are misheard, what is said between words, and the rates of each step by level.
MISHEARD = {
    "gọi": ("gói", "gỏi", "gồi"), "đặt": ("đật", "đất", "đắt"), "báo": ("bào", "bảo", "bão"), "thức": ("thức", "thứ", "thừ"), "sáng": ("sáng", "sắng", "xáng"),
    "anh": ("anh", "an", "án"), "điện": ("điện", "biến", "diện"), "lúc": ("lúc", "lục", "lức"), "giờ": ("giờ", "dờ", "dơ"), "nhãn": ("nhãn", "nhạn", "nhan"),
    "tìm": ("tìm", "tím", "tim"), "số": ("số", "sỗ", "xố"), "mở": ("mở", "mỡ", "mơ"), "cài": ("cài", "cái", "cãi"), "gửi": ("gửi", "gỡi", "gưởi"),
    "chụp": ("chụp", "chúp", "chóp"), "quay": ("quay", "quảy", "quậy"), "tạo": ("tạo", "táo", "tảo"), "chọn": ("chọn", "chộn", "chón"), "thêm": ("thêm", "thềm", "thèm"),
}
FILLERS = ("à", "ờ", "thì", "à mà", "ờ thì", "à ờ", "thì là", "à thì")
LEVELS = {
    "light": {"substitute": 0.08, "typo": 0.02, "tone": 0.15, "merge": 0.0, "filler": 0.0},
    "medium": {"substitute": 0.15, "typo": 0.05, "tone": 0.30, "merge": 0.05, "filler": 0.05},
    "heavy": {"substitute": 0.25, "typo": 0.10, "tone": 0.50, "merge": 0.10, "filler": 0.10},
}
#: Rates of the noise for training: tone marks and shapes by letter, gaps.
MARK_LEVELS = {"light": {"tone": 0.25, "shape": 0.10, "merge": 0.05}, "medium": {"tone": 0.50, "shape": 0.25, "merge": 0.12}}


def _bound(value: Column, apply: Callable[[Column], Column]) -> Column:
    """``apply`` on a variable of a lambda, so that ``value`` is computed once however often it is used."""
    return F.transform(F.array(value), lambda v: apply(v))[0]


def _fan_out(rows: DataFrame, text: str, key: str, noisy: Mapping[str, Column], suffix: str) -> DataFrame:
    levels = F.explode(F.array(*[F.lit(n) for n in noisy]))
    out = rows.withColumn("__level", levels).withColumn(f"clean_{text}", F.col(text)).withColumn("noise_level", F.col("__level"))
    done = None
    for name, column in noisy.items():
        done = F.when(F.col("noise_level") == name, column) if done is None else done.when(F.col("noise_level") == name, column)
    return out.withColumn(text, done).withColumn(key, F.concat_ws(suffix, F.col(key).cast("string"), F.col("noise_level"))).drop("__level")


def add_noise(rows: DataFrame, text: str, key: str, levels: Mapping[str, Mapping[str, float]] = LEVELS, words: Mapping[str, str | Sequence[str]] = MISHEARD, fillers: Sequence[str] = FILLERS, seed: int = 42) -> DataFrame:
    """Each row once for each level: clean_<text>, <text>, noise_level, and ids with the level behind.

    Steps in order, each with its own rate, those of rate 0 left out: misheard
    words, typos, lost tones, merged words, fillers.
    """
    made = {}
    for name, rate in levels.items():
        k = F.concat_ws("/", F.col(key).cast("string"), F.lit(name))
        steps = {
            "substitute": partial(substitute_words, mapping=words, key=k, rate=rate["substitute"], seed=seed), "typo": partial(typos, key=k, rate=rate["typo"], seed=seed), "tone": partial(drop_tones, key=k, rate=rate["tone"], seed=seed),
            "merge": partial(merge_words, key=k, rate=rate["merge"], seed=seed), "filler": partial(insert_fillers, fillers=fillers, key=k, rate=rate["filler"], seed=seed),
        }
        made[name] = F.col(text)
        for step, apply in steps.items():
            if rate[step] > 0:
                made[name] = _bound(made[name], apply)
    return _fan_out(rows, text, key, made, "_")


def drop_marks(text: Column, key: Column, tone: float, shape: float, merge: float, seed: int = 42) -> Column:
    """Each letter loses its tone with probability ``tone``, then its shape with ``shape``; each blank goes with ``merge``."""
    tones, shapes = _tone_tables()

    def letter(c: Column, i: Column) -> Column:
        bare = F.when(uniform(key, i, F.lit("tone"), seed=seed) < tone, F.translate(c, *tones)).otherwise(c)
        plain = F.translate(bare, *shapes)
        return F.when((plain != bare) & (uniform(key, i, F.lit("shape"), seed=seed) < shape), plain).otherwise(bare)

    noisy = F.array_join(F.transform(F.split(text, ""), letter), "")
    parts = F.transform(F.split(noisy, " "), lambda w, i: F.when((i > 0) & (uniform(key, i, F.lit("gap"), seed=seed) >= merge), F.concat(F.lit(" "), w)).otherwise(w))
    return F.array_join(parts, "") if merge > 0 else noisy


def training_noise(rows: DataFrame, text: str, key: str, levels: Mapping[str, Mapping[str, float]] = MARK_LEVELS, seed: int = 42) -> DataFrame:
    """The rows as they are, and once more for each level, ids with the level behind; ids stay distinct if they were."""
    k = lambda name: F.concat_ws("/", F.col(key).cast("string"), F.lit(name))
    noisy = _fan_out(rows, text, key, {n: drop_marks(F.col(text), k(n), r["tone"], r["shape"], r["merge"], seed) for n, r in levels.items()}, "_noisy_")
    return rows.withColumn(key, F.col(key).cast("string")).unionByName(noisy, allowMissingColumns=True)


def training_rows(noisy: DataFrame, levels: Sequence[str] = ("light", "medium"), text: str = "query") -> DataFrame:
    """Rows of some levels as training rows: id, group (``other`` if there is none), the noisy text as ``text``, expected."""
    return noisy.filter(F.col("noise_level").isin(*levels)).select("id", F.coalesce("group", F.lit("other")).alias("group"), F.col(f"noisy_{text}").alias(text), "expected")


def _tone_tables() -> tuple[tuple[str, str], tuple[str, str]]:
    """Letters with a tone and without it; letters with a shape, which have no tone, and the plain ones."""
    import unicodedata

    tones = {"̀", "́", "̃", "̉", "̣"}
    a, b = [], []
    for c in _MARKED:
        plain = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if x not in tones))
        if plain != c and len(plain) == 1:
            a.append(c)
            b.append(plain)
    shapes = "ăâêôơưđĂÂÊÔƠƯĐ"
    return ("".join(a), "".join(b)), (shapes, "aaeooudAAEOOUD")


def strip_tones_then_shapes(text: Column) -> tuple[Column, Column]:
    """Without tone marks only, and without any marks."""
    toneless = F.translate(text, *_tone_tables()[0])
    return toneless, F.translate(toneless, _MARKED + "đĐ", _BARE + "dD")


def ordinals(rows: DataFrame, order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Row numbers from 1 over a whole table in an order, without bringing it into one task: rows are sorted by ranges, counted per range, and numbered within."""
    ranged = kept(rows.sort(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    counted = ranged.groupBy("__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    placed = counted.select("__part", (F.coalesce(before, F.lit(0)) - F.col("__first") + 1).alias("__add"))
    return ranged.join(F.broadcast(placed), "__part").withColumn(name, F.col("__at") + F.col("__add")).drop("__part", "__at", "__add")


def zipped(a: DataFrame, b: DataFrame, order_a: Sequence[str], order_b: Sequence[str]) -> DataFrame:
    """Rows of equal ordinal, as many as the shorter side has."""
    return ordinals(a, order_a, "__o").join(ordinals(b, order_b, "__o"), "__o").drop("__o")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all, missing columns as null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def blocked(rows: DataFrame, key: str, blocklists: Sequence[DataFrame]) -> DataFrame:
    """Rows whose key no blocklist has."""
    return rows.join(union_all([b.select(key) for b in blocklists]).distinct(), key, "left_anti")


def from_templates(templates: DataFrame, text: str = "template") -> DataFrame:
    """Adds ``query``, the template with its slots' own names filled in."""
    return templates.withColumn("query", fill_template(F.col(text)))
