"""Personal data: fixed rules, and boosted trees over proposed spans, in DataFrame expressions only.

Rules give the base spans of four kinds. Generators of high recall propose spans
the rules may miss - numbers with other separators, addresses written around -
and may overlap. Gradient-boosted trees judge a proposal by its format and by
the characters around it; they learn, from all proposals, which ones the rules
confirm, but see none of the rules' checks (check digits, limits of parts, at
and plus signs). Confirmed spans are learnt a second time in forms
only the generators propose: without plus, with [at], with other separators.
A proposal that a rule would confirm in its own form is no negative: addresses
written around and numbers with a right check digit are left out, numbers that
lack only the plus weigh ``UNSURE`` and set no threshold. A proposal is redacted when its probability reaches the threshold of
its kind, calibrated on proposals the trees did not learn from, and when it
overlaps no base span and none of the better proposals that stay. Base spans always stay.

Places of matches follow from what lies between them: the text split by a
pattern gives the gaps, and running sums of lengths give starts in code points.
Patterns repeat possessively, so they take time in proportion to the text and no
stack. Only texts with a digit or an at sign are looked at, equal ones once.

Defined results: a null or empty text has no spans. Every row gives a row;
repeated rows repeat. Too few proposals for a model add no spans. ``redact``
keeps further columns. Empty tables give empty tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoca.llm.common import without
from convoca.sources.staging import full_width, stage

KINDS = ["email", "ip", "card", "phone"]
# fixed values: the rules' patterns; repeats are possessive, matches are the same
RULES = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)"
    r"[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9.])[0-9]++(?:[.:][0-9]++){3,7}+",
    "card": r"(?<![0-9])[0-9](?:[\x20./_-]?+[0-9]){7,}+",
    "phone": r"(?<![0-9A-Za-z])\+?+\(?+[0-9](?:[\x20()./-]{0,2}+[0-9]){6,}+",
}
# fewer spans of a label give no trees
LEAST_ROWS = 50
TREES, DEPTH = 15, 4
PRECISION = 0.98
# weight of numbers that may be phones
UNSURE = 0.2
CONTEXT = 24
_KEYWORDS = {
    "says_mail": "mail|contact|write to|address",
    "says_phone": "tel|phone|call|fax|mobil",
    "says_net": r"\bip\b|host|server|addr",
    "says_card": "card|visa|master|amex|credit|pay",
    "says_other": r"version|\bv$|isbn|order|invoice|\bid\b|no\.|#$",
}


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(
        numbers, lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _confirmed(kind: Column, found: Column) -> Column:
    """The rules' checks beyond their patterns."""
    digits = _digits(found)
    size = F.length(digits)
    parts = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", small)
        .when(kind == "card", F.when(size.between(12, 19), luhn(digits)).otherwise(False))
        .otherwise(size.between(9, 15))
    )


def _matches(text: Column, pattern: str, kind: str, rule: bool) -> Column:
    """Array of (kind, rule, nth, found, gap, before, after) of the matches in order."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return F.transform(
        F.arrays_zip(found.alias("found"), gaps.alias("gap"), F.slice(gaps, F.lit(2), F.size(found)).alias("next")),
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"),
            F.lit(rule).alias("rule"),
            i.alias("nth"),
            m["found"].alias("found"),
            F.length(m["gap"]).cast("bigint").alias("gap"),
            F.right(m["gap"], F.lit(CONTEXT)).alias("before"),
            F.left(m["next"], F.lit(CONTEXT)).alias("after"),
        ),
    )


def spans(texts: DataFrame) -> DataFrame:
    """(mark, kind, start, end, base, found, before, after) of the rules' and the generators' matches in ``texts`` (mark, text)."""
    text = F.col("text")
    guards = {"email": r"@|[\[(]at[\])]", "ip": r"[0-9][.:][0-9]", "card": "[0-9]", "phone": "[0-9]"}
    lists = [
        F.when(text.rlike(guards[kind]), _matches(text, patterns[kind], kind, patterns is RULES))
        for kind in KINDS
        for patterns in (RULES, GENERATORS)
    ]
    none = F.array().cast("array<struct<kind:string,rule:boolean,nth:int,found:string,gap:bigint,before:string,after:string>>")
    each = texts.select("mark", F.explode(F.concat(*[F.coalesce(part, none) for part in lists])).alias("m")).select("mark", "m.*")
    # the last gap comes with no match
    each = each.filter("found is not null")
    so_far = Window.partitionBy("mark", "kind", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("found").cast("bigint")
    end = F.sum(F.col("gap") + size).over(so_far)
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - size)
    sure = F.col("rule") & _confirmed(F.col("kind"), F.col("found"))
    return (
        placed.filter(~F.col("rule") | sure)
        .groupBy("mark", "kind", "start", "end")
        .agg(F.max("rule").alias("base"), *[F.first(c).alias(c) for c in ("found", "before", "after")])
    )


def _features(found: DataFrame) -> tuple[DataFrame, list[str]]:
    text, digits = F.col("found"), _digits(F.col("found"))
    near = F.lower(F.concat("before", F.lit(" "), "after"))
    count = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    groups = F.split(text, "[^0-9]+")
    columns = {
        **{f"is_{kind}": F.col("kind") == kind for kind in KINDS},
        "length": F.length(text),
        "n_digits": F.length(digits),
        "n_letters": count("[A-Za-z]"),
        "n_blanks": count(" "),
        "n_dots": count(r"\."),
        "n_dashes": count("-"),
        "n_brackets": count(r"[()\[\]]"),
        "n_signs": count("[^A-Za-z0-9 .()+@-]"),
        "n_groups": F.size(groups),
        "longest_group": F.array_max(F.transform(groups, lambda g: F.length(g))),
        "distinct_digits": F.size(F.array_distinct(F.split(digits, ""))),
        "first_digit": F.coalesce(F.left(digits, F.lit(1)).try_cast("int"), F.lit(-1)),
        "open_before": (F.col("before") == "") | F.col("before").rlike(r"[\s(\[:=,;]$"),
        "open_after": (F.coalesce("after", F.lit("")) == "") | F.col("after").rlike(r"^[\s)\].,;:!?]"),
        "digits_near": F.length(_digits(near)),
        **{name: near.rlike(pattern) for name, pattern in _KEYWORDS.items()},
    }
    return found.select("*", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"f_{n}") for n, c in columns.items()]), [
        f"f_{n}" for n in columns
    ]


@dataclass
class Judge:
    """Trees and, by kind, the probability from which a proposal is redacted."""

    trees: GBTClassificationModel
    thresholds: dict[str, float]

    def judged(self, found: DataFrame) -> DataFrame:
        rows, names = _features(found)
        vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows).drop(*names)
        out = self.trees.transform(vectors).withColumn("p", vector_to_array("probability")[1])
        return out.drop("features", "rawPrediction", "probability", "prediction")


def _weight() -> Column:
    """1 for spans of a sure label, less for proposals that differ from confirmed spans in their form alone."""
    kind, text = F.col("kind"), F.col("found")
    at = F.regexp_replace(text, r"\x20?[\[(]at[\])]\x20?", "@")
    address = F.regexp_replace(at, r"\x20?[\[(]dot[\])]\x20?", ".").rlike(f"^(?:{RULES['email']})$")
    card = _confirmed(F.lit("card"), text)
    net = text.rlike(f"^(?:{RULES['ip']})$") & _confirmed(F.lit("ip"), text)
    phone = _confirmed(F.lit("phone"), text) & ~card & ~net
    return (
        F.when(F.col("base"), 1.0)
        .when((kind == "email") & address, 0.0)
        .when((kind == "card") & card, 0.0)
        .when((kind == "phone") & phone, UNSURE)
        .otherwise(1.0)
    )


def _rewritten(spans: DataFrame) -> DataFrame:
    """The confirmed spans of ``spans`` in forms that the rules do not match; addresses of machines have none."""
    kind, text = F.col("kind"), F.col("found")
    one_of = lambda *forms: F.element_at(F.array(*forms), (F.pmod("__order", F.lit(len(forms) * 10)) / 10).cast("int") + 1)
    name, host = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    written = [
        F.concat(name, F.lit(at), F.replace(host, F.lit("."), F.lit(dot)))
        for at, dot in (("[at]", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), (" [at] ", "."), ("@", "[dot]"))
    ]
    parted = [F.regexp_replace(_digits(text), "([0-9]{4})(?=[0-9])", f"$1{sign}") for sign in "./_"]
    form = (
        F.when(kind == "email", one_of(*written))
        .when(kind == "card", one_of(*parted))
        .when(kind == "phone", F.regexp_replace(text, r"^\+", ""))
    )
    return spans.filter("base").withColumn("found", form).filter("found is not null")


def fit(found: DataFrame, precision: float = PRECISION) -> Judge | None:
    """Trees on all spans of ``found``; None where too few are of either label.

    Spans alike in features and label are one row of their weight, in a fixed order, so the trees do not
    depend on partitions. Three tenths, by hash, are kept apart and set the thresholds.
    """
    order = F.xxhash64("found", "before", "start")
    spans = found.withColumn("label", F.col("base").cast("double")).withColumn("weight", _weight()).withColumn("__order", order)
    spans = spans.filter("weight > 0").unionByName(_rewritten(spans))
    apart = F.pmod("__order", F.lit(10)) >= 7
    rows, names = _features(spans)
    alike = rows.groupBy(*names, "label", apart.alias("apart")).agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    alike = stage(alike.sortWithinPartitions(*names, "label"), "pii-lessons")
    sides = {r["label"]: r["n"] for r in alike.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if min(sides.get(0.0, 0), sides.get(1.0, 0)) < LEAST_ROWS:
        return None
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(alike)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, weightCol="weight", maxBins=32, checkpointInterval=-1).fit(
        vectors.filter(~F.col("apart")).select("features", "label", "weight")
    )
    judge = Judge(trees, {})
    tried = judge.judged(spans.filter(apart).filter("weight = 1")).groupBy("kind", F.floor(F.col("p") * 1000).alias("level")).agg(
        F.sum("label").alias("right"), F.count(F.lit(1)).alias("all")
    )
    for kind in KINDS:
        right = every = 0
        for row in tried.filter(F.col("kind") == kind).orderBy(F.desc("level")).collect():
            right, every = right + row["right"], every + row["all"]
            if row["level"] < 500:
                break
            if every >= LEAST_ROWS // 5 and right >= precision * every:
                judge.thresholds[kind] = row["level"] / 1000
    return judge


def chosen(found: DataFrame, judge: Judge | None) -> DataFrame:
    """(mark, kind, start, end, base): base spans, and proposals that pass and overlap nothing better."""
    base = found.filter("base").select("mark", "kind", "start", "end", "base")
    if judge is None or not judge.thresholds:
        return base
    least = F.create_map(*[F.lit(x) for pair in judge.thresholds.items() for x in pair])
    passed = judge.judged(found.filter("not base")).filter(F.col("p") >= F.coalesce(least[F.col("kind")], F.lit(2.0)))
    passed = passed.select("mark", "kind", "start", "end", "base", "p")
    # what overlaps a base span goes first, so chains of overlaps end at base spans
    by_start = Window.partitionBy("mark").orderBy("start", F.desc("base"), "end", "kind")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    rows = base.withColumn("p", F.lit(None).cast("double")).unionByName(passed).withColumn("before", before).withColumn("after", after)
    free = rows.filter(~F.col("base") & F.coalesce(F.col("before") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("after") >= F.col("end"), F.lit(True)))
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.sum(F.when(F.col("start") < F.col("reach"), 0).otherwise(1)).over(by_start)
    free = free.withColumn("reach", reach).withColumn("group", apart)
    # of each chain the most probable stays, then the most probable that overlaps none that stay, and so on
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("p"), "start", "end", "kind")))
    chains = free.groupBy("mark", "group").agg(ranked.alias("spans"))
    meets = lambda kept, s: F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))
    none = F.array().cast(chains.schema["spans"].dataType)
    stay = F.aggregate("spans", none, lambda kept, s: F.when(meets(kept, s), kept).otherwise(F.concat(kept, F.array(s))))
    added = chains.select("mark", F.explode(stay).alias("s")).select("mark", "s.kind", "s.start", "s.end", F.lit(False).alias("base"))
    return base.unionByName(added)


def _mark() -> Column:
    """What tells texts apart: half of a SHA-256."""
    return F.unhex(F.substring(F.sha2(F.col("text").cast("string"), 256), 1, 32))


def _of_texts(docs: DataFrame) -> DataFrame:
    """(mark, spans) of the distinct texts of ``docs`` (mark, text) that have any."""
    looked = docs.filter(F.col("text").rlike(r"[0-9@]|[\[(]at[\])]"))
    texts = full_width(looked.select("mark", "text"), "mark").groupBy("mark").agg(F.first("text").alias("text"))
    found = stage(spans(texts), "pii-spans")
    return _per_text(chosen(found, fit(found)))


def find(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id and ``spans``, an array of (start, end, kind, base) by start, then kind."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), _mark().alias("mark"))
    per_text = _of_texts(docs)
    return docs.select("doc_id", "mark").join(per_text, "mark", "left").select("doc_id", F.coalesce("spans", _empty()).alias("spans"))


def _empty() -> Column:
    return F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,kind:string,base:boolean>>")


def _per_text(rows: DataFrame) -> DataFrame:
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    span = F.struct("start", number.alias("kind_no"), "end", "kind", "base")
    return rows.groupBy("mark").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def joined(spans_column: str) -> Column:
    """kind:start:end of an array of spans, joined by commas."""
    return F.array_join(
        F.transform(spans_column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(docs: DataFrame, mask: str = "[{kind}]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mask``; overlapping spans give one mask."""
    rows = without(docs, "spans")
    per_text = _of_texts(docs.select(_mark().alias("mark"), F.col("text").cast("string").alias("text"))).withColumnRenamed("mark", "__mark")
    made = rows.withColumn("__key", _mark()).join(per_text, F.col("__key") == F.col("__mark"), "left")
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    text = F.col("text").cast("string")
    piece = lambda a, s: F.when(s["start"] < a["at"], F.lit("")).otherwise(
        F.concat(
            F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")),
            F.replace(F.lit(mask), F.lit("{kind}"), s["kind"]),
        )
    )
    masked = F.aggregate(
        F.coalesce("spans", _empty()),
        zero,
        lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], piece(a, s)).alias("out")),
        lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))),
    )
    return made.withColumn("text", masked).select(*[F.col(f"`{c}`") for c in rows.columns], "spans")
