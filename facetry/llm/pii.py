"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier decides.

Strict patterns give the base spans of four kinds; wider patterns add candidates (masked addresses, national phone
numbers, long card-like numbers, IPv6). Five labelers vote yes, no or nothing on every candidate of every text: the
strict pattern, a checksum or range check, a gazetteer, cue words before the span, and its edges. The votes of all
texts are counted by pattern (at most 4 x 3**5 rows), expectation-maximisation estimates from the counts how reliable
each labeler is for each kind, and a logistic regression is trained on the resulting soft labels. Candidates that it
accepts and that do not touch a base span are added; base spans always stay.

All of it is DataFrame and SQL functions. Patterns repeat possessively, so no text makes the matcher recurse or scan
a run twice: a match may begin only where a run of its first characters begins or where the last match ended.

Defined cases: a null text counts as empty; a text without spans has counts 0, the hash of the empty string and
empty spans; overlapping base spans of different kinds all stay; without any candidate nothing is trained and
nothing is added; repeated rows are judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_or_empty

KINDS = ("email", "ip", "card", "phone")
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Strict patterns; each is preceded by a cheap test of the text.
STRICT = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"(?:[0-9][ -]?){11}[0-9]", r"[0-9](?:[ -]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
WIDE = {
    "email": (r"[(\[] ?at ?[)\]]", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[] ?at ?[)\]] ?[A-Za-z0-9-]++(?: ?[(\[] ?dot ?[)\]] ?|\.)[A-Za-z]{2,12}"),
    "ip": (r"[0-9A-Fa-f]:[0-9A-Fa-f]", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": (r"[0-9]{4}[ -]?[0-9]{4}", r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])"),
    "phone": (r"[0-9]{3}[ .-][0-9]{4}", r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
}
#: Gazetteers: top-level domains, first octets of no public host, issuers' first digits, area codes of no subscriber.
KNOWN = {"email": r"(?i)[.\])](?:com|org|net|edu|gov|io|de|fr|es|uk|info)$", "ip": r"^(?!0|10\.|127\.|255\.)", "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))", "phone": r"^(?:\+[1-9]|\(?[2-9])"}
CUES = {"email": r"(?i)(?:e-?mail|mail|contact|write)\W*(?:\w+\W+){0,2}$", "ip": r"(?i)(?:ip|host|server|address)\W*(?:\w+\W+){0,2}$", "card": r"(?i)(?:card|visa|credit|payment)\W*(?:\w+\W+){0,2}$", "phone": r"(?i)(?:tel|phone|call|fax|mobile)\W*(?:\w+\W+){0,2}$"}
AGAINST = r"(?i)(?:version|ver\.|isbn|order|invoice|serial|id|no\.)\W*$"
LABELERS, ROUNDS = ("strict", "check", "known", "cue", "edge"), 8
#: What the classifier sees; it has to do without the strict pattern, which all base spans match.
FEATURES = LABELERS[1:]
_SPANS = "array<struct<start:int,end:int,text:string,before:string,edges:string>>"
#: Items of a running total that are taken together, and characters of a text that are cut together.
BLOCK, CUT = 256, 1024


def _running(rows: DataFrame, out: str, items: Column, zero: int, fold: Callable[[Column, Column], Column]) -> DataFrame:
    """rows with the running fold of an array of integers in column `out`. Arrays grow only within blocks and by one
    value for each block, so long arrays are not copied for each of their items."""

    def along(x: Column) -> Column:
        none = F.array().cast("array<int>")
        return F.aggregate(x, none, lambda acc, y: F.concat(acc, F.array(fold(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(zero)), y))))

    keep = [c for c in rows.columns if c != out]
    rows = rows.withColumn("pii_items", items)
    count = F.floor((F.size("pii_items") + BLOCK - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.slice("pii_items", (i - 1) * BLOCK + 1, BLOCK))
    rows = rows.withColumn("pii_inside", F.transform(blocks, along))
    rows = rows.withColumn("pii_starts", F.concat(F.array(F.lit(zero)), along(F.transform("pii_inside", lambda x: F.get(x, F.size(x) - 1)))))
    whole = F.zip_with("pii_inside", F.slice("pii_starts", 1, F.size("pii_inside")), lambda x, start: F.transform(x, lambda y: fold(start, y)))
    return rows.select(*keep, F.flatten(whole).alias(out))


def _located(rows: DataFrame, name: str, test: str, pattern: str) -> DataFrame:
    """rows with the matches in column `name`: their places in code points, from the text between them, and what stands
    before and around each. Every step passes over the text once."""
    text, gaps, all_found = F.col("text"), f"{name}_gaps", f"{name}_found"
    hit = F.rlike(text, F.lit(test))
    none = F.array().cast("array<string>")
    rows = rows.withColumn(gaps, F.when(hit, F.split(text, pattern, -1)).otherwise(none))
    rows = rows.withColumn(all_found, F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    steps = F.zip_with(all_found, F.slice(gaps, 1, F.size(all_found)), lambda m, gap: F.char_length(gap) + F.char_length(m))
    rows = _running(rows, f"{name}_ends", steps, 0, lambda x, y: x + y)
    around = F.zip_with(F.slice(gaps, 1, F.size(all_found)), F.slice(gaps, 2, F.size(all_found)), lambda one, two: F.struct(F.right(one, F.lit(32)).alias("before"), F.concat(F.right(one, F.lit(1)), F.lit(" "), F.substring(two, 1, 1)).alias("edges")))
    placed = F.zip_with(all_found, f"{name}_ends", lambda m, end: F.struct(m.alias("m"), end.alias("end")))
    sized = F.zip_with(placed, around, lambda x, y: F.struct((x["end"] - F.char_length(x["m"])).alias("start"), x["end"].alias("end"), x["m"].alias("text"), y["before"].alias("before"), y["edges"].alias("edges")))
    return rows.withColumn(name, sized.cast(_SPANS)).drop(gaps, all_found, f"{name}_ends")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    n = F.char_length(_digits(m))
    if kind == "ip":
        return F.rlike(m, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
    if kind == "card":
        return n.between(12, 19) & F.call_function("luhn_check", _digits(m))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _votes(kind: str, base: bool):
    """A span with its votes, each -1, 0 or 1. Cues are looked for in the text since the match before."""

    def run(s: Column) -> Column:
        before, edges = s["before"], s["edges"]
        m, one, no, none = s["text"], F.lit(1), F.lit(-1), F.lit(0)
        check = F.when(_valid(kind, m), one).otherwise(no) if kind == "card" or base else none
        return F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), F.lit(base).alias("base"),
            (one if base else none).alias("strict"), check.alias("check"),
            F.when(F.rlike(m, F.lit(KNOWN[kind])), one).otherwise(no).alias("known"),
            F.when(F.rlike(before, F.lit(CUES[kind])), one).when(F.rlike(before, F.lit(AGAINST)), no).otherwise(none).alias("cue"),
            F.when(F.rlike(edges, F.lit(r"\w")), no).otherwise(one).alias("edge"),
        )

    return run


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, spans: every candidate of a text with its votes, one map over the whole texts."""
    return _candidates_of(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), "doc_id")


def _candidates_of(rows: DataFrame, key: str) -> DataFrame:
    """rows: columns key and text."""
    kept = rows.columns
    for k in KINDS:
        rows = _located(_located(rows, f"pii_s_{k}", *STRICT[k]), f"pii_w_{k}", *WIDE[k])
    strict = [F.transform(F.filter(f"pii_s_{k}", _keeps(k)), _votes(k, True)) for k in KINDS]
    wide = [F.transform(f"pii_w_{k}", _votes(k, False)) for k in KINDS]
    rows = rows.select(*kept, F.array_sort(F.concat(*strict, *wide)).alias("pii_all"))
    # a candidate that touches no base span: none that begins before reaches it, none after begins inside
    rows = _before(rows, "pii_all", lambda s: F.when(s["base"], s["end"]).otherwise(-1))
    begins = F.transform("pii_all", lambda s: F.when(s["base"], s["start"]).otherwise(_FAR))
    rows = _running(rows, "pii_begin", F.reverse(begins), _FAR, F.least)
    free = F.zip_with(F.zip_with("pii_all", "pii_reach", lambda s, at: s["start"] >= at), F.zip_with("pii_all", F.reverse("pii_begin"), lambda s, at: s["end"] <= at), lambda x, y: x & y)
    return rows.select(key, "text", _those(F.col("pii_all"), free).alias("spans"))


_FAR = (1 << 31) - 1


def _those(spans: Column, free: Column) -> Column:
    """Base spans, and of the others those that are free."""
    held = F.zip_with(spans, free, lambda s, ok: F.when(s["base"] | ok, s))
    return F.filter(held, lambda s: s.isNotNull())


def _before(rows: DataFrame, spans: str, end: Callable[[Column], Column]) -> DataFrame:
    """rows with pii_reach: for each span the greatest of end(span) over the spans before it, 0 for the first."""
    rows = _running(rows, "pii_reach", F.transform(spans, end), 0, F.greatest)
    return rows.withColumn("pii_reach", F.slice(F.concat(F.array(F.lit(0)), "pii_reach"), 1, F.size(spans)))


def _keeps(kind: str):
    return lambda s: _valid(kind, s["text"])


@dataclass
class Model:
    """Weights of the span classifier, and the labelers' estimated accuracies by kind."""

    bias: list[float] = field(default_factory=lambda: [-1.0] * len(KINDS))
    weights: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    accuracy: dict[tuple[int, str], float] = field(default_factory=dict)

    def accepts(self, s: Column) -> Column:
        score = F.element_at(F.array(*map(F.lit, self.bias)), s["kind"] + 1)
        for w, name in zip(self.weights, FEATURES, strict=True):
            score = score + F.lit(w) * s[name]
        return s["base"] | (score > 0)


def fit(found: DataFrame, rounds: int = ROUNDS) -> Model:
    """Estimates and trains from the votes of all candidates (column spans)."""
    lean = F.transform("spans", lambda s: F.struct(*[s[x].alias(x) for x in ("kind", *LABELERS)]))
    spans = found.select(F.inline(lean))
    votes = staged(spans.groupBy("kind", *LABELERS).agg(F.count("*").alias("n")).coalesce(1))
    if not votes.count():
        return Model()
    posterior = 1 / (1 + F.exp(-sum((F.col(x) for x in LABELERS), F.lit(0.0))))
    model = Model()
    for _ in range(rounds):
        held = votes.withColumn("p", posterior)
        sums = [F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum("n").alias("all")]
        for x in LABELERS:
            for v in (-1, 1):
                hit = F.when(F.col(x) == v, F.col("n")).otherwise(0)
                sums += [F.sum(hit * F.col("p")).alias(f"{x}_{v}_1"), F.sum(hit * (1 - F.col("p"))).alias(f"{x}_{v}_0")]
        odds = F.lit(0.0)
        for r in held.groupBy("kind").agg(*sums).collect():
            no = r["all"] - r["yes"]
            own = F.log(F.lit((r["yes"] + 1) / (no + 1)))
            for x in LABELERS:
                yes, other = ([r[f"{x}_{v}_{y}"] + 1 for v in (-1, 1)] for y in (1, 0))
                for i, v in enumerate((-1, 1)):  # a labeler that says nothing says nothing
                    ratio = yes[i] / sum(yes) * sum(other) / other[i]
                    own = own + F.when(F.col(x) == v, F.log(F.lit(ratio))).otherwise(0.0)
                model.accuracy[r["kind"], x] = (yes[1] + other[0]) / (sum(yes) + sum(other))
            odds = odds + F.when(F.col("kind") == r["kind"], own).otherwise(0.0)
        posterior = 1 / (1 + F.exp(-odds))
    soft = votes.withColumn("p", posterior)
    features = F.array(*[(F.col("kind") == k).cast("double") for k in range(len(KINDS))], *[F.col(x).cast("double") for x in FEATURES])
    rows = soft.select(array_to_vector(features).alias("features"), F.lit(1.0).alias("label"), (F.col("n") * F.col("p")).alias("weight")).unionByName(
        soft.select(array_to_vector(features).alias("features"), F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("p"))).alias("weight"))
    )
    trained = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=15, standardization=False).fit(rows.where("weight > 0").coalesce(1))
    w = [float(x) for x in trained.coefficients]
    model.bias = [trained.intercept + x for x in w[: len(KINDS)]]
    model.weights = w[len(KINDS) :]
    return model


def accepted(found: DataFrame, model: Model) -> DataFrame:
    """found with only the spans that the classifier accepts, by start and kind; added ones never touch each other: the
    one that begins first stays."""
    kept = found.withColumn("spans", F.filter("spans", model.accepts))
    kept = _before(kept, "spans", lambda s: F.when(s["base"], -1).otherwise(s["end"]))
    free = F.zip_with("spans", "pii_reach", lambda s, at: s["start"] >= at)
    return kept.withColumn("spans", _those(F.col("spans"), free)).drop("pii_reach")


def _named(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all)."""
    found = staged(candidates(docs, id_col, text_col).select("doc_id", "spans"))
    out = accepted(found, fit(found)).withColumn("base", F.filter("spans", lambda s: s["base"]))
    counts = [F.size(F.filter("base", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(_named(F.col("base")), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"))


def _is(kind: int):
    return lambda s: s["kind"] == kind


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """docs with every found span replaced by its kind in brackets, and its character count, if it has one, renewed.

    The model is fitted on one pass over the texts and applied in a second one; no text is shuffled."""
    model = fit(candidates(docs, id_col, text_col))
    columns, key = docs.columns, "facetry_own_row"
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias(key))
    texts = packed.withColumn("text", F.coalesce(F.col(f"{key}.{text_col}"), F.lit("")))
    spans = accepted(_candidates_of(texts, key), model)
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    # the text in blocks, so that a piece between two spans is cut out of few of them and not from the text's beginning
    spans = spans.withColumn("pii_blocks", F.when(F.size("spans") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))))
    spans = _before(spans, "spans", lambda s: s["end"])

    def piece(start: Column, end: Column) -> Column:
        first = F.floor(start / CUT).cast("int")
        held = F.array_join(F.slice("pii_blocks", first + 1, F.floor(end / CUT).cast("int") - first + 1), "")
        return F.substring(held, start - first * CUT + 1, end - start)

    shown = F.zip_with("spans", "pii_reach", lambda s, at: F.when(s["start"] >= at, F.concat(piece(at, s["start"]), F.element_at(tags, s["kind"] + 1))).otherwise(""))
    last = F.array_max(F.transform("spans", lambda s: s["end"]))
    rest = F.concat(F.array_join(shown, ""), piece(last, F.char_length("text")))
    clean = spans.withColumn("clean", F.when(F.size("spans") > 0, rest).otherwise(F.col("text")))
    out = []
    for c in columns:
        if c == text_col:
            out.append(F.when(F.col(f"{key}.{c}").isNotNull(), F.col("clean")).alias(c))
        elif c == count_col:
            out.append(F.when(F.size("spans") > 0, F.char_length("clean")).otherwise(F.col(f"{key}.{c}")).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"{key}.`{c}`").alias(c))
    return clean.select(*out)
